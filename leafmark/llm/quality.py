"""Quality rules: counts per document, and a conditional random field over its lines.

The field labels each line as content or boilerplate (Viterbi over the lines in their order);
a document stays if at least half of its words stand in content lines and the base rules hold.
It is trained on a bounded sample of the labelled documents; every other number here comes
from the whole text. All counting runs in numpy over stretches of whole texts.

Defined results: null and empty texts, and texts without words, have zero counts and fail the
base rules; repeated rows are judged each; without any labelled documents the base rules alone
decide; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafmark.llm.common import TRAIN_TEXT_BYTES, documents, releasing
from leafmark.llm.crf import Crf, train
from leafmark.llm.shingles import mix, range_hashes, text_chunks, word_ranges

#: Most labelled documents of each label that the field is trained on.
TRAIN_PER_LABEL = 1500
MIN_WORDS, MAX_REPEATED, CONTENT_SHARE = 50, 0.5, 0.5
# Fixed value: the characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
LEVELS = 8
CONTENT, BOILERPLATE = 0, 1
OUT = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, content_share double"
)


def _kind(*members: int) -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    table[list(members)] = 1
    return table


_IS_SYMBOL = _kind(*SYMBOLS)
_IS_UPPER, _IS_LOWER = _kind(*range(65, 91)), _kind(*range(97, 123))
_IS_DIGIT = _kind(*range(48, 58))
_IS_LETTER = _kind(*range(65, 91), *range(97, 123), *range(0xC3, 0xE0))
_IS_MARK = _kind(*b"!?;:=_/\\{}[]()~^@+\"")
_IS_STOP = _kind(*b".,!?;:")
_IS_LEAD = _kind(*range(0x80), *range(0xC0, 0x100))      # first bytes of code points
RATIOS = 9
FEATURES = RATIOS * LEVELS + 4


def _before(flags: np.ndarray) -> np.ndarray:
    """Number of set flags before each position, and in all."""
    return np.concatenate(([0], np.cumsum(flags)))


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts per text, and features, words and number of lines, for texts laid end to end."""
    n = len(offsets) - 1
    # A text ends where the next begins, so a word or line is cut there.
    start, stop = word_ranges(data)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    slot = np.searchsorted(start, inner, side="right") - 1
    cuts = np.unique(inner[(slot >= 0) & (start[slot] < inner) & (inner < stop[slot])]) if len(start) else inner[:0]
    start, stop = np.sort(np.concatenate((start, cuts))), np.sort(np.concatenate((stop, cuts)))
    first_word = np.searchsorted(start, offsets)
    n_words = np.diff(first_word)
    lead, symbol = _before(_IS_LEAD[data]), _before(_IS_SYMBOL[data])
    chars = lead[stop] - lead[start]
    chars_before = np.concatenate(([0], np.cumsum(chars)))
    text_of = np.repeat(np.arange(n), n_words)

    repeated = np.zeros(n, dtype=np.int64)
    if len(start) >= 3:
        words = range_hashes(data, start, stop, fold=False)
        whole = np.flatnonzero(text_of[:-2] == text_of[2:])
        key = mix(mix(mix(words[whole] + text_of[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + words[whole + 1]) + words[whole + 2])
        _, place, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = whole[count[place] > 1]
        marked = np.zeros(len(start), dtype=bool)
        for k in range(3):
            marked[twice + k] = True
        repeated = np.bincount(text_of[marked], minlength=n)

    ends = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], ends[ends + 1 < len(data)] + 1))) if len(data) else ends
    line_text = np.searchsorted(offsets, line_start, side="right") - 1
    line_stop = np.minimum(np.concatenate((line_start[1:], [len(data)])), offsets[line_text + 1]) if len(line_start) else line_start
    line_stop = line_stop - ((line_stop > line_start) & (data[np.maximum(line_stop - 1, 0)] == 10)) if len(data) else line_stop
    word_at = np.searchsorted(start, line_start)
    line_words = np.searchsorted(start, line_stop) - word_at
    used = line_words > 0
    line_start, line_stop, line_text, line_words, word_at = (x[used] for x in (line_start, line_stop, line_text, line_words, word_at))
    lines = np.bincount(line_text, minlength=n)
    duplicates, again = np.zeros(n, dtype=np.int64), np.zeros(len(line_start), dtype=np.int64)
    if len(line_start):
        same = mix(range_hashes(data, line_start, line_stop, fold=False) + line_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, once = np.unique(same, return_index=True)
        again = np.ones(len(line_start), dtype=np.int64)
        again[once] = 0
        duplicates = np.bincount(line_text[again > 0], minlength=n)

    def share(table: np.ndarray, over: np.ndarray) -> np.ndarray:
        before = _before(table[data])
        return (before[line_stop] - before[line_start]) / np.maximum(over, 1)

    size = line_stop - line_start
    letters = share(_IS_LETTER, np.ones_like(size))
    word_symbol = symbol[stop] - symbol[start] > 0
    marked_words = _before(word_symbol)
    stopped = _before(_IS_STOP[data[stop - 1]]) if len(stop) else np.zeros(1, dtype=np.int64)
    line_chars = chars_before[word_at + line_words] - chars_before[word_at]
    ratios = [
        share(_IS_SYMBOL, size) * 4, share(_IS_UPPER, letters), share(_IS_DIGIT, size) * 4, share(_IS_MARK, size) * 8,
        share(_IS_LETTER, size), (marked_words[word_at + line_words] - marked_words[word_at]) / np.maximum(line_words, 1),
        (stopped[word_at + line_words] - stopped[word_at]) / np.maximum(line_words, 1),
        line_chars / np.maximum(line_words, 1) / 16, np.log2(line_words + 1) / 8,
    ]
    levels = [np.clip((r * LEVELS).astype(np.int64), 0, LEVELS - 1) + k * LEVELS for k, r in enumerate(ratios)]
    head = np.ones(len(line_start), dtype=np.int64)
    head[1:] = line_text[1:] != line_text[:-1]
    base = RATIOS * LEVELS
    features = np.stack([*levels, base + again, base + 2 + head], axis=1) if len(line_start) else np.zeros((0, RATIOS + 2), dtype=np.int64)
    return {
        "n_words": n_words, "word_chars": chars_before[first_word[1:]] - chars_before[first_word[:-1]],
        "n_symbols": symbol[offsets[1:]] - symbol[offsets[:-1]], "n_dup_lines": duplicates, "n_repeat_words": repeated,
        "lines": lines, "line_words": line_words, "features": features,
    }


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (counts["n_repeat_words"] > MAX_REPEATED * counts["n_words"])


def train_on(labelled: DataFrame, per_label: int = TRAIN_PER_LABEL) -> Crf | None:
    """Field for lines from (doc_id, text, quality): at most ``per_label`` documents of each label.

    A document's label holds for its lines, if the base rules pass it; which documents are taken is decided by a hash.
    """
    ranked = labelled.filter(F.col("quality").isin(0, 1) & F.col("text").isNotNull())
    parts = [ranked.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for q in (0, 1)]
    rows = parts[0].unionAll(parts[1]).select("text", "quality").toArrow()
    if rows.num_rows == 0:
        return None
    text, quality = rows.column("text").combine_chunks(), rows.column("quality").to_numpy()
    features, lengths, labels = [], [], []
    for row, data, offsets in text_chunks(text):
        m = measure(data, offsets)
        features.append(m["features"])
        lengths.append(m["lines"])
        low = np.where(quality[row : row + len(m["lines"])] == 0, BOILERPLATE, CONTENT)
        labels.append(np.repeat(low, m["lines"]))
        # What the base rules reject is not the field's to judge, and its lines may look well.
        heard = np.repeat(~base_failed(m), m["lines"])
        features[-1], labels[-1] = features[-1][heard], labels[-1][heard]
        lengths[-1] = np.where(base_failed(m), 0, m["lines"])
    return train(np.concatenate(features), np.concatenate(lengths), np.concatenate(labels), FEATURES, 2)


def _judge(field: Crf | None):
    schema = pa.schema([
        *[(c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(1)):
                m = measure(data, offsets)
                n = len(offsets) - 1
                content = np.ones(len(m["line_words"]))
                if field is not None:
                    content = (field.decode(m["features"], m["lines"]) == CONTENT).astype(float)
                text_of = np.repeat(np.arange(n), m["lines"])
                share = np.bincount(text_of, weights=content * m["line_words"], minlength=n) / np.maximum(m["n_words"], 1)
                failed = base_failed(m)
                columns = [m[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), *[pa.array(c, pa.int64()) for c in columns],
                     pa.array(failed), pa.array(~failed & (share >= CONTENT_SHARE)), pa.array(share)], schema=schema,
                )

    return releasing(run)


def labelled_texts(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL) -> DataFrame:
    """(doc_id, text, quality) of at most ``per_label`` labelled documents of each label.

    The labels are cut down first, so the join moves a bounded number of ids, not the texts.
    """
    known = labels.select("doc_id", "quality").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for q in (0, 1)]
    return documents(docs).filter(F.octet_length("text") <= TRAIN_TEXT_BYTES).join(F.broadcast(some[0].unionAll(some[1])), "doc_id").select("doc_id", "text", "quality")


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict of every document; ``labels`` (doc_id, quality) train the field."""
    return documents(docs).mapInArrow(_judge(train_on(labelled_texts(docs, labels))), OUT)


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns; nothing is shuffled."""
    field = train_on(labelled_texts(docs, labels))
    judge = _judge(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            bare = pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(text), dtype=np.int64)), text.cast(pa.string()).fill_null("")], names=["doc_id", "text"]
            )
            kept = [k for part in judge(iter([bare])) for k in part.column(7).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(releasing(run), docs.schema)
