"""Personal data: base patterns, and a conditional random field that adds spans by word shape.

Only stretches of text around tokens with a digit, an at sign or a plus can hold personal data;
each stretch is a sequence for the field, with the tokens beside it as context. The field reads
word shapes, is trained on a small table (a bounded sample of texts, labelled by the base
patterns), and is decoded by Viterbi in numpy batches. A run of tokens that it gives the same
kind, without those that a base span touches, is divided at token borders into spans that have
the kind's bare necessities; what fits into none is left out.

Defined results: null and empty texts have no spans; repeated rows are searched each; without
texts to train on there are base spans only; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafmark.llm.common import TRAIN_TEXT_BYTES, documents
from leafmark.llm.crf import Crf, train

# The kinds in their order, and the patterns' character classes.
KINDS = ("email", "ip", "card", "phone")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that began inside a run of digits would also begin at the run's first digit.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Most texts that the field is trained on, and its hashed features.
TRAIN_TEXTS, FEATURES = 1500, 1 << 12
BATCH_TOKENS = 50_000
_SIGNAL = re.compile(r"[0-9@+]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = "\"'`.,;:!?()[]{}<>|*#%&$=~"
_SHAPE = [(re.compile(r"[A-Z]"), "A"), (re.compile(r"[a-zß-ɏ]"), "a"), (re.compile(r"[0-9]"), "0")]
_RUN = re.compile(r"(.)\1+")
OUT = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"

Span = tuple[int, int, int]        # kind, start, end


def luhn(digits: str) -> bool:
    """Whether the check digit holds: every second digit from the right doubled, digits summed."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches around each at sign: the run before it, not over the last match, and a domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        # The run before the next at sign cannot reach over this one.
        free = max(free, at + 1)
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """Leftmost matches that do not overlap, per kind; failing ones are dropped, not retried."""
    found: list[Span] = []
    if "@" in text:
        found += [(0, a, b) for a, b in _emails(text)]
    if not _SIGNAL.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def shape(word: str) -> str:
    for pattern, letter in _SHAPE:
        word = pattern.sub(letter, word)
    return word


def stretches(text: str) -> list[list[tuple[str, int, int]]]:
    """Sequences of (token, start, end): those with a signal and the two on either side."""
    if not _SIGNAL.search(text):
        return []
    tokens = []
    for m in _TOKEN.finditer(text):
        bare = m.group().lstrip(_EDGES)
        start = m.end() - len(bare)
        opened = text[start - 1:start] == "(" and start > m.start() and "0" <= bare[:1] <= "9"
        if opened:                                           # an area code keeps its brackets
            bare, start = "(" + bare, start - 1
        bare = bare.rstrip(_EDGES.replace(")", "") if opened else _EDGES)
        tokens.append((bare, start, start + len(bare)))
    marked = [k for k, (w, _, _) in enumerate(tokens) if _SIGNAL.search(w)]
    out: list[list[tuple[str, int, int]]] = []
    last = -1
    for k in marked:
        low, high = max(k - 2, last + 1), min(k + 3, len(tokens))
        if out and low <= last + 1 and k - 2 <= last:
            out[-1].extend(tokens[last + 1:high])
        else:
            out.append(tokens[low:high])
        last = max(last, high - 1)
    return out


def features(sequence: list[tuple[str, int, int]]) -> np.ndarray:
    """Hashed indicators of each token: its shape in full and with runs joined, the shapes beside
    it, its length, its digits and its marks."""
    full = [shape(w[:80]) for w, _, _ in sequence]
    short = [_RUN.sub(r"\1", s) for s in full]
    padded = ["^", "^", *short, "$", "$"]
    rows = []
    for k, (word, _, _) in enumerate(sequence):
        digits = sum("0" <= c <= "9" for c in word)
        marks = "".join(sorted({c for c in word if not c.isalnum()}))
        names = (
            f"f{full[k]}", f"s{short[k]}", f"p{padded[k + 1]}", f"n{padded[k + 3]}", f"pp{padded[k]}{padded[k + 1]}",
            f"sn{short[k]}{padded[k + 3]}", f"ps{padded[k + 1]}{short[k]}", f"d{min(digits, 20)}", f"l{min(len(word), 24)}", f"m{marks[:8]}",
        )
        rows.append([zlib.crc32(n.encode()) % FEATURES for n in names])
    return np.array(rows, dtype=np.int64).reshape(-1, 10)


def train_field(texts: list[str]) -> Crf | None:
    """The small table: tokens of the texts' stretches, labelled 0 or 1 + kind by the base spans."""
    rows, lengths, labels = [], [], []
    for text in texts:
        spans = base_spans(text)
        for sequence in stretches(text):
            rows.append(features(sequence))
            lengths.append(len(sequence))
            labels.extend(next((k + 1 for k, a, b in spans if a < end and start < b), 0) for _, start, end in sequence)
    if not rows:
        return None
    return train(np.concatenate(rows), np.array(lengths), np.array(labels), FEATURES, 1 + len(KINDS))


#: Tokens that one item may have: a card's digits one by one.
LONGEST = 19


def _plausible(kind: int, piece: str) -> bool:
    digits = sum("0" <= c <= "9" for c in piece)
    if kind == 0:
        return "@" in piece[1:-1]
    if kind == 1:
        return piece.count(".") >= 3 and digits >= 4
    return 13 <= digits <= 19 if kind == 2 else 7 <= digits <= 15


def _sub_runs(kind: int, tokens: list[tuple[str, int, int]], text: str) -> list[Span]:
    """A run of one kind as plausible spans at token borders: those that cover most tokens, of
    these the ones with most tokens that are plausible by themselves, of these the fewest."""
    best = [(0, 0, 0)]                                       # covered, by themselves, minus spans
    begins: list[int | None] = [None]
    for end in range(1, len(tokens) + 1):
        score, chosen = best[end - 1], None
        low = max(end - LONGEST, 0)
        for begin in [*range(end - 1, low - 1, -1), *([0] if low and end == len(tokens) else [])]:
            if _plausible(kind, text[tokens[begin][1]:tokens[end - 1][2]]):
                covered, alone, spans = best[begin]
                other = (covered + end - begin, alone + (end - begin == 1), spans - 1)
                if other > score:
                    score, chosen = other, begin
        best.append(score)
        begins.append(chosen)
    found: list[Span] = []
    end = len(tokens)
    while end:
        begin = begins[end]
        if begin is None:
            end -= 1
        else:
            found.append((kind, tokens[begin][1], tokens[end - 1][2]))
            end = begin
    return found[::-1]


def added_spans(text: str, sequences: list[list[tuple[str, int, int]]], labels: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans of tokens that are tagged alike and that no base span touches."""
    found: list[Span] = []
    at = 0
    for sequence in sequences:
        tags = labels[at:at + len(sequence)].tolist()
        at += len(sequence)
        for k, (_, start, stop) in enumerate(sequence):
            if tags[k] and (stop <= start or any(a < stop and start < b for _, a, b in base)):
                tags[k] = 0
        k = 0
        while k < len(sequence):
            end = k + 1
            while end < len(sequence) and tags[end] == tags[k]:
                end += 1
            if tags[k]:
                found.extend(_sub_runs(tags[k] - 1, sequence[k:end], text))
            k = end
    return found


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_spans(texts: list[str], field: Crf | None) -> Iterator[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text; the field decodes many texts' stretches at once."""
    waiting: list[tuple[str, list[Span], list]] = []

    def flush() -> Iterator[tuple[list[Span], list[Span]]]:
        every = [s for _, _, sequences in waiting for s in sequences]
        labels = np.zeros(0, dtype=np.int64)
        if every and field is not None:
            labels = field.decode(np.concatenate([features(s) for s in every]), np.array([len(s) for s in every]))
        at = 0
        for text, base, sequences in waiting:
            n = sum(map(len, sequences))
            added = added_spans(text, sequences, labels[at:at + n], base) if field is not None and n else []
            at += n
            yield base, added
        waiting.clear()

    size = 0
    for text in texts:
        sequences = stretches(text)
        waiting.append((text, base_spans(text), sequences))
        size += 1 + sum(map(len, sequences))
        if size >= BATCH_TOKENS:
            yield from flush()
            size = 0
    yield from flush()


def _report(field: Crf | None):
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [[] for _ in KINDS], [], []
            for base, added in find_spans(batch.column(1).to_pylist(), field):
                for k, column in enumerate(counts):
                    column.append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(base + added))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                schema=schema,
            )

    return run


def find_personal_data(docs: DataFrame, train_texts: int = TRAIN_TEXTS) -> DataFrame:
    """Counts of base spans, their digest, and all spans of every document."""
    rows = documents(docs)
    usable = rows.filter((F.octet_length("text") <= TRAIN_TEXT_BYTES) & F.col("text").rlike("[0-9@+]")).withColumn(
        "draw", F.xxhash64("doc_id", "text"))
    # The draws are chosen first, without texts; then only the chosen texts are read.
    chosen = usable.select("draw").orderBy("draw").limit(train_texts)
    picked = usable.join(F.broadcast(chosen.distinct()), "draw").orderBy("draw", "doc_id", "text").limit(train_texts)
    texts = [r["text"] for r in picked.select("text").collect()]
    return rows.mapInArrow(_report(train_field(texts)), OUT)
