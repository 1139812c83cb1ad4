"""Cross-tokenizer alignment: which tokens of one vocabulary cover the same bytes as which of another.

Every text is tokenized twice: by a byte-level BPE file (``tokenizers``, the text with a space in
front) and by a SentencePiece file (which puts the space in front itself). Both tokenizations
cover the same bytes, so wherever a token of each ends at one byte offset, the two sequences can
be cut. The pieces between cuts are groups; the A and B tokens of a group are linked pairwise.

Groups are found by pointer jumping, vectorised over a document's tokens: every token points to
the overlapping token that reaches farthest right (a B token where both end together). Following
pointers only moves right and stops at the B token that ends its group; repeated doubling
(``p = p[p]``) takes every token there in O(log n) array steps. The terminal labels the group.

On Spark: one pass of Arrow batches tokenizes and groups, and writes per document the counts, the
group string and the document's distinct linked id pairs with their multiplicity; the pair table
is aggregated corpus-wide (partial aggregation on the map side, so a pair that every document holds
is still one row per task), and joined back to each document's pairs to give ``n_best`` and
``count_sum``. That join keeps the big side where it is skewed (a pair such as `` the``/``▁the``
in most documents) and relies on adaptive skew-join splitting, which ``leafmark.session.tune``
turns on.

Defined results: a null, empty or otherwise unmatched text (joined token bytes of either file are
not exactly space + text, for example because SentencePiece met an unknown character) has no
tokens: all counts 0 and ``groups`` ''. Every row is a document: repeated rows and null ``doc_id``
are kept and each counts once in corpus-wide pair counts. Extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from leafmark.llm.byte_bpe import ByteLevelBpe, byte_level_table
from leafmark.llm.common import documents, hidden, releasing, small_batches, staged

#: Groups with at most this many occurrence pairs are expanded pair by pair; larger ones by distinct ids.
SMALL_GROUP = 64

#: Documents handed to Python at a time.
BATCH_ROWS = 256

#: Ids of a pair are folded into one 32-bit key: a * PAIR_BASE + b (A ids are below 2**16, B ids below 2**15).
PAIR_BASE = 1 << 15

_OUT = T.StructType([
    T.StructField("rk", T.LongType()), T.StructField("doc_id", T.LongType()),
    T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()),
    T.StructField("n_groups", T.LongType()), T.StructField("n_links", T.LongType()),
    T.StructField("groups", T.StringType()), T.StructField("groups_sha256", T.StringType()),
    T.StructField("pair_keys", T.ArrayType(T.IntegerType())), T.StructField("pair_mult", T.ArrayType(T.IntegerType())),
])

_ARROW = pa.schema([("rk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("groups_sha256", pa.string()),
                    ("pair_keys", pa.list_(pa.int32())), ("pair_mult", pa.list_(pa.int32()))])

_models: dict[tuple[str, str], tuple] = {}


def piece_bytes(piece: str) -> bytes:
    """A SentencePiece piece as bytes: U+2581 is a space, ``<0xHH>`` is byte HH."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode("utf-8")


def load(a_file: str, b_file: str):
    """Both tokenizers and every id's bytes, once per Python worker."""
    key = (a_file, b_file)
    if key not in _models:
        # Each task is one core's work; the tokenizer's own thread pool would only contend.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(a_file)
        a.encode_special_tokens = True
        table = byte_level_table()
        a_bytes = [b""] * a.get_vocab_size(with_added_tokens=True)
        for token, i in a.get_vocab(with_added_tokens=True).items():
            a_bytes[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        a = ByteLevelBpe(a_file, library=a)
        b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        b_bytes = [piece_bytes(b.id_to_piece(i)) for i in range(b.get_piece_size())]
        _models[key] = (a, b, a_bytes, np.array([len(x) for x in a_bytes], np.int64),
                        b_bytes, np.array([len(x) for x in b_bytes], np.int64))
    return _models[key]


def group_labels(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group number of every A and every B token by pointer jumping; and the number of groups.

    Both length arrays cover the same bytes. Tokens 0..na-1 are A's, na.. are B's.
    """
    na, nb = len(a_len), len(b_len)
    ea, eb = np.cumsum(a_len), np.cumsum(b_len)
    # An A token points to the B token over its last byte: that one ends at or after it.
    point_a = na + np.searchsorted(eb, ea, "left")
    # A B token points to the A token over its last byte, or to itself where both end there.
    k = np.searchsorted(ea, eb, "left")
    point_b = np.where(ea[k] == eb, na + np.arange(nb), k)
    p = np.concatenate([point_a, point_b])
    while True:
        q = p[p]
        if np.array_equal(q, p):
            break
        p = q
    # Terminals point to themselves; counted from the left they number the groups.
    number = np.cumsum(p == np.arange(na + nb)) - 1
    label = number[p]
    return label[:na], label[na:], int(number[-1]) + 1


_SPELLED: dict[str, np.ndarray] = {}


def _spelled(n: int, sep: str) -> np.ndarray:
    """Decimal spellings of 0..n-1 (at least), each followed by ``sep``, kept per worker."""
    if len(_SPELLED.get(sep, ())) < n:
        _SPELLED[sep] = np.array([f"{i}{sep}" for i in range(max(n, 65536))], dtype=object)
    return _SPELLED[sep]


def _groups_text(a_ids: np.ndarray, b_ids: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3`` built as one interleaved array of ids with their separators."""
    out = np.empty(len(a_ids) + len(b_ids), dtype=object)
    for ids, place, last, end in (
        (a_ids, np.arange(len(a_ids)) + cut_b[ga], cut_a[1:] - 1, "|"),
        (b_ids, np.arange(len(b_ids)) + cut_a[gb + 1], cut_b[1:] - 1, ";"),
    ):
        n = int(ids.max()) + 1
        out[place] = _spelled(n, ",")[ids]
        out[place[last]] = _spelled(n, end)[ids[last]]
    return "".join(out.tolist())[:-1]


def align_one(text: str, model, a_ids=None, b_ids=None) -> tuple:
    """(n_a, n_b, n_groups, n_links, groups string, pair keys, multiplicities) of one text; the
    ids may be given when they were encoded in a batch."""
    a, b, a_bytes, a_lens, b_bytes, b_lens = model
    empty = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not text:
        return empty
    want = (" " + text).encode("utf-8")
    a_ids = np.asarray(a.encode(" " + text) if a_ids is None else a_ids, np.int64)
    b_ids = np.asarray(b.encode(text) if b_ids is None else b_ids, np.int64)
    if b"".join(map(a_bytes.__getitem__, a_ids.tolist())) != want or b"".join(map(b_bytes.__getitem__, b_ids.tolist())) != want:
        return empty
    ga, gb, n_groups = group_labels(a_lens[a_ids], b_lens[b_ids])
    size_a, size_b = np.bincount(ga, minlength=n_groups), np.bincount(gb, minlength=n_groups)
    cut_a, cut_b = np.concatenate([[0], np.cumsum(size_a)]), np.concatenate([[0], np.cumsum(size_b)])
    groups = _groups_text(a_ids, b_ids, cut_a, cut_b, ga, gb)
    # Linked pairs of the document with their multiplicity. Small groups: every occurrence pair,
    # vectorised; large groups (long runs without a common end): distinct ids of each side with
    # their counts, so that only distinct id pairs are formed.
    prod = size_a * size_b
    small = prod <= SMALL_GROUP
    rep = np.repeat(np.flatnonzero(small), prod[small])
    start = np.repeat(np.cumsum(prod[small]) - prod[small], prod[small])
    within = np.arange(len(rep)) - start
    row, col = np.divmod(within, size_b[rep])
    small_keys = (a_ids[cut_a[rep] + row] * PAIR_BASE + b_ids[cut_b[rep] + col]).astype(np.int32)
    small_keys, small_mult = np.unique(small_keys, return_counts=True)
    if small.all():
        return (len(a_ids), len(b_ids), n_groups, int(prod.sum()), groups, small_keys, small_mult)
    keys, mults = [small_keys], [small_mult]
    for g in np.flatnonzero(~small):
        ua, ca = np.unique(a_ids[cut_a[g]:cut_a[g + 1]], return_counts=True)
        ub, cb = np.unique(b_ids[cut_b[g]:cut_b[g + 1]], return_counts=True)
        keys.append((ua[:, None] * PAIR_BASE + ub[None, :]).ravel())
        mults.append((ca[:, None] * cb[None, :]).ravel())
    every, mult = np.concatenate(keys), np.concatenate(mults)
    keys, where = np.unique(every, return_inverse=True)
    mult = np.bincount(where, weights=mult, minlength=len(keys)).astype(np.int64)
    return (len(a_ids), len(b_ids), n_groups, int(prod.sum()), groups, keys, mult)


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    values = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def _align_batches(a_file: str, b_file: str, keep_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(a_file, b_file)
        a, b = model[0], model[1]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            some = [k for k, t in enumerate(texts) if t]
            b_enc = b.encode([texts[k] for k in some], num_threads=1)
            ids = {k: (a.encode(" " + texts[k]), y) for k, y in zip(some, b_enc)}
            del b_enc
            rows = [align_one(t, model, *ids.pop(k, (None, None))) for k, t in enumerate(texts)]
            cols = list(zip(*rows)) if rows else [[]] * 7
            digests = [groups_digest(g) for g in cols[4]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rk"), batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:4]],
                 pa.array(cols[4] if keep_groups else [None] * len(rows), pa.string()), pa.array(digests, pa.string()),
                 _list_array(list(cols[5])), _list_array(list(cols[6]))],
                schema=_ARROW)
    return releasing(run)


def align_tokens(docs: DataFrame, a_file: str, b_file: str, keep_groups: bool = True) -> DataFrame:
    """Per document row: rk (row key), doc_id, n_a, n_b, n_groups, n_links, groups
    (``a1,a2|b1;a3|b2,b3``; null unless ``keep_groups``), groups_sha256 ('' without tokens),
    and its distinct linked pairs (``pair_keys`` = a * PAIR_BASE + b, ``pair_mult`` = occurrence
    pairs). Written once, since two later steps read it."""
    rows = documents(docs).withColumn("rk", F.monotonically_increasing_id())
    with small_batches(docs.sparkSession, BATCH_ROWS):
        return staged(rows.mapInArrow(_align_batches(a_file, b_file, keep_groups), _OUT), "alignment")


def alignment_report(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per document row.

    A pair's count is the number of document rows in which it is linked. ``n_best`` counts the
    links whose pair count is the highest of all pairs with the same A id (ties included);
    ``count_sum`` adds the pair counts over all links."""
    per = align_tokens(docs, a_file, b_file, keep_groups=False)
    key, mult, docs_n, top = hidden("key"), hidden("mult"), hidden("docs"), hidden("top")
    linked = per.select("rk", F.explode(F.arrays_zip(F.col("pair_keys").alias("k"), F.col("pair_mult").alias("m"))).alias("p")) \
        .select("rk", F.col("p.k").alias(key), F.col("p.m").alias(mult))
    counts = linked.groupBy(key).agg(F.count(F.lit(1)).alias(docs_n))
    a_of = F.shiftright(F.col(key), PAIR_BASE.bit_length() - 1)
    best = counts.groupBy(a_of.alias("a")).agg(F.max(docs_n).alias(top))
    counts = counts.join(best, a_of == F.col("a")).select(key, docs_n, (F.col(docs_n) == F.col(top)).alias("best"))
    sums = linked.join(counts, key).groupBy("rk").agg(
        F.sum(F.col(mult) * F.col(docs_n)).alias("count_sum"),
        F.sum(F.when(F.col("best"), F.col(mult)).otherwise(0)).alias("n_best"))
    return per.join(sums, "rk", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
        "groups_sha256",
    )


def groups_digest(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""
