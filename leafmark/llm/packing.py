"""Best-fit packing of tokenized documents by the sum-of-squares rule.

Each document is tokenized once, in place, into one row per piece, written with its ids; only
narrow rows without ids are moved for packing, and the ids are joined to the placements. Pieces are dealt at random over groups of bounded size. Within a group, a piece goes
where the sum over all gaps of (number of open bins with that gap) squared becomes smallest,
a new bin included; of a random order and one from large to small the better result counts. Bins that end with a gap are opened again and their pieces
meet those of other groups in a second round. The rule needs many bins of each gap; in the
second round, which has few, the tightest fit from large to small is tried as well.

Defined results: null and empty texts are one piece with the end id only; texts longer than a
sequence are cut, their first piece may be shorter; repeated rows are separate documents, kept
apart by the number the row gets; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafmark.llm.common import documents, released, releasing, staged

LENGTH, END_ID = 2048, 0
#: Pieces per packing group.
GROUP = 60_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
# Fixed value: the vocabulary's only special token.
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def encoder(path: str):
    """Batch encoder of a byte-level BPE file. For its JSON file, the ids of the tokenizers
    library (special tokens in a text are recognised, none added), computed by
    ``byte_bpe.ByteLevelBpe``; a tiktoken rank file as before."""
    if path.endswith(".json"):
        from leafmark.llm.byte_bpe import ByteLevelBpe

        code = ByteLevelBpe(path, special=True)
        return lambda texts: (code.encode(t) for t in texts)
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    code = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return lambda texts: [code.encode(t, allowed_special="all") for t in texts]


def cut(ids: np.ndarray, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; only the first may be shorter than ``length``."""
    first = len(ids) % length or length
    edges = [0, *range(min(first, len(ids)), len(ids) + 1, length)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _pieces(ranks_path: str, length: int, end_id: int):
    narrow = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    schema = narrow.append(pa.field("ids", pa.list_(pa.int32())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(ranks_path)
        for batch in batches:
            rows, every = [], []
            texts = batch.column(1).to_pylist()
            for doc_id, encoded in zip(batch.column(0).to_pylist(), code(texts)):
                ids = np.array([*encoded, end_id], dtype="<u4")
                every.append(ids.view("<i4"))
                for k, (start, n) in enumerate(cut(ids, length)):
                    rows.append((doc_id, k, start, n, zlib.crc32(ids[start:start + n].tobytes())))
            if not rows:
                yield pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)
                continue
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows), narrow)]
            ends = np.cumsum([0, *[r[3] for r in rows]])
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(every))))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return releasing(run)


def tokenized_pieces(docs: DataFrame, ranks_path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece, with its token ids."""
    return documents(docs).mapInArrow(_pieces(ranks_path, length, end_id), f"{PIECES}, ids array<int>")


def sum_of_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, placed one after the other.

    Moving a bin from gap g to gap g - s changes the sum of squares by
    2 (N[g - s] - N[g] + 1); a bin that becomes full leaves it, one that is new enters it.
    """
    open_bins = np.zeros(length + 1, dtype=np.int64)         # by gap
    stacks: list[list[int]] = [[] for _ in range(length + 1)]
    bins, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    n_bins = 0
    never = np.iinfo(np.int64).max // 2
    for k, s in enumerate(sizes.tolist()):
        now = open_bins[s:length]
        cost = np.where(now > 0, 2 * (open_bins[0:length - s] - now + 1), never)
        fresh = 2 * int(open_bins[length - s]) + 1 if s < length else 0
        best = -1
        if len(cost):
            cost[0] = 1 - 2 * int(now[0]) if now[0] > 0 else never
            best = int(cost.argmin())
        if best >= 0 and cost[best] <= fresh:
            gap = s + best
            b = stacks[gap].pop()
            open_bins[gap] -= 1
        else:
            gap, b = length, n_bins
            n_bins += 1
        bins[k], offsets[k] = b, length - gap
        left = gap - s
        if left:
            stacks[left].append(b)
            open_bins[left] += 1
    return bins, offsets


def tightest(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, placed where the smallest gap takes it; for few pieces."""
    open_bins = np.zeros(length + 1, dtype=np.int64)         # by gap
    stacks: list[list[int]] = [[] for _ in range(length + 1)]
    bins, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    n_bins = 0
    for k, s in enumerate(sizes.tolist()):
        gap = s + int((open_bins[s:length] > 0).argmax()) if s < length else length
        if gap < length and open_bins[gap]:
            b = stacks[gap].pop()
            open_bins[gap] -= 1
        else:
            gap, b = length, n_bins
            n_bins += 1
        bins[k], offsets[k] = b, length - gap
        if gap > s:
            stacks[gap - s].append(b)
            open_bins[gap - s] += 1
    return bins, offsets


def _pack_group(length: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ties = ["doc_id", "piece", "ids_crc32"]
        dealt = (["deal", *ties], True)
        falling = (["length", *ties], [False, True, True, True])
        tries = []
        for (keys, up), rule in ((dealt, sum_of_squares), (falling, sum_of_squares), *([(falling, tightest)] if last else [])):
            ordered = rows.sort_values(keys, ascending=up)
            tries.append((ordered, *rule(ordered["length"].to_numpy(), length)))
        ordered, bins, offsets = min(tries, key=lambda t: t[1].max())
        filled = np.bincount(bins, weights=ordered["length"].to_numpy())
        return ordered.assign(bin=bins, offset=offsets, filled=filled[bins].astype("int64"))

    return released(run)


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``pieces`` with sequence_id and offset; a column piece_no is kept, others are not."""
    columns = [c.split()[0] for c in PIECES.split(", ")]
    numbered = ", piece_no long" if "piece_no" in pieces.columns else ""
    columns += ["piece_no"] if numbered else []
    pieces = pieces.select(*columns)
    packed = f"{PIECES}{numbered}, deal long, pack_group long, bin long, offset long, filled long"

    def one_round(rows: DataFrame, n: int, seed: int, last: bool) -> DataFrame:
        groups = max(1, -(-n // group))
        dealt = rows.withColumn("deal", F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(seed)))
        dealt = dealt.withColumn("pack_group", F.pmod("deal", F.lit(groups)))
        return dealt.groupBy("pack_group").applyInPandas(_pack_group(length, last), packed)

    first = staged(one_round(pieces, pieces.count(), 1, False), "packed")
    closed = first.filter(F.col("filled") == F.lit(length))
    loose = first.filter(F.col("filled") < F.lit(length)).select(*columns)
    second = one_round(loose, loose.count(), 2, True)
    number = lambda k: (F.col("pack_group") * 2 + k) * F.lit(1 << 32) + F.col("bin")
    return closed.withColumn("sequence_id", number(0)).unionAll(second.withColumn("sequence_id", number(1))).select(
        *columns, "sequence_id", "offset"
    )


def pack_documents(docs: DataFrame, ranks_path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids of every piece."""
    pieces = tokenized_pieces(docs, ranks_path, length, end_id).withColumn("piece_no", F.monotonically_increasing_id())
    pieces = staged(pieces, "pieces")
    return pack(pieces, length).join(pieces.select("piece_no", "ids"), "piece_no").drop("piece_no")


def _crc32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, ends = ids.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False), np.cumsum([0, *ids.value_lengths().to_pylist()])
        digests = pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends, ends[1:])], pa.int64())
        names = [n for n in batch.schema.names if n != "ids"]
        yield pa.RecordBatch.from_arrays([digests if n == "ids_crc32" else batch.column(n) for n in names], names=names)


def placements(packed: DataFrame) -> DataFrame:
    """``packed`` without its ids; ids_crc32 is computed from them."""
    return packed.mapInArrow(_crc32, packed.drop("ids").schema)
