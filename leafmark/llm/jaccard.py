"""N-gram Jaccard join with skipped list blocks and derived answers.

Sets are the distinct word shingles of whole texts, as 64-bit hashes. Equal sets are one class.
A global order puts frequent shingles last; two sets that reach the threshold share one of their
first shingles in that order, and at the first one they share, sizes and positions leave room for
the overlap that is asked for. So only those first shingles are indexed, as lists sorted by size
and position, and whole blocks of a list are skipped if their sizes or positions rule it out.

A pair found in a list is dropped if its first shingles have too few in common: what can follow
them would not be enough. Which sets are connected is then found by comparing sets in full, but
not all of them: each set is compared with the one it shares most first shingles with, and in
long lists with a few pivots; what a set is connected to follows from the set it was found equal
enough to. Only pairs that are still apart after that are compared too, every one of them, so no
connection is lost. Whole sets travel only for those comparisons.

The join's links are then found inside the components, where all of them are: a component is cut
into size classes and these into chunks of bounded size, and every two sets of a chunk, and of two
chunks whose sizes can reach the threshold, are compared in full, each pair in one place. Work and
links grow with the square of a component; no task holds more than two chunks.

Defined results: null and empty texts and texts without words have no shingles and are linked
with nothing; a text with fewer words than a shingle is one shingle; rows that repeat an id are
one document with several sets; rows with a null id are in no component (null), and an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from leafmark.llm.common import documents, releasing, small_batches, staged, tasks
from leafmark.llm.components import connected_components
from leafmark.llm.shingles import each_text, mix, shingle_set
from leafmark.session import staging

#: Frequent shingles that the order puts last: at most so many, counted where a stretch of
#: documents has them so often. They decide only which shingles are listed, never a result.
FREQUENT, STRETCH, AT_LEAST = 1 << 17, 2_000_000, 3
#: Lists up to this length are compared pair by pair; longer ones by pivots first. Shingles
#: counted so often go to the pivots at once, so that no task reads a whole long list.
SHORT_LIST, HOT_SHINGLE, PIVOTS = 16, 512, 5
#: Up to so many ids (8 bytes each) are sent to every task; more are joined by a shuffle.
SENT_IDS = 500_000
#: Rows that go to Python at a time: a row may hold two whole sets.
BATCH_ROWS = 1000

#: Bounds of a chunk whose sets are compared with each other and with those of another chunk.
CHUNK_SHINGLES, CHUNK_SETS = 250_000, 512
#: Blocks are compared as one product of matrices with so many columns at a time.
COLUMNS = 4096

#: Words of the sketch: bit k says whether the number of shingles with hash k is odd, so two
#: sketches differ in no more bits than the sets differ in shingles.
SKETCH_WORDS = 4

INDEX = "doc_id bigint, n bigint, sig_a bigint, sig_b bigint, prefix array<bigint>, hot array<boolean>, sketch array<bigint>"
LINKS = ("class_a bigint, class_b bigint, a bigint, b bigint, n_a bigint, n_b bigint, size_a bigint, size_b bigint, "
         "common bigint")
#: A block: two chunks, c of size class s and d of size class t, of one component.
BLOCK = ("component_id", "s", "c", "t", "d")
_INDEX = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64()),
    ("prefix", pa.list_(pa.int64())), ("hot", pa.list_(pa.bool_())), ("sketch", pa.list_(pa.int64())),
])


def _count_frequent(width: int):
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= AT_LEAST
            return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(counts[often])], schema=schema)

        for batch in batches:
            for data in each_text(batch.column(0)):
                held.append(shingle_set(data, width))
                size += len(held[-1])
                if size >= STRETCH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return releasing(run)


def frequent_shingles(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the most frequent shingles; at most FREQUENT."""
    counted = rows.select("text").mapInArrow(_count_frequent(width), "token bigint, n bigint")
    top = counted.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    tokens, counts = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _signature(tokens: np.ndarray) -> tuple[np.uint64, np.uint64]:
    if not len(tokens):
        return np.uint64(0), np.uint64(0)
    return np.bitwise_xor.reduce(mix(tokens)), mix(tokens + np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)


def _indexed(width: int, percent: int, frequent: np.ndarray, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, sig_a, sig_b, prefix, heat, ends, odd = [], [], [], [], [], [0], []
            for data in each_text(batch.column(1)):
                tokens = shingle_set(data, width)
                n = len(tokens)
                size.append(n)
                for column, value in zip((sig_a, sig_b), _signature(tokens)):
                    column.append(value)
                odd.append(np.packbits(np.bincount((tokens >> np.uint64(56)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1))
                take = n - -(-percent * n // 100) + 1 if n else 0
                at = np.searchsorted(frequent, tokens)
                late = np.zeros(n, dtype=bool)
                if len(frequent):
                    late = frequent[np.minimum(at, len(frequent) - 1)] == tokens
                order = np.concatenate((np.flatnonzero(~late), np.flatnonzero(late)))[:take]
                prefix.append(tokens[order])
                heat.append(late[order] & hot[np.minimum(at[order], max(len(hot) - 1, 0))] if len(hot) else np.zeros(len(order), dtype=bool))
                ends.append(ends[-1] + len(order))
            flat = np.concatenate(prefix).view(np.int64) if prefix else np.zeros(0, dtype=np.int64)
            warm = np.concatenate(heat) if heat else np.zeros(0, dtype=bool)
            offsets = pa.array(ends, pa.int32())
            bits = np.concatenate(odd).view(np.int64) if odd else np.zeros(0, dtype=np.int64)
            fours = pa.array(range(0, len(bits) + 1, SKETCH_WORDS), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(size, pa.int64()), pa.array(np.array(sig_a, dtype=np.uint64).view(np.int64)),
                pa.array(np.array(sig_b, dtype=np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.ListArray.from_arrays(offsets, pa.array(warm)),
                pa.ListArray.from_arrays(fours, pa.array(bits)),
            ], schema=_INDEX)

    return releasing(run)


def _read_lists(percent: int):
    """Pairs of short lists, and the entries of long ones, from entries sorted by (token, n, pos)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("token", pa.int64()), ("n", pa.int64()), ("pos", pa.int64())])
    nothing = np.zeros(0, dtype=np.int64)

    def pairs(node: np.ndarray, n: np.ndarray, pos: np.ndarray, start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # A list is one block: it is skipped if its closest sizes and earliest positions leave no room.
        last = np.repeat(start + length, length)
        room = np.maximum.reduceat(n - pos, start)
        least = -(-2 * percent * n[start] // (100 + percent))
        open_list = np.repeat(room >= least, length)
        at = np.flatnonzero(open_list)
        for step in range(1, SHORT_LIST):
            at = at[at + step < last[at]]
            if not len(at):
                break
            # Sizes ascend within a list, so a pair too far apart ends its first entry's search.
            at = at[100 * n[at] >= percent * n[at + step]]
            other = at + step
            room = np.minimum(n[at] - pos[at], n[other] - pos[other])
            fits = room >= -(-percent * (n[at] + n[other]) // (100 + percent))
            yield node[at[fits]], node[other[fits]]

    def out(a, b, token, n, pos) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, token, n, pos)], schema=schema)

    def entries(columns: list[np.ndarray]) -> pa.RecordBatch:
        token, n, pos, node = columns
        return out(node, pa.nulls(len(node), pa.int64()), token, n, pos)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [nothing] * 4
        flowing: int | None = None                       # the token whose list is known to be long
        for batch in batches:
            columns = [np.concatenate((h, batch.column(k).to_numpy())) for k, h in enumerate(held)]
            held = [nothing] * 4
            if flowing is not None:
                stop = int(np.searchsorted(columns[0], flowing, side="right"))
                if stop:
                    yield entries([c[:stop] for c in columns])
                columns = [c[stop:] for c in columns]
                if not len(columns[0]):
                    continue
                flowing = None
            if not len(columns[0]):
                continue
            cut = int(np.searchsorted(columns[0], columns[0][-1], side="left"))
            if len(columns[0]) - cut > SHORT_LIST:
                flowing = int(columns[0][-1])
                yield entries([c[cut:] for c in columns])
            else:
                held = [c[cut:] for c in columns]
            yield from finish([c[:cut] for c in columns])
        yield from finish(held)

    def finish(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, n, pos, node = columns
        if not len(token):
            return
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        length = np.diff(np.append(start, len(token)))
        long = np.repeat(length > SHORT_LIST, length)
        if long.any():
            yield entries([c[long] for c in columns])
        shared = np.repeat((length > 1) & (length <= SHORT_LIST), length)
        kept = (length > 1) & (length <= SHORT_LIST)
        sizes = length[kept]
        if len(sizes):
            found = list(pairs(node[shared], n[shared], pos[shared], np.cumsum(sizes) - sizes, sizes))
            if found:
                a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                empty = pa.nulls(len(a), pa.int64())
                yield out(np.minimum(a, b), np.maximum(a, b), empty, empty, empty)

    return releasing(run)


def _sets(width: int):
    schema = pa.schema([("node", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [shingle_set(data, width).tobytes() for data in each_text(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.binary())], schema=schema)

    return releasing(run)


def _signed_sets(width: int):
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(data, width) for data in each_text(batch.column(1))]
            first, second = zip(*map(_signature, sets)) if sets else ((), ())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.array(first, dtype=np.uint64).view(np.int64)),
                pa.array(np.array(second, dtype=np.uint64).view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary()),
            ], schema=schema)

    return releasing(run)


def _common(left: list[np.ndarray], right: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Shingles that each set on the left has in common with each on the right; only where ``wanted``."""
    common = np.zeros(wanted.shape, dtype=np.int64)
    sides = [np.concatenate(left), np.concatenate(right)]
    tokens = np.intersect1d(*[np.unique(s) for s in sides], assume_unique=True)
    if not len(tokens):
        return common
    pairs = int(wanted.sum())
    # Both costs in rough nanoseconds.
    if pairs * (10_000 + 50 * min(map(len, sides)) // max(1, min(len(left), len(right)))) < wanted.size * len(tokens) // 4 + 200_000:
        for i, j in zip(*np.nonzero(wanted)):
            x, y = (left[i], right[j]) if len(left[i]) <= len(right[j]) else (right[j], left[i])
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            common[i, j] = int((y[at] == x).sum())
        return common
    places = []
    for flat, sets in zip(sides, (left, right)):
        at = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
        known = tokens[at] == flat
        places.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[known], at[known]))
    for begin in range(0, len(tokens), COLUMNS):
        has = []
        for (row, column), sets in zip(places, (left, right)):
            inside = (column >= begin) & (column < begin + COLUMNS)
            has.append(np.zeros((len(sets), min(COLUMNS, len(tokens) - begin)), dtype=np.float32))
            has[-1][row[inside], column[inside] - begin] = 1
        common += (has[0] @ has[1].T).astype(np.int64)
    return common


def _block_links(percent: int):
    """The links of each block, from rows sorted by block, side and class."""
    schema = pa.schema([(c.split()[0], pa.int64()) for c in LINKS.split(", ")])

    def links(block: pa.Table) -> np.ndarray:
        right, number, node, n, size = (block.column(c).to_numpy() for c in ("right", "class_no", "node", "n", "size"))
        # A row that is repeated with its id brings its set twice.
        once = np.flatnonzero(np.concatenate(([True], (number[1:] != number[:-1]) | (right[1:] != right[:-1]))))
        sets = block.column("tokens").combine_chunks()
        ends = (once[right[once] == 0], once[right[once] == 1])
        alone = block.column("s")[0] == block.column("t")[0] and block.column("c")[0] == block.column("d")[0]
        left, other = ends[0], ends[0] if alone else ends[1]
        if not len(left) or not len(other):
            return np.zeros((len(schema), 0), dtype=np.int64)
        wanted = 100 * np.minimum.outer(n[left], n[other]) >= percent * np.maximum.outer(n[left], n[other])
        wanted &= node[left][:, None] != node[other][None, :]
        if alone:
            wanted &= np.tri(len(left), k=-1, dtype=bool).T
        if not wanted.any():
            return np.zeros((len(schema), 0), dtype=np.int64)
        held = {k: np.frombuffer(sets[k].as_buffer(), dtype=np.uint64) for k in {*left.tolist(), *other.tolist()}}
        common = _common([held[k] for k in left.tolist()], [held[k] for k in other.tolist()], wanted)
        both = n[left][:, None] + n[other][None, :] - common
        i, j = np.nonzero(wanted & (100 * common >= percent * both))
        a, b = left[i], other[j]
        a, b = np.where(node[a] < node[b], a, b), np.where(node[a] < node[b], b, a)
        return np.stack([number[a], number[b], node[a], node[b], n[a], n[b], size[a], size[b], common[i, j]])

    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(found, axis=1)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        before = None
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in BLOCK])
            starts = (1 + np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))).tolist()
            if before is not None and (keys[:, 0] != before).any():
                starts.insert(0, 0)
            found, at = [], 0
            for start in starts:
                found.append(links(pa.Table.from_batches([*held, batch.slice(at, start - at)])))
                held, at = [], start
            held.append(batch.slice(at))
            before = keys[:, -1]
            if found:
                yield out(found)
        if held:
            yield out([links(pa.Table.from_batches(held))])

    return releasing(run)


def _compare(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (left, right))
                if len(x) > len(y):
                    x, y = y, x
                if not len(x):
                    linked.append(False)
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=schema)

    return releasing(run)


def _sketches_fit(n: str, m: str, one: str, other: str, percent: int) -> Column:
    """The sketches differ in no more bits than sets that reach the threshold could differ in."""
    bits = sum((F.bit_count(F.get(one, F.lit(k)).bitwiseXOR(F.get(other, F.lit(k)))) for k in range(SKETCH_WORDS)), F.lit(0))
    both = F.col(n) + F.col(m)
    return bits <= both - 2 * F.ceil(F.lit(percent) * both / F.lit(100 + percent))


def _plausible(pairs: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """``pairs`` with `common`, the first shingles both have, where that is enough.

    Up to the end of the list part that ends first, all common shingles are among the first
    ones of both; beyond it, no more than what that set has left can be common. The sketches
    must not differ too much either; they are compared first, from narrow rows, so that first
    shingles travel only for pairs that pass, and only those of the sets in such pairs.
    """
    kept = pairs.columns
    for end in ("a", "b"):
        pairs = pairs.join(firsts.select(F.col("node").alias(end), F.col("class_no").alias(f"class_{end}"), F.col("n").alias(f"n_{end}"),
                                         F.col("sketch").alias(f"sketch_{end}")), end)
    near = staged(pairs.filter(_sketches_fit("n_a", "n_b", "sketch_a", "sketch_b", percent)).drop("sketch_a", "sketch_b"), "near-pairs")
    wanted = staged(near.select(F.explode(F.array("class_a", "class_b")).alias("class_no")).distinct(), "wanted")
    if wanted.count() <= SENT_IDS:
        wanted = F.broadcast(wanted)
    lists = firsts.join(wanted, "class_no", "leftsemi")
    for end in ("a", "b"):
        near = near.join(lists.select(F.col("class_no").alias(f"class_{end}"), F.col("prefix").alias(f"first_{end}")), f"class_{end}")
    left = F.greatest(*[F.col(f"n_{x}") - F.size(f"first_{x}") for x in "ab"])
    least = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent))
    return near.withColumn("common", F.size(F.array_intersect("first_a", "first_b"))).filter(F.col("common") + left >= least).select(
        *kept, "common"
    )


def _linked(pairs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold; b may be frequent, its set then travels."""
    with staging() as used:
        wanted = staged(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
        if wanted.count() <= SENT_IDS:
            wanted = F.broadcast(wanted)
        sets = staged(rows.join(wanted, "doc_id", "leftsemi").mapInArrow(_sets(width), "node bigint, tokens binary"), "sets")
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("right"))
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("left"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")
    links = staged(both.mapInArrow(_compare(percent), "a bigint, b bigint"), "links").distinct()
    used.drop(rows.sparkSession)
    return links


def _size_class(n: Column, percent: int) -> Column:
    """Sets of two classes that do not touch differ too much in size (with room for rounding)."""
    return F.floor(F.log(n.cast("double")) / F.lit(float(np.log(100 / percent)) * (1 + 1e-9))).cast("int")


def _fits(n: str, pos: str, m: str, spot: str, percent: int) -> Column:
    """Sizes and positions of a shared shingle leave room for the overlap asked for."""
    n, pos, m, spot = F.col(n), F.col(pos), F.col(m), F.col(spot)
    least = F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(n - pos, m - spot) >= least)


def _pivot_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Each entry of a long list with the pivots of its block and the blocks beside it."""
    blocks = entries.withColumn("class", _size_class(F.col("n"), percent))
    chosen = blocks.groupBy("token", "class").agg(*[
        F.min_by(F.struct("node", "n", "pos"), F.xxhash64("node", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)
    ])
    pivots = chosen.select(
        "token", "class", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))).alias("p")
    ).select(
        "token", F.explode(F.array(*[F.col("class") + k for k in (-1, 0, 1)])).alias("class"),
        F.col("p.node").alias("b"), F.col("p.n").alias("m"), F.col("p.pos").alias("spot"),
    )
    met = blocks.join(pivots, ["token", "class"]).filter((F.col("node") != F.col("b")) & _fits("n", "pos", "m", "spot", percent))
    return met.select(F.col("node").alias("a"), "b").distinct()


def _apart_pairs(entries: DataFrame, labels: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """Pairs of long lists that are not connected yet: entries outside of their list's largest
    component, with all entries of their block and the blocks beside it."""
    known = entries.join(labels, "node", "left").join(firsts.select("node", "sketch"), "node").withColumns({
        "label": F.coalesce("component", "node"), "class": _size_class(F.col("n"), percent),
    }).drop("component")
    known = staged(known, "list-entries")
    sizes = known.groupBy("token", "label").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("token").agg(F.max_by("label", F.struct("size", "label")).alias("largest"), F.count(F.lit(1)).alias("labels"))
    outside = known.join(largest.filter("labels > 1"), "token").filter("label <> largest").select(
        "token", F.explode(F.array(*[F.col("class") + k for k in (-1, 0, 1)])).alias("class"), F.col("node").alias("a"),
        F.col("n").alias("m"), F.col("pos").alias("spot"), F.col("label").alias("other"), "largest",
        F.col("sketch").alias("drawn"),
    )
    met = known.join(outside, ["token", "class"]).filter(
        (F.col("label") != F.col("other")) & ((F.col("label") == F.col("largest")) | (F.col("node") < F.col("a")))
        & _fits("n", "pos", "m", "spot", percent) & _sketches_fit("n", "m", "sketch", "drawn", percent)
    )
    return met.select("a", F.col("node").alias("b")).distinct()


class Joined(NamedTuple):
    """``links``: class_a, class_b, a, b, n_a, n_b, size_a, size_b, common; every two classes of
    equal sets that reach the threshold, once, with their smallest ids a < b, set sizes, rows, and
    the shingles both have. ``members``: one row per row of the documents: doc_id, n_shingles,
    component_id, class_no (rows of one class are linked too; null without shingles or id), and
    n_links, the other rows that the row is linked with."""

    links: DataFrame
    members: DataFrame


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> Joined:
    """All links between rows of ``docs``, and what they connect.

    Documents are linked if the shingle sets' Jaccard similarity is at least ``percent`` / 100.
    """
    with small_batches(docs.sparkSession, BATCH_ROWS):
        rows = documents(docs, id_col, text_col)
        index, classes = _connected(rows, width, percent)
    with small_batches(docs.sparkSession, BATCH_ROWS // 4):
        links = _all_links(rows, classes, width, percent)
    linked = links.groupBy(F.col("class_a").alias("class_no")).agg(F.sum("size_b").alias("k")).unionAll(
        links.groupBy(F.col("class_b").alias("class_no")).agg(F.sum("size_a").alias("k"))
    ).groupBy("class_no").agg(F.sum("k").alias("others"))
    found = _members(index, classes.join(linked, "class_no", "left"), "class_no", "size", "others")
    return Joined(links, found.select(
        "doc_id", "n_shingles", "component_id", "class_no",
        F.when(F.col("class_no").isNull(), 0).otherwise(F.col("size") - 1 + F.coalesce("others", F.lit(0))).cast("bigint").alias("n_links"),
    ))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id; without the table of links."""
    with small_batches(docs.sparkSession, BATCH_ROWS):
        return _members(*_connected(documents(docs, id_col, text_col), width, percent))


def _members(index: DataFrame, classes: DataFrame, *more: str) -> DataFrame:
    keys = ["sig_a", "sig_b", "n"]
    there = F.col("doc_id").isNotNull()
    found = index.select("doc_id", *keys).join(classes.select(*keys, "component_id", *more), keys, "left")
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(there, F.coalesce("component_id", "doc_id")).alias("component_id"),
        *[F.when(there, F.col(c)).alias(c) for c in more],
    )


def _all_links(rows: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    parts = lambda: F.greatest(F.ceil(F.sum("n") / F.lit(CHUNK_SHINGLES)), F.ceil(F.count(F.lit(1)) / F.lit(CHUNK_SETS)))
    whole = classes.groupBy("component_id").agg(F.count(F.lit(1)).alias("n_classes"), (parts() <= 1).alias("small")).filter("n_classes > 1")
    # A component that fits into one chunk is not cut.
    cut = staged(classes.join(whole, "component_id").withColumn("s", F.when(F.col("small"), 0).otherwise(_size_class(F.col("n"), percent))).select(
        "component_id", "s", "class_no", "node", "n", "sig_a", "sig_b", "size"
    ), "cut-classes")
    near = Window.partitionBy("component_id").orderBy("s")
    chunks = cut.groupBy("component_id", "s").agg(parts().cast("int").alias("k"))
    for name, beside, step in (("k_below", F.lag, -1), ("k_above", F.lead, 1)):
        chunks = chunks.withColumn(name, F.when(beside("s").over(near) == F.col("s") + step, beside("k").over(near)).otherwise(0))
    wanted = cut.select(F.col("node").alias("doc_id")).distinct()
    if wanted.count() <= SENT_IDS:
        wanted = F.broadcast(wanted)
    sets = rows.join(wanted, "doc_id", "leftsemi").mapInArrow(_signed_sets(width), "node bigint, n bigint, sig_a bigint, sig_b bigint, tokens binary")
    dealt = cut.join(chunks, ["component_id", "s"]).withColumn("c", F.expr("CAST(pmod(xxhash64(class_no), k) AS INT)"))
    with staging() as used:
        dealt = staged(sets.join(dealt, ["node", "n", "sig_a", "sig_b"]).drop("sig_a", "sig_b"), "chunks")
    named = "named_struct('s', {}, 'c', {}, 't', {}, 'd', {}, 'right', {})"
    places = ", ".join(f"transform(filter(sequence(0, {k}), x -> x < {k}), x -> {named.format(*block)})" for k, *block in (
        ("k", "s", "least(c, x)", "s", "greatest(c, x)", "IF(x < c, 1, 0)"),
        ("k_above", "s", "c", "s + 1", "x", "0"), ("k_below", "s - 1", "x", "s", "c", "1"),
    ))
    blocks = dealt.select("component_id", "class_no", "node", "n", "size", "tokens", F.explode(F.expr(f"concat({places})")).alias("at")).select(
        "component_id", "at.*", "class_no", "node", "n", "size", "tokens"
    )
    sorted_blocks = blocks.repartition(4 * tasks(rows.sparkSession), *BLOCK).sortWithinPartitions(*BLOCK, "right", "class_no")
    links = staged(sorted_blocks.mapInArrow(_block_links(percent), LINKS), "all-links")
    used.drop(rows.sparkSession)
    return links


def _connected(rows: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows' index, and every class of equal sets with its number, rows, smallest id and component."""
    spark = rows.sparkSession
    frequent, counts = frequent_shingles(rows, width)
    there = "n > 0 AND doc_id IS NOT NULL"
    # Tables with sets or first shingles are dropped once what follows from them is written.
    with staging() as first_index:
        whole = staged(rows.mapInArrow(_indexed(width, percent, frequent, counts >= HOT_SHINGLE), INDEX), "shingle-index")
    with staging() as first_sets:
        classes = staged(whole.filter(there).groupBy("sig_a", "sig_b", "n").agg(
            F.min_by(F.struct("prefix", "hot", "sketch"), "doc_id").alias("set"), F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("size")
        ).withColumn("class_no", F.monotonically_increasing_id()), "shingle-sets")
    index = staged(whole.select("doc_id", "n", "sig_a", "sig_b"), "signatures")
    first_index.drop(spark)
    usable = index.filter(there)
    entries = classes.select("node", "n", F.posexplode(F.arrays_zip("set.prefix", "set.hot")).alias("pos", "e")).select(
        F.col("e.prefix").alias("token"), "n", F.col("pos").cast("bigint").alias("pos"), "node", F.col("e.hot").alias("hot")
    )
    lists = entries.filter("NOT hot").drop("hot").repartition(4 * tasks(spark), "token").sortWithinPartitions("token", "n", "pos", "node")
    read = staged(lists.mapInArrow(_read_lists(percent), "a bigint, b bigint, token bigint, n bigint, pos bigint"), "lists")
    long = staged(
        read.filter("b IS NULL").select("token", "n", "pos", F.col("a").alias("node"))
        .unionAll(entries.filter("hot").select("token", "n", "pos", "node")), "long-lists",
    )
    firsts = classes.select("class_no", "node", "n", F.col("set.prefix").alias("prefix"), F.col("set.sketch").alias("sketch"))
    met = read.filter("b IS NOT NULL").select("a", "b").distinct().withColumn("pivot", F.lit(False)).unionAll(
        _pivot_pairs(long, percent).withColumn("pivot", F.lit(True))
    )
    pairs = staged(_plausible(met, firsts, percent), "pairs")
    # First each set with the one it shares most with, and with pivots; then what is still apart.
    nearest = pairs.groupBy("b").agg(F.max_by("a", F.struct("common", "a")).alias("a")).select("a", "b")
    first = _linked(staged(nearest.unionAll(pairs.filter("pivot").select("a", "b")).distinct(), "first-pairs"), rows, width, percent)
    # An id whose rows have different sets connects these.
    several = usable.groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("sig_a", "sig_b")]).filter(
        "min_sig_a <> max_sig_a OR min_sig_b <> max_sig_b"
    )
    same_id = usable.select("doc_id", "sig_a", "sig_b", "n").join(several, "doc_id", "leftsemi").join(
        classes.select("sig_a", "sig_b", "n", "node"), ["sig_a", "sig_b", "n"]
    ).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    labels = staged(connected_components(first.unionAll(same_id)), "labels")
    named = pairs.select("a", "b")
    for end in ("a", "b"):
        named = named.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_label")), end, "left")
    apart = named.filter(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")
    more = _plausible(_apart_pairs(long, labels, firsts, percent), firsts, percent).select("a", "b")
    second = _linked(staged(apart.unionAll(more).distinct(), "second-pairs"), rows, width, percent)
    components = staged(connected_components(
        second.unionAll(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
    ), "components")
    found = staged(classes.select("class_no", "sig_a", "sig_b", "n", "node", "size").join(components, "node", "left").withColumn(
        "component_id", F.coalesce("component", "node")
    ).drop("component"), "class-components")
    first_sets.drop(spark)
    return index, found


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest; rows without id stay."""
    judged = jaccard_components(docs, width, percent).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(judged, "doc_id", "leftanti").select(*[F.col(f"`{c}`") for c in docs.columns])
