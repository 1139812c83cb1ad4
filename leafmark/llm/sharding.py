"""Even shards by sampled splitters.

Every record gets a position key: high bits from a hash of its text, so equal texts lie side
by side, low bits from a hash of its id. A sample in proportion to size gives quantiles of
that key, which become the splitters of fine ranges. Running sizes within the ranges, on top
of the total of the ranges before, place each record exactly; where a range is overfull it is
simply cut at the next shard boundary. Groups of equal texts stay in one shard if they are
small against a shard, larger ones are cut.

Defined results: null text has no bytes; rows repeat freely and each gets a slot of its own;
ties of the key are broken by id. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leafmark.llm.common import documents, staged

ROW_OVERHEAD = 16
#: Sampled records that splitters are taken from, and fine ranges per shard.
SAMPLE, RANGES_PER_SHARD = 100_000, 16
#: Low bits of the key that come from the id, so that a hot text can be cut anywhere.
ID_BITS = 20
#: Groups up to this part of a shard stay together.
WHOLE_GROUP = 0.01


def _range_of(key: Column, splitters: list[int]) -> Column:
    """Number of splitters up to the key: first among every w-th of them, then within that stretch."""
    width = max(1, int(len(splitters) ** 0.5))
    coarse = splitters[width - 1::width]
    bounds = F.array(*[F.lit(x).cast("bigint") for x in splitters]) if splitters else F.array().cast("array<bigint>")
    heads = F.array(*[F.lit(x).cast("bigint") for x in coarse]) if coarse else F.array().cast("array<bigint>")
    stretch = F.size(F.filter(heads, lambda b: b <= key)) * F.lit(width)
    return stretch + F.size(F.filter(F.slice(bounds, stretch + 1, width), lambda b: b <= key))


def _splitters(keyed: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantiles of the key, weighted by size, from about SAMPLE draws.

    A record is drawn size / step times, the fraction decided by a hash: the same draws in
    every run. A splitter inside a group that no other splitter cuts moves to its start.
    """
    step = max(1.0, total / SAMPLE)
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("draw")), 11) / F.lit(float(1 << 53))
    drawn = keyed.select("key", F.floor(F.col("size") / F.lit(step) + unit).alias("draws")).filter("draws > 0")
    cuts = [k / ranges for k in range(1, ranges)]
    found = drawn.agg(F.percentile("key", F.array(*[F.lit(c) for c in cuts]), F.col("draws")).alias("cuts")).first()["cuts"]
    exact = sorted(int(x) for x in found or [])
    groups = [x >> ID_BITS for x in exact]
    return sorted({
        x if groups.count(g) > 1 else g << ID_BITS for x, g in zip(exact, groups)
    })


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per record: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: law is `bytes`)."""
    mask = (1 << ID_BITS) - 1
    raw = documents(docs, id_col, text_col)
    keyed = staged(raw.select(
        "doc_id", (F.octet_length("text") + ROW_OVERHEAD).cast("bigint").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        F.xxhash64("text").bitwiseAND(F.lit(~mask)).bitwiseOR(F.xxhash64("doc_id").bitwiseAND(F.lit(mask))).alias("key"),
    ), "shard-keys")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    capacity = max(1.0, total / shards)
    ranged = keyed.withColumns({
        "range": _range_of(F.col("key"), _splitters(keyed, total, shards * RANGES_PER_SHARD)),
        "group": F.shiftright("key", ID_BITS),
    })
    totals = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    # As many rows as there are ranges: one ordered pass gives what lies before each.
    so_far = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("range").alias("o_range"), F.coalesce(F.sum("bytes").over(so_far), F.lit(0)).alias("bytes_before"),
    )
    line = Window.partitionBy("range").orderBy("key", "doc_id", "size", "text_crc32")
    group = Window.partitionBy("range", "group")
    placed = ranged.withColumns({
        "end": F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "row": F.row_number().over(line),
    }).withColumns({"group_bytes": F.sum("size").over(group), "group_start": F.min(F.col("end") - F.col("size")).over(group)})
    whole = F.col("group_bytes") <= F.lit(WHOLE_GROUP * capacity)
    middle = F.when(whole, F.col("group_start") + F.col("group_bytes") / 2).otherwise(F.col("end") - F.col("size") / 2)
    position = F.col("bytes_before") + middle
    placed = staged(placed.join(F.broadcast(offsets), F.col("range") == F.col("o_range")).select(
        "doc_id", "size", "text_crc32", "range", "row",
        F.least(F.floor(position / F.lit(capacity)), F.lit(shards - 1)).cast("int").alias("shard"),
    ), "shard-places")
    # Rows of a shard in a range are consecutive there; shards and ranges bound this table.
    stretches = placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("first_row"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select(
        "shard", "range", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first_row")).alias("shift")
    )
    return placed.join(F.broadcast(stretches), ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") + F.col("shift")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
