"""Merkle manifest of a document table: one tree of threes per source, and one over the sources.

A leaf is the SHA-256 (lowercase hex) of its row's fields, each written ``-`` when null, else its
UTF-8 byte count, ``:`` and the value (integers in decimal). Per source, leaves ascend by doc_id;
every 3 consecutive nodes of a level (the last run may hold fewer, even one) become the hash of
their hex digests, until one node is left: the source's subroot (a lone leaf is its own subroot).
Subroots, ordered by source (null first, then UTF-8 bytewise), make the root the same way.

Positions without sorting: per source, doc_ids are set in a compressed bitmap: 64-bit words keyed
by (source, doc_id >> 16, word) and merged by ``bit_or`` on the map side; a popcount directory
(rows per block, running over blocks, and rows per word, running inside a block of at most 1024
words) gives every leaf its position by a rank query: rows before its block, before its word, and
``bit_count`` of its word below its bit. Levels are reduced by keyed slot arrays: a node at
position p goes to slot p % 3 of key (source, p div 3). Every level is written to the shared folder,
so a lost executor costs one level. Proofs are assembled top-down: a node's path is its own
(left siblings, right siblings) before its parent's path.

Only work that is not a plain bitmap goes another way: rows whose doc_id is null or repeated in
their source are ordered among themselves by (leaf, row) through a range-partitioned sort with
per-partition counts; so are blocks of the directory and the sources. No step gathers a source,
a block list or the sources into one task; only the root (one value) and two counts reach the
driver.

Defined results: null doc_ids come first in their source, rows of one doc_id follow in leaf order
(equal rows in any order: they get the same leaf and their proofs differ only by place); a null
source is a source of its own; an empty table gives no rows. Tampering (for the check of proofs)
deletes ``\\n`` from the text where crc32 of the decimal doc_id is even; a null doc_id or text is
never tampered. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leafmark.llm.common import staged

#: Nodes joined per step of the tree.
RUN = 3
#: Bits of doc_id below the block of the directory, and bits of one bitmap word.
BLOCK_BITS, WORD_BITS = 16, 6


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(_field(doc_id), _field(source), _field(lang), _field(n_chars), _field(text)), 256)


def tampered(doc_id: Column, text: Column) -> Column:
    """The text with line feeds deleted where crc32 of the decimal doc_id is even."""
    hit = doc_id.isNotNull() & (F.pmod(F.crc32(doc_id.cast("string")), F.lit(2)) == 0)
    return F.when(hit, F.translate(text, "\n", "")).otherwise(text)


def ordinal(df: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over all rows before this one in ``order`` (a total
    order). Range partitions sort the rows; each partition's running sum plus the totals of the
    partitions before it (one row per partition, broadcast) gives the answer."""
    parts = staged(df.repartitionByRange(*order).withColumn("__pid", F.spark_partition_id()), "ordinal")
    before = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumn("__local", F.coalesce(F.sum(weight).over(before), F.lit(0)))
    totals = parts.groupBy("__pid").agg(F.sum(weight).alias("__tot"))
    offsets = totals.withColumn(
        "__off", F.coalesce(F.sum("__tot").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(offsets.select("__pid", "__off")), "__pid") \
        .withColumn(name, (F.col("__local") + F.col("__off")).cast("long")).drop("__pid", "__local", "__off")


def leaves(docs: DataFrame) -> DataFrame:
    """rk, tkey (tree key: 'n' for a null source, else 's:' + source), doc_id, leaf, leaf_t."""
    c = {name: docs[f"`{name}`"] for name in ("doc_id", "source", "lang", "n_chars", "text")}
    doc_id, n_chars = c["doc_id"].cast("long"), c["n_chars"].cast("long")
    return staged(docs.select(
        F.monotonically_increasing_id().alias("rk"),
        F.coalesce(F.concat(F.lit("s:"), c["source"].cast("string")), F.lit("n")).alias("tkey"),
        doc_id.alias("doc_id"),
        c["source"].cast("string").alias("source"),
        leaf_of(doc_id, c["source"], c["lang"], n_chars, c["text"]).alias("leaf"),
        leaf_of(doc_id, c["source"], c["lang"], n_chars, tampered(doc_id, c["text"])).alias("leaf_t"),
    ), "leaves")


def positions(leaf: DataFrame) -> DataFrame:
    """leaf rows with pos (place in the source) and n (leaves of the source), by bitmap rank."""
    hi = F.shiftright("doc_id", BLOCK_BITS)
    word = F.shiftright("doc_id", WORD_BITS).bitwiseAND((1 << (BLOCK_BITS - WORD_BITS)) - 1)
    bit = F.col("doc_id").bitwiseAND((1 << WORD_BITS) - 1)
    keyed = leaf.withColumn("hi", hi).withColumn("word", word).withColumn("bit", bit)
    ids = keyed.groupBy("tkey", "doc_id", "hi", "word", "bit").agg(F.count(F.lit(1)).alias("m"))
    words = ids.where(F.col("doc_id").isNotNull()).groupBy("tkey", "hi", "word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"),
        F.sum("m").alias("w_rows"),
        F.collect_list(F.when(F.col("m") > 1, F.struct("bit", "m"))).alias("dups"))
    words = staged(words, "bitmap-words")
    nulls = ids.where(F.col("doc_id").isNull()).select("tkey", F.col("m").alias("null_rows"))
    blocks = words.groupBy("tkey", "hi").agg(F.sum("w_rows").alias("b_rows"))
    # Rows before a block in its source: running sum over (tkey, hi), less the source's start.
    blocks = ordinal(blocks, ["tkey", "hi"], "b_rows", "cum")
    starts = blocks.groupBy("tkey").agg(F.min("cum").alias("start"), F.sum("b_rows").alias("id_rows"))
    sizes = starts.join(nulls, "tkey", "full").select(
        "tkey", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("null_rows", F.lit(0)).alias("null_rows"),
        (F.coalesce("id_rows", F.lit(0)) + F.coalesce("null_rows", F.lit(0))).alias("n"))
    in_block = Window.partitionBy("tkey", "hi").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    directory = words.withColumn("w_before", F.coalesce(F.sum("w_rows").over(in_block), F.lit(0))) \
        .join(blocks.select("tkey", "hi", "cum"), ["tkey", "hi"]) \
        .join(sizes, "tkey") \
        .select("tkey", "hi", "word", "bits", "dups", "n",
                (F.col("null_rows") + F.col("cum") - F.col("start") + F.col("w_before")).alias("base"))
    ranked = keyed.where(F.col("doc_id").isNotNull()).join(directory, ["tkey", "hi", "word"]).select(
        "rk", "tkey", "doc_id", "leaf", "leaf_t", "n",
        (F.col("base") + F.bit_count(F.col("bits").bitwiseAND(F.expr("if(bit = 0, 0L, shiftrightunsigned(-1L, 64 - bit))")))
         + F.aggregate(F.filter("dups", lambda x: x["bit"] < F.col("bit")), F.lit(0).cast("long"),
                       lambda acc, x: acc + x["m"] - 1)).alias("first"),
        F.exists("dups", lambda x: x["bit"] == F.col("bit")).alias("repeated"))
    single = ranked.where(~F.col("repeated")).select("rk", "tkey", "doc_id", "leaf", "leaf_t", "n", F.col("first").alias("pos"))
    # Null and repeated ids: their order among themselves by (leaf, rk), through sorted ranges.
    null_rows = keyed.where(F.col("doc_id").isNull()).join(sizes.select("tkey", "n"), "tkey") \
        .select("rk", "tkey", "doc_id", "leaf", "leaf_t", "n", F.lit(0).cast("long").alias("first"))
    ties = ranked.where(F.col("repeated")).drop("repeated").unionByName(null_rows) \
        .withColumn("nn", F.col("doc_id").isNotNull()).withColumn("idk", F.coalesce("doc_id", F.lit(0))).withColumn("one", F.lit(1))
    ties = ordinal(ties, ["tkey", "nn", "idk", "leaf", "rk"], "one", "o")
    group_start = ties.groupBy("tkey", "nn", "idk").agg(F.min("o").alias("o0"))
    tied = ties.join(group_start, ["tkey", "nn", "idk"]).select(
        "rk", "tkey", "doc_id", "leaf", "leaf_t", "n", (F.col("first") + F.col("o") - F.col("o0")).alias("pos"))
    return staged(single.unionByName(tied), "leaf-positions")


def reduce_levels(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Nodes (tkey, pos, h, n) of level 0 to one root per tkey.

    Returns the tables of every level's reduced nodes (tkey, level, pos, left, right: the hex
    digests of the run's others before and after the node) and the roots (tkey, h)."""
    top = nodes.agg(F.max("n")).first()[0] or 0
    height = 0
    while RUN ** height < top:
        height += 1
    levels, roots, cur = [], [], nodes
    for level in range(height):
        width = RUN ** level
        size = F.expr(f"(n + {width - 1}) div {width}")
        roots.append(cur.where(size <= 1).select("tkey", "h"))
        active = cur.where(size > 1).withColumn("slot", F.pmod("pos", F.lit(RUN))).withColumn("up", F.expr(f"pos div {RUN}"))
        run = F.array_sort(F.collect_list(F.struct("slot", "h")).over(Window.partitionBy("tkey", "up")))
        done = staged(active.withColumn("run", run).select(
            "tkey", "pos", "n", "slot", "up",
            F.sha2(F.array_join(F.transform("run", lambda x: x["h"]), ""), 256).alias("up_h"),
            F.array_join(F.transform(F.filter("run", lambda x: x["slot"] < F.col("slot")), lambda x: x["h"]), "").alias("left"),
            F.array_join(F.transform(F.filter("run", lambda x: x["slot"] > F.col("slot")), lambda x: x["h"]), "").alias("right"),
        ), f"level-{level}")
        levels.append(done.select("tkey", F.lit(level).alias("level"), "pos", "left", "right"))
        cur = done.where(F.col("slot") == 0).select("tkey", F.col("up").alias("pos"), F.col("up_h").alias("h"), "n")
    roots.append(cur.select("tkey", "h"))
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return levels, out


def _size(level: int) -> Column:
    return F.expr(f"(n + {RUN ** level - 1}) div {RUN ** level}")


_PATH = "array<struct<left:string,right:string>>"


def paths_down(levels: list[DataFrame], tops: DataFrame) -> DataFrame | None:
    """Path of every level-0 node (tkey, pos, path), its own level first. ``tops`` (tkey, n, path)
    gives each tree's size and the path above its top node."""
    above = None
    for level in range(len(levels) - 1, -1, -1):
        seed = tops.where((_size(level) > 1) & (_size(level + 1) <= 1)).select("tkey", F.lit(0).cast("long").alias("pos"), "path")
        parents = seed if above is None else above.unionByName(seed)
        rows = levels[level].withColumn("up", F.expr(f"pos div {RUN}"))
        above = staged(rows.join(parents.select("tkey", F.col("pos").alias("up"), F.col("path").alias("rest")), ["tkey", "up"])
                       .select("tkey", "pos", F.concat(F.array(F.struct("left", "right")), "rest").alias("path")), f"path-{level}")
    return above


def _fold(path: Column, start: Column) -> Column:
    return F.aggregate(path, start, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256 (hash of all siblings from the leaf up to
    the root, left to right), folded_root (the root recomputed from the tampered leaf and the
    original siblings), verified (folded_root equals root); also n (leaves of the source), pos."""
    placed = positions(leaves(docs))
    levels, subroots = reduce_levels(placed.select("tkey", "pos", F.col("leaf").alias("h"), "n"))
    subroots = staged(subroots, "subroots")
    sources = subroots.count()
    if sources == 0:
        return placed.select("doc_id", "leaf", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"),
                             F.col("leaf").alias("proof_sha256"), F.col("leaf").alias("folded_root"),
                             F.lit(True).alias("verified"), "n", "pos")
    ranked = ordinal(subroots.withColumn("one", F.lit(1)), ["tkey"], "one", "pos")
    over = ranked.select(F.lit("*").alias("tkey"), "pos", "h", F.lit(sources).cast("long").alias("n"), F.col("tkey").alias("src"))
    over = staged(over, "sources")
    top_levels, top_root = reduce_levels(over.select("tkey", "pos", "h", "n"))
    root = top_root.first()["h"]
    empty = F.expr(f"cast(array() as {_PATH})")
    top_paths = paths_down(top_levels, over.limit(1).select("tkey", "n", empty.alias("path")))
    if top_paths is None:
        source_paths = over.select(F.col("src").alias("tkey"), empty.alias("path"))
    else:
        source_paths = over.join(top_paths, ["tkey", "pos"]).select(F.col("src").alias("tkey"), "path")
    sizes = placed.groupBy("tkey").agg(F.max("n").alias("n"))
    tops = staged(source_paths.join(sizes, "tkey"), "source-paths")
    leaf_paths = paths_down(levels, tops)
    many = placed.where(F.col("n") > 1)
    many = many.join(leaf_paths, ["tkey", "pos"]) if leaf_paths is not None else many.withColumn("path", empty)
    alone = placed.where(F.col("n") <= 1).join(tops.select("tkey", "path"), "tkey")
    height = F.aggregate(F.sequence(F.lit(0), F.lit(39)), F.lit(0),
                         lambda acc, i: acc + F.when(F.pow(F.lit(RUN), i) < F.col("n"), 1).otherwise(0))
    return many.unionByName(alone).select(
        "doc_id", "leaf",
        _fold(F.slice("path", 1, height), F.col("leaf")).alias("subroot"),
        F.lit(root).alias("root"),
        F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), ""), 256).alias("proof_sha256"),
        _fold(F.col("path"), F.col("leaf_t")).alias("folded_root"),
        (_fold(F.col("path"), F.col("leaf_t")) == F.lit(root)).alias("verified"),
        "n", "pos",
    )
