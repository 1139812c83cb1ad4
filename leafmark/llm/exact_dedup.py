"""Exact deduplication by content sort.

Rows are range-partitioned by content (its first characters, then a hash of the whole) with
splitters that Spark samples, sorted externally within each range, and each row is compared
in full with its neighbour: equal neighbours form a run. Where one text is so frequent that
its range would outgrow the others, its rows are dealt over several sub-ranges first; the few
representatives of those sub-ranges are then compared in full once more.

Defined results: null text counts as empty, and all empty texts are one group. Of equal texts
the row with the largest (or smallest) id stays; a null id loses against any other; of rows
repeated with the same id and text exactly one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from leafmark.llm.common import hidden, staged, tasks

PREFIX, KEY, SALT, HOT, ROW = (hidden(x) for x in ("prefix", "key", "salt", "hot", "row"))
TEXT, ID, RUN, LAST = (hidden(x) for x in ("text", "id", "run", "last"))
PREFIX_CHARS = 32
#: A text counts as hot from this part of an even range's rows on.
HOT_SHARE = 0.25


def _hot_texts(rows: DataFrame, ranges: int) -> DataFrame:
    """(key, pieces) of texts that fill a good part of a range; at most ranges / HOT_SHARE rows."""
    counts = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    per_range = max(1.0, total / ranges)
    return counts.filter(F.col("n") >= F.lit(max(2.0, HOT_SHARE * per_range))).select(
        F.col(KEY), F.ceil(F.col("n") / F.lit(HOT_SHARE * per_range)).cast("int").alias(hidden("pieces"))
    )


def content_runs(docs: DataFrame, id_col: str, text_col: str, keep: str) -> DataFrame:
    """All columns of ``docs`` plus the run each row is in and whether it ends its run."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is 'largest' or 'smallest', not {keep!r}")
    ranges = tasks(docs.sparkSession)
    rows = docs.withColumns({
        ID: F.col(f"`{id_col}`"), TEXT: F.coalesce(F.col(f"`{text_col}`"), F.lit("")),
    }).withColumns({PREFIX: F.substring(TEXT, 1, PREFIX_CHARS), KEY: F.xxhash64(TEXT)})
    hot = _hot_texts(rows.select(KEY), ranges)
    # The hot table has at most ranges / HOT_SHARE rows, so it may be sent to every task.
    rows = rows.join(F.broadcast(hot), KEY, "left").withColumns({
        HOT: F.col(hidden("pieces")).isNotNull(),
        SALT: F.coalesce(F.pmod(F.xxhash64(ID), F.col(hidden("pieces"))), F.lit(0)).cast("int"),
    }).drop(hidden("pieces"))
    ranged = rows.repartitionByRange(ranges, PREFIX, KEY, SALT)
    # The window's keys are the range keys: Spark sorts within the ranges, without a shuffle.
    order = [F.col(TEXT), F.asc_nulls_first(ID) if keep == "largest" else F.desc_nulls_first(ID)]
    near = Window.partitionBy(PREFIX, KEY, SALT).orderBy(*order)
    before, after = F.lag(TEXT).over(near), F.lead(TEXT).over(near)
    starts = F.when(before.isNull() | (before != F.col(TEXT)), 1).otherwise(0)
    marked = ranged.withColumns({hidden("starts"): starts, LAST: after.isNull() | (after != F.col(TEXT))})
    return marked.withColumn(
        RUN, F.sum(hidden("starts")).over(near.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """Decision for every row: doc_id, keep_id, group_size, kept, text_sha256."""
    runs = content_runs(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")),
                        "doc_id", "text", keep)
    narrow = runs.select(
        ID, PREFIX, KEY, SALT, RUN, HOT, LAST, F.sha2(F.encode(TEXT, "UTF-8"), 256).alias("text_sha256"),
        F.when(F.col(HOT) & F.col(LAST), F.col(TEXT)).alias(TEXT),
    )
    narrow = staged(narrow, "content-runs")
    # Sub-ranges of hot texts are bounded in rows, and so is the window over one of them. Runs
    # are numbered within (PREFIX, KEY, SALT): texts that share a hash but not their beginning
    # were compared in full and stay apart.
    run = Window.partitionBy(PREFIX, KEY, SALT, RUN)
    sized = narrow.withColumns({
        "keep_id": F.max(F.when(F.col(LAST), F.col(ID))).over(run), "group_size": F.count(F.lit(1)).over(run),
    })
    best = F.max if keep == "largest" else F.min
    # One row per sub-range of a hot text (at most 2 / HOT_SHARE times the ranges): whole texts are compared again.
    heads = narrow.filter(F.col(HOT)).groupBy(PREFIX, KEY, SALT, RUN).agg(
        F.max(TEXT).alias(TEXT), F.max(F.when(F.col(LAST), F.col(ID))).alias(ID), F.count(F.lit(1)).alias("rows")
    )
    same = Window.partitionBy(KEY, TEXT)
    merged = heads.select(
        F.col(PREFIX).alias("m_prefix"), F.col(KEY).alias("m_key"), F.col(SALT).alias("m_salt"), F.col(RUN).alias("m_run"),
        best(ID).over(same).alias("m_keep"), F.sum("rows").over(same).alias("m_size"),
        (F.row_number().over(same.orderBy(F.desc_nulls_last(ID) if keep == "largest" else F.asc_nulls_last(ID), SALT)) == 1).alias("m_first"),
    )
    joined = sized.join(
        F.broadcast(merged),
        (F.col(PREFIX) == F.col("m_prefix")) & (F.col(KEY) == F.col("m_key")) & (F.col(SALT) == F.col("m_salt")) & (F.col(RUN) == F.col("m_run")),
        "left",
    )
    return joined.select(
        F.col(ID).alias("doc_id"),
        F.when(F.col("m_size").isNull(), F.col("keep_id")).otherwise(F.col("m_keep")).alias("keep_id"),
        F.coalesce("m_size", "group_size").cast("bigint").alias("group_size"),
        (F.col(LAST) & F.coalesce("m_first", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns it came with."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    runs = content_runs(docs, id_col, text_col, keep).filter(LAST)
    cold = runs.filter(~F.col(HOT)).select(*columns)
    same = Window.partitionBy(KEY, TEXT).orderBy(
        F.desc_nulls_last(ID) if keep == "largest" else F.asc_nulls_last(ID), SALT
    )
    hot = runs.filter(HOT).withColumn(ROW, F.row_number().over(same)).filter(F.col(ROW) == 1).select(*columns)
    return cold.unionAll(hot)
