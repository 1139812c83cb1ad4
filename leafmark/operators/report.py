"""Result documents per page: field map, counts, status, report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leafmark.functions.text import plural
from leafmark.model import CONFIDENCE_ICONS, FIELDS, FIELD_LABELS, literal_map, position_of

_FIELD_COLUMNS = [
    "xpath", "sample_value", "confidence", "iterations", "match_count", "original_xpath", "explanation",
]


def null_empty_sample(results: DataFrame) -> DataFrame:
    return results.withColumn("sample_value", F.nullif("sample_value", F.lit("")))


def complete_results(pages: DataFrame, results: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """Results with a row for every page and field: what is absent has failed.

    ``pages`` (page_id) are those that got so far as to have selectors.
    """
    grid = pages.select("page_id").distinct().select("page_id", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))
    joined = grid.join(results, ["page_id", "field"], "left")
    blank = {"xpath": "", "sample_value": "", "confidence": "failed"}
    return joined.withColumns({
        **{c: F.coalesce(c, F.lit(v)) for c, v in blank.items()},
        **{c: F.coalesce(c, F.lit(0)) for c in ("iterations", "match_count")},
    }).select(*results.columns)


def assemble_fields(results: DataFrame) -> DataFrame:
    """(page_id, fields): one map entry per field."""
    entry = F.struct("field", F.struct(*_FIELD_COLUMNS))
    return results.groupBy("page_id").agg(F.map_from_entries(F.collect_list(entry)).alias("fields"))


def summary_counts(results: DataFrame, total: int = len(FIELDS)) -> DataFrame:
    """(page_id, total_fields, correct, best_effort, failed)."""
    correct = F.count_if(F.col("confidence") == "correct")
    best = F.count_if(F.col("confidence") == "best_effort")
    return results.groupBy("page_id").agg(
        F.lit(total).alias("total_fields"),
        correct.cast("int").alias("correct"), best.cast("int").alias("best_effort"),
        (F.count("*") - correct - best).cast("int").alias("failed"),
    )


def page_status(total: Column, correct: Column) -> Column:
    return F.when(correct == total, "success").when(correct > 0, "partial").otherwise("failed")


def format_output(pages: DataFrame, results: DataFrame, total: int = len(FIELDS)) -> DataFrame:
    """(page_id, url, status, fields, summary): one document per page."""
    results = null_empty_sample(results)
    entry = F.struct("field", F.struct(*_FIELD_COLUMNS))
    correct = F.count_if(F.col("confidence") == "correct")
    best = F.count_if(F.col("confidence") == "best_effort")
    docs = results.groupBy("page_id").agg(
        F.map_from_entries(F.collect_list(entry)).alias("fields"),
        F.struct(
            F.lit(total).alias("total_fields"), correct.cast("int").alias("correct"),
            best.cast("int").alias("best_effort"),
            (F.count("*") - correct - best).cast("int").alias("failed"),
        ).alias("summary"),
    )
    return pages.select("page_id", "url").join(docs, "page_id").select(
        "page_id", "url",
        page_status(F.col("summary.total_fields"), F.col("summary.correct")).alias("status"),
        "fields", "summary",
    )


def report_rows(results: DataFrame) -> DataFrame:
    """The readable report, one row per page and field, in reporting order by `pos`."""
    outcome = F.concat(
        literal_map(CONFIDENCE_ICONS)[F.col("confidence")], F.lit(" "), F.col("confidence"), F.lit(" ("),
        plural(F.col("iterations"), "iteration"),
        F.lit(", "), F.col("match_count").cast("string"), F.lit(" matches)"),
    )
    return results.select(
        "page_id", position_of(F.col("field"), FIELDS).alias("pos"),
        F.coalesce(literal_map(FIELD_LABELS)[F.col("field")], F.upper("field")).alias("label"),
        F.col("xpath"),
        F.coalesce(F.nullif("sample_value", F.lit("")), F.lit("(none)")).alias("sample"),
        outcome.alias("outcome"),
        F.when(F.col("original_xpath") != "", F.concat(F.lit("↳ Revised from: "), F.col("original_xpath"))).alias("revised_from"),
        F.when(F.col("explanation") != "", F.concat(F.lit("ℹ "), F.col("explanation"))).alias("note"),
    )

