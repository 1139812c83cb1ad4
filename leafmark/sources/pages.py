"""Crawled pages as a source, and the pages that cannot be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leafmark.functions.text import is_blank, url_domain
from leafmark.model import rejects

PAGE_COLUMNS = ["page_id", "url", "html"]


def scan_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Pages already fetched: page_id, url, html, and status where the crawl kept it."""
    df = spark.read.format(fmt).load(path)
    return df.select(*PAGE_COLUMNS, *[c for c in ("status",) if c in df.columns])


def _reason(pages: DataFrame) -> Column:
    reason = F.when(is_blank(F.col("html")), "Empty HTML returned")
    if "status" in pages.columns:
        bad = F.col("status").isNull() | (F.col("status") >= 400)
        code = F.coalesce(F.col("status").cast("string"), F.lit("no response"))
        reason = F.when(bad, F.concat(F.lit("HTTP "), code)).otherwise(reason)
    return reason


def reject_pages(pages: DataFrame) -> DataFrame:
    """Unusable pages as rejects rows."""
    return rejects(pages.withColumn("_why", _reason(pages)).filter("_why is not null"), "render", F.col("_why"))


def usable_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(_reason(pages).isNull())


def page_size_kb(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", (F.char_length("html") / 1024).alias("kb"))


def with_domain(pages: DataFrame) -> DataFrame:
    return pages.withColumn("domain", url_domain(F.col("url")))
