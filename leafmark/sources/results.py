"""Result documents as JSON files, one folder per run and site."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmark.functions.text import url_domain

DOCUMENT_DDL = (
    "page_id BIGINT, url STRING, status STRING, "
    "fields MAP<STRING,STRUCT<xpath:STRING,sample_value:STRING,confidence:STRING,iterations:INT,"
    "match_count:INT,original_xpath:STRING,explanation:STRING>>, "
    "summary STRUCT<total_fields:INT,correct:INT,best_effort:INT,failed:INT>"
)


def write_results(outputs: DataFrame, path: str, run_id: str | None = None) -> None:
    """Write documents under run_ts=…/domain=…, nulls written out.

    A run given an id (of letters, digits, - and _) replaces what it wrote before, so it can be
    repeated; without one the time is taken and documents are added. Rebalancing gathers small
    sites into few files and splits very large ones.
    """
    stamped = outputs.withColumn("domain", url_domain(F.col("url"))).hint("rebalance", "domain")
    out = stamped.write.option("ignoreNullFields", "false")
    if run_id is None:
        run_id = outputs.sparkSession.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")).first()[0]
        out = out.mode("append")
    else:
        out = out.mode("overwrite")
    out.partitionBy("domain").json(f"{path}/run_ts={run_id}")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT_DDL + ", domain STRING, run_ts STRING").json(path)
