"""Pages as they arrive: each micro-batch goes through the same stages as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from leafmark.plans.full_run import run_all_stages
from leafmark.sources.results import write_results

_PAGES_DDL = "page_id BIGINT, url STRING, html STRING, status INT"


def arriving_pages(spark: SparkSession, path: str, with_status: bool = False) -> DataFrame:
    return spark.readStream.schema(_PAGES_DDL if with_status else _PAGES_DDL.rpartition(",")[0]).parquet(path)


def write_arrivals(pages: DataFrame, out: str, rejects: str, checkpoint: str) -> DataStreamWriter:
    """A writer (call ``start()``): each page's document goes to ``out``, or its reason to ``rejects``.

    A batch writes to folders named by its number and drops what it staged, so one that is run
    again after a failure replaces itself.
    """
    def one_batch(batch: DataFrame, number: int) -> None:
        run = run_all_stages(batch)
        try:
            write_results(run.outputs, out, f"batch-{number}")
            run.rejects.write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        finally:
            run.close()

    return pages.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
