"""Session settings and the one place where intermediate tables are written."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Only settings that may change at run time, and only where the caller has not chosen.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Patterns and similarity cost far more per byte than Spark assumes when it merges small
    # shuffle partitions; keep the cores busy.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Rows per page repeat ids and selectors and shrink to a hundredth in Parquet; taken at the
    # size of their files, tables of hundreds of MB would be built and sent by the driver.
    "spark.sql.sources.fileCompressionFactor": "20",
    "spark.sql.autoBroadcastJoinThreshold": "2m",
    # A table hashed by page_id also serves joins and windows on (page_id, ...): one
    # shuffle per stage instead of one per key list.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}

# Html of one bucket of a node table. Its node rows take some twelve times as much in memory, and
# later steps sort them, so this bounds a task whatever the size of the input.
BUCKET_BYTES = 16_000_000


def tune(spark: SparkSession) -> SparkSession:
    """Fill in the settings the plans here rely on; explicit settings stay as they are."""
    for key, value in _DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_leafmark_shipped", False) or not package.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="leafmark-")) / package.name
    context.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
    context._leafmark_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: `leafmark.shared.dir`, else the cluster's checkpoint folder.

    Only a local session without either gets a temporary folder of its own; on a cluster a
    machine-local folder would lose data, so a missing setting is an error there.
    """
    folder = spark.conf.get("leafmark.shared.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir or leafmark.shared.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="leafmark-")
        spark.conf.set("leafmark.shared.dir", folder)
    return folder.rstrip("/")


def bucket_count(spark: SparkSession, n_bytes: int = 0) -> int:
    """Buckets of a staged table: twice the session's shuffle partitions, or one per BUCKET_BYTES
    of ``n_bytes`` if those are more, within what Spark allows."""
    wanted = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES))
    return min(wanted, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """These settings hold inside and are put back."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


#: A staged table is read from its files and its plan never again, so what the write shuffled goes
#: with it; else those files stay until the driver happens to collect its garbage.
_RELEASED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: A task opens a file for each of its few buckets and needs no sort to meet them one after the
#: other, so what is written keeps its order.
_UNSORTED = {"spark.sql.maxConcurrentOutputFileWriters": "8"}


@dataclass(eq=False)
class Staged:
    """What has been written for intermediate use, to be dropped together."""

    paths: list[str] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)

    def drop(self, spark: SparkSession) -> None:
        """Delete these tables; frames that read them can no longer be used."""
        for table in self.tables:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        self.tables.clear()
        self.paths.clear()


_open: list[Staged] = []


@contextmanager
def staging() -> Iterator[Staged]:
    """Collect what is staged inside, so that the caller can drop it when it is done."""
    kept = Staged()
    _open.append(kept)
    try:
        yield kept
    finally:
        _open.remove(kept)


def note_staged(path: str | None = None, table: str | None = None) -> None:
    """Tell the innermost open ``staging`` what is written."""
    if _open:
        _open[-1].paths.extend([path] if path else [])
        _open[-1].tables.extend([table] if table else [])


def page_buckets(df: DataFrame) -> int:
    """Buckets of the tables bucketed by page_id that ``df`` reads, 0 if it reads none."""
    found, leaves = 0, df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.catalogTable().isDefined():
            spec = leaf.catalogTable().get().bucketSpec()
            if spec.isDefined() and spec.get().bucketColumnNames().mkString(",") == "page_id":
                found = max(found, spec.get().numBuckets())
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later steps read and return it as a scan.

    Cuts the lineage, survives the loss of executors, and gives every reader column pruning
    and filter pushdown, which a cached plan of the tokenizer would not. Rows with a page_id
    that come from a table bucketed by it are bucketed alike, so that what follows meets them
    without a shuffle.
    """
    spark = df.sparkSession
    if "page_id" in df.columns and (buckets := page_buckets(df)):
        return stage_by_page(df.repartition(buckets, "page_id"), name, buckets)
    path = f"{shared_folder(spark)}/leafmark/{name}-{uuid.uuid4().hex}"
    note_staged(path=path)
    with _set(spark, _RELEASED):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_last(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stage what ``make`` returns and drop what it staged on the way."""
    with staging() as passing:
        df = make()
    try:
        return stage(df, name)
    finally:
        passing.drop(df.sparkSession)


def stage_by_page(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """Like ``stage``, as a table bucketed by page_id.

    ``df`` comes dealt by page_id over ``buckets`` partitions, so each task writes one bucket
    and its rows are never sorted; every later join and window on (page_id, ...) reads
    co-located buckets.
    """
    spark = df.sparkSession
    table = f"leafmark_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/leafmark/{table}"
    note_staged(path=path, table=table)
    with _set(spark, _RELEASED | _UNSORTED):
        df.write.bucketBy(buckets, "page_id").option("path", path).saveAsTable(table)
    return spark.table(table)
