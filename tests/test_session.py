"""What the session settings make of tables that shrink to little in files."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from leafmark import session
from leafmark.operators.selectors import compile_selectors
from leafmark.session import stage, tune
from leafmark.sources.html_tree import shred_html, write_nodes


def _plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_repetitive_table_is_not_broadcast(spark, capsys):
    """20 MB of rows in 1 MB of files would be built and sent by the driver."""
    tune(spark)
    rows = spark.range(150_000).select(F.col("id").alias("page_id"), F.lit("//div[contains(@class, 'x')]" * 4).alias("xpath"))
    left, right = stage(rows, "left"), stage(rows, "right")
    assert "Broadcast" not in _plan(left.join(right, ["page_id", "xpath"]), capsys)


def test_selectors_are_compiled_once(spark, capsys):
    """A plan that reads compiled selectors scans them; it does not carry the compiling."""
    rows = spark.createDataFrame([(1, "//a"), (2, "//a"), (3, None), (4, "//p[")], "page_id long, xpath string")
    done = compile_selectors(rows)
    assert "regexp_extract" not in _plan(done.union(done), capsys)
    found = {r.page_id: r.problem for r in done.collect()}
    assert found[1] is None and found[2] is None and found[3] == "Invalid expression" and found[4].startswith("Invalid")


def test_buckets_follow_the_size_of_the_html(spark, monkeypatch):
    """A fixed number of buckets makes tasks, and what their sorts spill, grow with the input."""
    assert session.bucket_count(spark) == 8
    assert session.bucket_count(spark, 100 * session.BUCKET_BYTES) == 100
    monkeypatch.setattr(session, "BUCKET_BYTES", 50)
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("<p class='x'>a<b>c</b></p>").alias("html"))
    written = write_nodes(pages)
    assert len({f.rsplit("_", 1)[1] for f in written.inputFiles()}) > 8
    assert sorted(map(str, written.collect())) == sorted(map(str, shred_html(pages).collect()))


def test_rows_are_not_sorted_to_be_written_in_buckets(spark):
    """Two rows of a bucket keep the order they come in."""
    rows = spark.createDataFrame([(1, 3), (1, 2), (1, 1)], "page_id long, node_id int").coalesce(1).repartition(1, "page_id")
    written = session.stage_by_page(rows.sortWithinPartitions(F.desc("node_id")), "order", 1)
    assert [r.node_id for r in written.collect()] == [3, 2, 1]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def _shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {str(f) for top in disk.localDirs() for f in Path(str(top)).rglob("shuffle_*.data")}


def test_a_staged_table_leaves_nothing_shuffled(spark):
    """What a write shuffled is of no use once the table stands; a run of many writes would keep all of it."""
    rows = spark.range(5000).groupBy((F.col("id") % 7).alias("page_id")).count()
    before = _shuffle_files(spark)
    plain, dealt = stage(rows, "plain"), session.stage_by_page(rows.repartition(8, "page_id"), "dealt", 8)
    until = time.time() + 10
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    assert sorted(plain.collect()) == sorted(dealt.collect()) and plain.count() == 7


def test_tables_staged_on_the_way_are_dropped(spark):
    def made():
        passing.append(stage(spark.range(3).withColumnRenamed("id", "page_id"), "passing"))
        return passing[0].filter("page_id > 0")

    passing = []
    with session.staging() as kept:
        last = session.stage_last(made, "last")
    assert last.count() == 2 and len(kept.paths) == 1
    assert not Path(passing[0].inputFiles()[0].removeprefix("file://")).exists()
    kept.drop(spark)


def test_tables_made_from_bucketed_ones_meet_without_a_shuffle(spark, capsys):
    """Shuffled again at every step, the rows of a run would fill the disks several times over."""
    rows = spark.range(40).select((F.col("id") % 9).alias("page_id"), F.col("id").alias("n"))
    first = session.stage_by_page(rows.repartition(6, "page_id"), "first", 6)
    assert (session.page_buckets(rows), session.page_buckets(first.filter("n > 3"))) == (0, 6)
    sums = stage(first.groupBy("page_id").agg(F.sum("n").alias("s")), "the-sums")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = first.join(sums, "page_id").groupBy("page_id", "s").agg(F.sum("n").alias("t"))
        assert "Exchange" not in _plan(met, capsys)
        assert all(r.s == r.t for r in met.collect()) and met.count() == 9
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2m")
    assert session.page_buckets(stage(first.select("n"), "no-pages")) == 0
