from leafmark.sources.results import read_results
from leafmark.streaming.arrivals import arriving_pages, write_arrivals
from tests.fixtures import pages, thread_list


def test_arriving_pages_are_run(spark, tmp_path):
    source, out, rejects = (str(tmp_path / x) for x in ("in", "out", "rejects"))
    pages(spark, thread_list(3), thread_list(4), " ").coalesce(1).write.parquet(source)
    tables = {t.name for t in spark.catalog.listTables()}
    for attempt in ("first", "again"):         # the same batch, run again from its beginning
        query = write_arrivals(arriving_pages(spark, source), out, rejects, str(tmp_path / attempt)).trigger(availableNow=True).start()
        assert query.awaitTermination(200)
        got = [(r["page_id"], r["status"]) for r in read_results(spark, out).collect()]
        assert sorted(got) == [(1, "success"), (2, "success")]
        assert [(r["page_id"], r["stage"]) for r in spark.read.parquet(rejects).collect()] == [(3, "render")]
    assert {t.name for t in spark.catalog.listTables()} == tables
