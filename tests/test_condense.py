from pyspark.sql import functions as F

from checks import inputs as I, queries as Q
from leafmark.functions.similarity import edit_distance_ratio, is_near
from leafmark.functions.text import text_snippet
from leafmark.model import IE_VALUES_DDL
from leafmark.operators import condense as C
from tests.fixtures import body, nodes, pages, thread_list


def test_target_texts(spark):
    ie = spark.createDataFrame([
        (1, "link", "/t/1", ""), (1, "title", "T", "Thread: "), (1, "last_post_author", "ann", "by "), (1, "last_post_date", "", ""),
    ], IE_VALUES_DDL)
    got = C.target_texts(ie).orderBy("pos").collect()
    assert [r["target"] for r in got] == ["T", "Thread: ", "ann", "by ", "/t/1"]
    assert "by" in [r["target"] for r in C.target_texts(ie, strip_targets=True).collect()]


def test_distance(spark):
    pairs = [("same", "same", 0.0), ("", "", 0.0), ("", "a", 1.0), ("abcdefghijkl", "abcdefghijkx", 1 / 12), ("é", "e", 1.0), ("cat", "dogs", 1.0)]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    got = df.select(edit_distance_ratio(F.col("a"), F.col("b")).alias("r"), is_near(F.col("a"), F.col("b")).alias("n"), "want").collect()
    for r in got:
        assert abs(r["r"] - r["want"]) < 1e-12
        assert r["n"] == (r["want"] <= 0.1)


def test_fuzzy_matches_text_and_tail(spark):
    n = nodes(spark, body("<p>Hello world!</p><i>x</i> some tail <b>other</b>")).cache()
    targets = spark.createDataFrame([(1, "Hello world?"), (1, "some tail"), (1, "absent"), (1, "other ")], "page_id long, target string")
    m = C.fuzzy_node_match(n, targets).cache()
    tags = m.join(n, ["page_id", "node_id"]).select("tag", "target").collect()
    # An unstripped target is compared as it is: "other " is 1/6 away from "other".
    assert {tuple(r) for r in tags} == {("p", "Hello world?"), ("i", "some tail")}
    assert {r["target"] for r in C.found_targets(targets, m).collect()} == {"Hello world?", "some tail"}
    assert {r["target"] for r in C.missing_targets(targets, m).collect()} == {"absent", "other "}


def test_condensed_page(spark):
    html = thread_list(3).replace("part two", "PART TWO OF THIS LONG STORY").replace("part three", "the third one, quite different")
    targets = spark.createDataFrame([(1, "How to grow quinces, part one"), (1, "2 minutes ago")], "page_id long, target string")
    out = C.condense_pages(nodes(spark, html), targets).first()["condensed"]
    assert 'class="subject" href="/threads/0">How to grow quinces, part one</a>' in out
    assert '<time class="when">2 minutes ago</time>' in out
    assert "All rights kept" not in out and "<footer>...</footer>" in out
    assert "memberb" not in out and "membera" not in out and out.endswith("</html>\n")


def test_kept_nodes_are_closed_and_stubs_are_empty(spark):
    n = nodes(spark, body("<div><p>target<b>in</b>after</p><!--note--><p>no</p>tail</div><i>q</i>hit tail"))
    targets = spark.createDataFrame([(1, "target"), (1, "hit tail")], "page_id long, target string")
    out = C.condense_pages(n, targets).first()["condensed"].replace("\n", "")
    assert "<p>target<b>...</b>after</p><!--...--><p>...</p>tail" in out
    # The tail belongs to <i>, which is kept with its text.
    assert "<i>q</i>hit tail" in out


def test_pages_without_targets(spark):
    p = pages(spark, body("<p>a</p>"), body("<p>b</p>"))
    n = nodes(spark, body("<p>a</p>"), body("<p>b</p>"))
    targets = spark.createDataFrame([(1, "a"), (2, "zzz")], "page_id long, target string")
    assert [r["page_id"] for r in C.reject_no_target(p, C.fuzzy_node_match(n, targets)).collect()] == [2]
    assert [r["page_id"] for r in C.condense_pages(n, targets).collect()] == [1]
    lines = C.condensed_lines(C.condense_pages(n, targets), limit=2).first()
    assert lines["lines"] > 2 and lines["is_large"]


def test_snippet(spark):
    text = "\n".join(f"line {i}" for i in range(10)) + "\n"
    df = spark.createDataFrame([(text, "LINE 5", 4), (text, "line 0", 1), (text, "none", 4), ("a\r\nb\x0bc", "B", 1)], "t string, q string, n int")
    got = [df.filter(F.col("q") == q).select(text_snippet(F.col("t"), F.col("q"), n)).first()[0] for q, n in (("LINE 5", 4), ("line 0", 1), ("none", 4), ("B", 1))]
    assert got == ["\n".join(f"line {i}" for i in range(1, 10)), "line 0\nline 1", "", "a\nb\nc"]


def test_values_of_the_lists_are_read_once_for_targets(spark, tmp_path, monkeypatch):
    """The matches and what is missing from them start from one written table of targets."""
    spark.sql(
        "SELECT id AS o_orderkey, id AS o_custkey, element_at(array('O', 'F', 'P'), cast(id % 3 AS int) + 1) AS o_orderstatus, 1.0D AS o_totalprice, "
        "timestamp'1995-02-03' AS o_orderdate, if(id % 2 = 0, '1-URGENT', '5-LOW') AS o_orderpriority FROM range(12)"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    calls, values = [], I.list_values
    monkeypatch.setattr(I, "list_values", lambda *a: calls.append(a) or values(*a))
    missing = Q.missing_targets(spark, str(tmp_path)).collect()
    assert {(r.page_id, r.target) for r in missing} == {(p, "no such text") for p in (1, 2, 3)}
    assert len(calls) == 1
