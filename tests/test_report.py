import json

from leafmark.model import RESULTS_DDL
from leafmark.operators import report as R
from leafmark.sources.pages import reject_pages, usable_pages
from leafmark.sources.results import read_results, write_results
from tests.fixtures import pages


def results(spark, *confidences):
    rows = []
    for page, four in enumerate(confidences, 1):
        for f, c in zip(["title", "last_post_author", "last_post_date", "link"], four):
            rows.append((page, f, f"//{f}", "" if c == "failed" else "v", c, 1 if c == "correct" else 3, 0 if c == "failed" else 4, "//old" if f == "link" else None, "why" if f == "link" else None))
    return spark.createDataFrame(rows, RESULTS_DDL)


C, B, X = "correct", "best_effort", "failed"


def test_documents(spark, tmp_path):
    df = results(spark, (C, C, C, C), (C, B, X, X), (B, B, X, X))
    out = R.format_output(pages(spark, "a", "b", "c"), df).cache()
    got = {r["page_id"]: r for r in out.collect()}
    assert [got[p]["status"] for p in (1, 2, 3)] == ["success", "partial", "failed"]
    assert got[2]["summary"].asDict() == {"total_fields": 4, "correct": 1, "best_effort": 1, "failed": 2}
    assert got[2]["fields"]["link"]["sample_value"] is None and got[1]["fields"]["title"]["sample_value"] == "v"
    path = str(tmp_path / "out")
    write_results(out, path)
    back = {r["page_id"]: r for r in read_results(spark, path).collect()}
    assert {p: r["fields"] for p, r in back.items()} == {p: r["fields"] for p, r in got.items()}
    assert {r["domain"] for r in back.values()} == {"garden.example"}
    line = next(iter((tmp_path / "out").rglob("*.json"))).read_text().splitlines()[0]
    assert "explanation" in json.loads(line)["fields"]["title"]


def test_report_rows(spark):
    got = {(r["page_id"], r["pos"]): r for r in R.report_rows(results(spark, (C, B, X, C))).collect()}
    assert [got[1, i]["label"] for i in (1, 2, 3, 4)] == ["TITLE", "LAST POST AUTHOR", "LAST POST DATE", "LINK"]
    assert got[1, 1]["outcome"] == "✓ correct (1 iteration, 4 matches)"
    assert got[1, 2]["outcome"] == "⚠ best_effort (3 iterations, 4 matches)"
    assert got[1, 3]["outcome"] == "✗ failed (3 iterations, 0 matches)" and got[1, 3]["sample"] == "(none)"
    assert got[1, 4]["revised_from"] == "↳ Revised from: //old" and got[1, 4]["note"] == "ℹ why" and got[1, 1]["note"] is None


def test_unusable_pages(spark):
    df = spark.createDataFrame(
        [(1, "u", "<p>", 200), (2, "u", "<p>", 404), (3, "u", "<p>", None), (4, "u", " \n", 200), (5, "u", None, 301)],
        "page_id long, url string, html string, status int",
    )
    assert {r["page_id"]: r["reason"] for r in reject_pages(df).collect()} == {
        2: "HTTP 404", 3: "HTTP no response", 4: "Empty HTML returned", 5: "Empty HTML returned"}
    assert [r["page_id"] for r in usable_pages(df).collect()] == [1]
