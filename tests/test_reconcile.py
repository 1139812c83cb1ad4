import random

from pyspark.sql import functions as F

from leafmark.model import RESULTS_DDL, REVISIONS_DDL
from leafmark.operators import reconcile as R
from leafmark.operators.selectors import eval_selector_table
from leafmark.operators.validate import classify_feedback, select_best
from tests.fixtures import body, nodes, thread_list

FIELDS = ["title", "last_post_author", "last_post_date", "link"]


def results(spark, *counts, confidence=None):
    rows = []
    for page, four in enumerate(counts, 1):
        for f, n in zip(FIELDS, four):
            rows.append((page, f, f"//{f}", "s", (confidence or {}).get((page, f), "correct"), 1, n, None, None))
    return spark.createDataFrame(rows, RESULTS_DDL)


def test_counts_and_flags(spark):
    df = R.with_flags(results(
        spark, (20, 20, 20, 20), (20, 18, 20, 60), (15, 15, 15, 15), (0, 0, 0, 7), (18, 20, 60, 20), (5, 5, 3, 5),
        confidence={(6, "last_post_date"): "failed"},
    )).cache()
    by = {(r["page_id"], r["field"]): r for r in df.collect()}
    assert {k: r["flag"] for k, r in by.items() if r["flag"]} == {
        (2, "link"): "broad", (2, "last_post_author"): "few", (4, "title"): "few", (4, "last_post_author"): "few",
        (4, "last_post_date"): "few", (5, "last_post_date"): "broad", (5, "title"): "few", (6, "last_post_date"): "skipped",
    }
    ref = {p: (r["reference_count"], r["reference_field"]) for (p, _), r in by.items()}
    assert ref == {1: (20, "title"), 2: (20, "title"), 3: (15, "title"), 4: (7, "link"), 5: (20, "link"), 6: (5, "title")}
    assert {r["page_id"] for r in R.noop_pages(df).collect()} == {1, 3, 6}


def found(n, xpath):
    return eval_selector_table(n, n.sparkSession.createDataFrame([(1, xpath)], "page_id long, xpath string"))


def test_rows_of_a_list(spark):
    n = nodes(spark, thread_list(3, plain_author=(1,))).cache()
    refs, users = found(n, "//a[contains(@class,'subject')]"), found(n, "//a[contains(@class,'user')]")
    rows = R.row_containers(refs).cache()
    assert rows.count() == 3
    bad = R.row_markup(n, R.problem_rows(rows, users, ["page_id"])).collect()
    assert len(bad) == 1 and '<span class="user">memberb</span>' in bad[0]["row_html"] and bad[0]["row_html"].startswith('<div class="row js-1">')
    assert R.problem_rows(rows, found(n, "//time"), ["page_id"]).count() == 0
    assert R.good_rows(rows, found(n, "//time"), ["page_id"]).count() == 2
    assert R.row_containers(found(n, "//table")).count() == 0
    assert R.row_containers(found(n, "//nav/ul/li/a[contains(@href,'/s')]")).count() == 0
    over = R.overmatched_row(rows, found(n, "//div[contains(@class,'last')]/*"), ["page_id"]).first()
    assert over["matched_in_row"] == ["Latest:", "membera", "2 minutes ago"]


def test_rows_against_climbing(spark):
    rng = random.Random(11)

    def markup(depth):
        name = rng.choice(["div", "b", "i"])
        inner = "".join(markup(depth - 1) for _ in range(rng.randint(0, 3))) if depth else ""
        return f"<{name}>{inner}</{name}>"

    n = nodes(spark, *[body("".join(markup(3) for _ in range(2))) for _ in range(60)]).cache()
    all_rows = n.filter("kind = 'el'").collect()
    got = {(r["page_id"], r["row_id"]) for r in R.row_containers(n.filter("tag = 'b'")).collect()}
    want = set()
    for page in range(1, 61):
        here = {r["node_id"]: r for r in all_rows if r["page_id"] == page}
        refs = [r for r in here.values() if r["tag"] == "b"]
        for r in refs:
            current, parent = r["node_id"], r["parent_id"]
            while parent is not None:
                if sum(parent in x["anc"] for x in refs) > 1:
                    want.add((page, current))
                    break
                current, parent = parent, here[parent]["parent_id"]
    assert got == want


def test_accepting_revisions(spark):
    ddl = "page_id long, field string, flag string, iteration int, explanation string, revised_xpath string, old_count int, new_count int, is_correct boolean, first_value string"
    rows = [
        (1, "title", "few", 1, "a", "//x", 2, 3, True, "v"), (1, "title", "few", 2, "b", "//y", 2, 9, True, "w"),
        (2, "title", "few", 1, "a", "//x", 2, 2, True, "v"), (2, "title", "few", 2, "b", "//y", 2, 1, True, "w"),
        (3, "title", "few", 1, "a", None, 2, 0, False, None), (3, "title", "few", 2, "b", "//y", 2, 3, True, "w"),
        (4, "title", "few", 1, None, None, 2, 0, False, None), (4, "title", "few", 2, "b", "//y", 2, 3, True, "w"),
        (5, "title", "broad", 1, "a", "//x", 9, 12, True, "v"), (5, "title", "broad", 2, "b", "//y", 9, 3, True, "w"),
        (6, "title", "few", 1, "a", "//x", 2, 5, False, "v"), (6, "title", "few", 2, "b", "//y", 2, 5, False, "w"),
        (7, "title", "few", 1, "a", "//x", 2, 2, True, "v"), (7, "title", "few", 2, "b", "//y", 2, 2, True, "w"), (7, "title", "few", 3, "c", "//z", 2, 5, True, "w"),
    ]
    got = {r["page_id"]: (r["new_xpath"], r["new_count"], r["new_explanation"]) for r in R.accept_revision(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {1: ("//x", 3, "a"), 2: (None, None, "b"), 3: (None, None, "a"), 4: (None, None, None), 5: ("//y", 3, "b"), 6: (None, None, "b"), 7: (None, None, "b")}


def test_reconcile_pages(spark):
    # Page 1 misses one author, page 2 agrees, page 3 takes too many titles.
    htmls = [thread_list(3, plain_author=(1,)), thread_list(3), thread_list(4)]
    n = nodes(spark, *htmls).cache()
    sel, ie = [], []
    for p in (1, 2, 3):
        paths = {"title": "//a[contains(@class,'subject')]", "last_post_author": "//a[contains(@class,'user')]", "last_post_date": "//time", "link": "//a[contains(@class,'subject')]/@href"}
        if p == 3:
            paths["title"] = "//div[contains(@class,'list')]//*"
        values = {"title": "How to grow quinces, part one", "last_post_author": "membera", "last_post_date": "2 minutes ago", "link": "/threads/0"}
        sel += [(p, f, 1, x) for f, x in paths.items()]
        ie += [(p, f, v) for f, v in values.items()]
    start = select_best(classify_feedback(
        n, spark.createDataFrame(sel, "page_id long, field string, iteration int, xpath string"),
        spark.createDataFrame(ie, "page_id long, field string, value string"),
    )).cache()
    revisions = spark.createDataFrame([
        (1, "last_post_author", 1, "span, not a", "//*[contains(@class,'user')]"),
        (2, "last_post_author", 1, "never asked", "//*[contains(@class,'user')]"),
        (3, "title", 1, "still everything", "//div[contains(@class,'list')]//div"),
        (3, "title", 2, "links only", "//a[contains(@class,'subject')]"),
    ], REVISIONS_DDL)
    before = {(r["page_id"], r["field"]): r for r in start.collect()}
    after = {(r["page_id"], r["field"]): r for r in R.reconcile(n, start, revisions).collect()}
    assert after.keys() == before.keys()
    changed = {k for k in after if after[k] != before[k]}
    assert changed == {(1, "last_post_author"), (3, "title")}
    a = after[1, "last_post_author"]
    assert (a["xpath"], a["match_count"], a["original_xpath"], a["explanation"], a["sample_value"]) == (
        "//*[contains(@class,'user')]", 3, "//a[contains(@class,'user')]", "span, not a", "membera")
    # The first narrower selector already moves the right way and still finds the value.
    t = after[3, "title"]
    assert (t["xpath"], t["match_count"], t["explanation"]) == ("//div[contains(@class,'list')]//div", 12, "still everything")


def test_evidence(spark):
    n = nodes(spark, thread_list(4, plain_author=(1, 2))).cache()
    rows = [(1, "title", "//a[contains(@class,'subject')]", "x", "correct", 1, 4, None, None), (1, "last_post_author", "//a[contains(@class,'user')]", "x", "correct", 1, 2, None, None),
            (1, "last_post_date", "//div[contains(@class,'list')]//*", "x", "correct", 1, 28, None, None), (1, "link", "//a[contains(@class,'subject')]/@href", "x", "correct", 1, 4, None, None)]
    flagged = R.with_flags(spark.createDataFrame(rows, RESULTS_DDL))
    got = {r["field"]: r for r in R.discrepancy_evidence(n, flagged).collect()}
    few, broad = got["last_post_author"], got["last_post_date"]
    assert (few["missing"], few["ratio"], len(few["problem_rows"]), len(few["good_rows"])) == (2, 0.5, 2, 2)
    assert few["title_count"] == 4 and few["link_xpath"].endswith("@href")
    assert broad["ratio"] == 7.0 and len(broad["matched_in_row"]) == 5 and broad["example_row"].startswith('<div class="row js-0">')
