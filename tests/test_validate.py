import random

from pyspark.sql import functions as F

from leafmark.functions.similarity import best_window_reaches
from leafmark.model import ATTEMPTS_DDL
from leafmark.operators import validate as V
from leafmark.operators.selectors import match_rows, match_sets
from tests.fixtures import body, nodes


def attempt(page, it, xpath, ok=False, n=0, values=()):
    return (page, "title", it, xpath, ok, n, list(values), "")


def best(spark, *rows):
    return {r["page_id"]: r for r in V.select_best(spark.createDataFrame(list(rows), ATTEMPTS_DDL)).collect()}


def test_select_best(spark):
    got = best(
        spark,
        attempt(1, 1, "//a", n=9, values=["z"]), attempt(1, 2, "//b", True, 2, ["x", "y"]), attempt(1, 3, "//c", True, 5, ["q"]),
        attempt(2, 1, "//a", n=3, values=["l"]), attempt(2, 2, "//b", n=25, values=["m"]), attempt(2, 3, "//c", n=25, values=["n"]),
        attempt(3, 1, "//a"), attempt(3, 2, "//b"), attempt(3, 3, None),
        attempt(4, 1, None), attempt(4, 2, ""),
        attempt(5, 1, None), attempt(5, 2, "//x", True, 1, ["s"]),
    )
    pick = {p: (r["xpath"], r["sample_value"], r["confidence"], r["match_count"], r["iterations"]) for p, r in got.items()}
    assert pick == {
        1: ("//b", "x", "correct", 2, 3), 2: ("//b", "m", "best_effort", 25, 3), 3: ("//b", "", "failed", 0, 3),
        4: ("", "", "failed", 0, 2), 5: ("//x", "s", "correct", 1, 2),
    }


def test_select_best_on_random_attempts(spark):
    rng, rows, want = random.Random(3), [], {}
    for page in range(400):
        tries = []
        for it in range(1, rng.randint(1, 3) + 1):
            x = rng.choice([None, "", "//a", "//b"])
            n = rng.choice([0, 0, 1, 5]) if x else 0
            tries.append(attempt(page, it, x, bool(n and rng.random() < 0.4), n, [f"v{it}"] * n))
        rows += tries
        right = [t for t in tries if t[4] and t[3]]
        some = [t for t in tries if t[3] and t[5] > 0]
        named = [t for t in tries if t[3]]
        if right:
            t, c = right[0], "correct"
        elif some:
            t, c = max(some, key=lambda a: a[5]), "best_effort"
        else:
            t, c = (named or [attempt(page, 0, "")])[-1], "failed"
        want[page] = (t[3], (t[6] or [""])[0], c, t[5])
    got = {p: (r["xpath"], r["sample_value"], r["confidence"], r["match_count"]) for p, r in best(spark, *rows).items()}
    assert got == want


def test_attempts_stop_at_the_first_correct_one(spark):
    rows = [attempt(1, 1, "a", True, 1), attempt(1, 2, "b"), attempt(2, 1, None), attempt(2, 2, "b", True, 1), attempt(2, 3, "c"),
            attempt(3, 1, "a"), attempt(3, 2, "b"), attempt(3, 3, "c"), attempt(3, 4, "d", True, 1)]
    got = V.run_attempts(spark.createDataFrame(rows, ATTEMPTS_DDL)).groupBy("page_id").count().collect()
    assert {r["page_id"]: r["count"] for r in got} == {1: 1, 2: 2, 3: 3}


def test_feedback(spark):
    html = body('<h1>The only headline</h1><ul>' + "".join(f"<li>item {i}</li>" for i in range(21)) + "</ul><p></p><i>Это актер театра</i>")
    n = nodes(spark, html)
    cases = [
        ("//h1", "The only headline", True, 1, "Correct"),
        ("//li", "item 7", True, 21, "Correct (found among 21 matches)"),
        ("//h2", "x", False, 0, "Missing: XPath matched 0 elements. Expected to find: 'x'"),
        ("//h1", "zzzz", False, 1, "Redundant: XPath matched 1 elements but none contained 'zzzz'. Matched: ['The only headline']"),
        ("//li", "qqqq", False, 21, "Redundant: XPath matched 21 elements but none contained 'qqqq'. Matched: ['item 0', 'item 1', 'item 2']"),
        ("//h1[", "x", False, 0, "XPath syntax error: Invalid expression: //h1["),
        ("//p", "anything", False, 1, "Redundant: XPath matched 1 elements but none contained 'anything'. Matched: ['']"),
        ("//h1[.='The only headline']", "The only headline", False, 0, None),
        ("//h1[.='the ONLY headline']", "The only headline", False, 0, None),
        ("//h1/@the", "the", False, 0, None),
        (None, "x", False, 0, "Invalid JSON response"),
        ("//h1", "only", True, 1, "Correct"),
        ("//h1", "well: The only headline, again", True, 1, "Correct"),
        ("//i", "актёр театра", True, 1, "Correct"),
    ]
    sel = spark.createDataFrame([(1, f"f{i}", 1, c[0]) for i, c in enumerate(cases)], "page_id long, field string, iteration int, xpath string")
    ie = spark.createDataFrame([(1, f"f{i}", c[1]) for i, c in enumerate(cases)], "page_id long, field string, value string")
    got = {r["field"]: r for r in V.classify_feedback(n, sel, ie).collect()}
    for i, (_, _, ok, count, message) in enumerate(cases):
        r = got[f"f{i}"]
        assert (r["is_correct"], r["match_count"]) == (ok, count), cases[i]
        if message:
            assert r["feedback_message"] == message
    assert got["f7"]["feedback_message"].startswith("Hardcoded value") and got["f8"]["feedback_message"].startswith("Hardcoded value")
    assert got["f9"]["feedback_message"].startswith("Missing")


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def _best_window(a, b):
    if not a or not b:
        return 100.0 if not a and not b else 0.0
    best = 0.0
    for s, l in ([(a, b)] if len(a) < len(b) else [(b, a)] if len(a) > len(b) else [(a, b), (b, a)]):
        windows = [l[max(0, i):i + len(s)] for i in range(1 - len(s), len(l))]
        best = max(best, max(200.0 * _lcs(s, w) / (len(s) + len(w)) for w in windows if w))
    return best


def test_best_window_against_brute_force():
    rng = random.Random(5)
    for _ in range(600):
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))
        b = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))
        if rng.random() < 0.5 and a:
            at = rng.randrange(len(a))
            b = b + a[:at] + rng.choice("abcdx") + a[at + 1:] + b
        for floor in (60.0, 85.0):
            assert best_window_reaches(a, b, floor) == (_best_window(a, b) >= floor), (a, b)


def test_summary_lines(spark):
    rows = [(1, "title", "correct", 1), (2, "title", "correct", 1), (1, "link", "failed", 3), (2, "link", "best_effort", 2)]
    df = spark.createDataFrame(rows, "page_id long, field string, confidence string, iterations int")
    got = {(r["field"], r["n"], r["line"]) for r in V.confidence_summary(df).collect()}
    assert got == {
        ("title", 2, "right value found after 1 iteration"), ("link", 1, "nothing found in 3 iterations"),
        ("link", 1, "only other values found in 2 iterations"),
    }


def test_spellings_of_one_set_are_judged_once(spark):
    n = nodes(spark, body('<div class="r"><a href="/1">One</a></div><div class="r"><a href="/2">Two</a></div><i>x</i>'))
    forms = ["//a", "//div/a", "//body/div/a", "//div[contains(@class,'r')]/a", "//a/@href", "//div/a/@href", "string(//a)", "//a[@href='/2']", "//i"]
    rows = spark.createDataFrame([(1, x) for x in forms], "page_id long, xpath string")
    sets = {frozenset(m.xpath for m in r.members) for r in match_sets(n, rows).collect()}
    assert sets == {frozenset(forms[:4]), frozenset(forms[4:6]), *(frozenset([x]) for x in forms[6:])}
    found = {}
    for r in match_rows(n, rows).collect():
        found.setdefault(r.xpath, []).append(r.value)
    assert {x: sorted(v) for x, v in found.items()} == {
        **dict.fromkeys(forms[:4], ["One", "Two"]), **dict.fromkeys(forms[4:6], ["/1", "/2"]),
        "string(//a)": ["One", "Two"], "//a[@href='/2']": ["Two"], "//i": ["x"],
    }


def test_much_text_is_compared_as_little_text_is(spark, monkeypatch):
    n = nodes(spark, body("<i>A quince in a garden</i><i></i><b>nothing like it</b><u>A quince</u><u>in the garden</u>"))
    cases = [("//i", "a quinc in a garden"), ("//b", "a quinc in a garden"), ("//body/i", "zzz"), ("//i", None), ("string(//i)", "a qince in a garden"),
             ("string(//u)", "in tge garden"), ("//u", "in tge garden"), ("//em", "x")]
    sel = spark.createDataFrame([(1, f"f{i}", 1, x) for i, (x, _) in enumerate(cases)], "page_id long, field string, iteration int, xpath string")
    ie = spark.createDataFrame([(1, f"f{i}", e) for i, (_, e) in enumerate(cases)], "page_id long, field string, value string")
    few = sorted(V.classify_feedback(n, sel, ie).collect())
    assert [r.is_correct for r in few] == [True, False, False, False, True, False, True, False]
    assert [r.match_count for r in few] == [2, 1, 2, 2, 1, 1, 2, 0]
    monkeypatch.setattr(V, "MOST_OPEN_BYTES", 0)
    assert sorted(V.classify_feedback(n, sel, ie).collect()) == few
