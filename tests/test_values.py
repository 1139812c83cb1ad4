import json

from pyspark.sql import functions as F

from leafmark.functions.text import WHITESPACE, fix_mojibake, garble, strip, url_domain
from leafmark.operators import values as V


def answer(**changed):
    good = {f: {"value": f"v-{f}", "cue_text": ""} for f in ("title", "last_post_author", "last_post_date", "link")}
    for name, part in changed.items():
        if part is None:
            del good[name]
        else:
            good[name] = part
    return json.dumps(good)


def test_answers(spark):
    rows = [
        (1, 1, answer()), (2, 1, "not json"), (2, 2, answer()), (3, 1, answer(title=None)), (3, 2, "[]"), (3, 3, answer()),
        (4, 1, answer(link={"value": "", "cue_text": "x"})), (5, 1, answer(last_post_date={"value": "", "cue_text": ""}, link={"value": "", "cue_text": ""})),
        (6, 1, answer(title={"value": 5, "cue_text": ""})), (6, 2, answer(title={"value": "t", "cue_text": "", "more": 1})),
        (7, 1, answer(title={"value": "ÐŸÑ€Ð¸Ð²ÐµÑ‚", "cue_text": ""}).replace("ÐŸÑ€Ð¸Ð²ÐµÑ‚", "x")),
        (8, 1, answer(title={"value": "Привет".encode().decode("latin-1"), "cue_text": ""})),
    ]
    values, problems = V.extract_values(spark.createDataFrame(rows, "page_id long, try_no int, content string"))
    got = {(r["page_id"], r["field"]): (r["value"], r["cue_text"]) for r in values.collect()}
    assert {p for p, _ in got} == {1, 2, 4, 6, 7, 8}
    assert got[4, "link"] == ("v-title", "") and got[6, "title"] == ("t", "") and got[8, "title"] == ("Привет", "")
    assert {(r["page_id"], r["reason"]) for r in problems.collect()} == {
        (3, "invalid JSON or schema mismatch"), (5, "Empty value for required field: last_post_date")}


def test_selector_and_revision_answers(spark):
    rows = [(1, '{"thought": "t", "xpath": "//a"}'), (2, '{"xpath": "//a"}'), (3, '{"thought": "t", "xpath": 3}'), (4, "x")]
    got = V.parse_selector_answers(spark.createDataFrame(rows, "page_id long, content string")).orderBy("page_id").collect()
    assert [r["xpath"] for r in got] == ["//a", None, None, None]
    rows = [
        (1, '{"explanation": "e", "revised_xpath": "//a"}'), (2, '{"explanation": "e", "revised_xpath": null}'),
        (3, '{"explanation": "e"}'), (4, '{"explanation": "e", "revised_xpath": 1}'), (5, "?"),
    ]
    got = V.parse_revision_answers(spark.createDataFrame(rows, "page_id long, content string")).orderBy("page_id").collect()
    assert [(r["explanation"], r["revised_xpath"]) for r in got] == [("e", "//a"), ("e", None), (None, None), (None, None), (None, None)]


def test_mojibake(spark):
    texts = ["Привет", "plain", "", "é", "naïve café", "日本語 text"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", fix_mojibake(garble(F.col("t"))).alias("back"), fix_mojibake(F.col("t")).alias("same")).collect():
        assert r["back"] == r["t"] and r["same"] == r["t"]


def test_strip_is_unicode(spark):
    assert len(WHITESPACE) == len(set(WHITESPACE)) and all(not c.strip() for c in WHITESPACE)
    assert {chr(c) for c in range(0x110000) if chr(c).isspace()} == set(WHITESPACE)
    df = spark.createDataFrame([("   a b　\x1f\n",)], "t string")
    assert df.select(strip(F.col("t"))).first()[0] == "a b"


def test_url_domain(spark):
    cases = [("https://a.b:80/x?y", "a.b:80"), ("http://u:p@h/", "u:p@h"), ("//h/x", "h"), ("no scheme", "unknown"), ("https:///x", "unknown"), ("http://h?q#f", "h"), ("http://sp ace/x y", "sp ace")]
    df = spark.createDataFrame(cases, "u string, want string")
    assert all(r[0] == r[1] for r in df.select(url_domain(F.col("u")), "want").collect())
