import pytest
from pyspark.sql import functions as F

from leafmark.operators import selectors as S
from leafmark.operators.tree import page_xml
from tests.fixtures import body, nodes, pages, thread_list

PAGE = body(
    '<div class="box big"><p class="t"> one <b>two</b></p><p>three</p><a href="/m/1" id="x">l1</a></div>'
    '<div class="a/b"><div class="box"><p>four</p><a href="/t/2" class="t u">l2</a><a>none</a></div></div>'
)


def run(spark, xpath, html=PAGE):
    return [r["value"] for r in S.eval_selector(nodes(spark, html), xpath).orderBy("node_id").collect()]


CASES = {
    "//p": ["one two", "three", "four"],
    "//div/p/text()": ["one", "three", "four"],
    "//p//text()": ["one", "two", "three", "four"],
    "//a/@href": ["/m/1", "/t/2"],
    "//div[contains(@class, 'box')]/p": ["one two", "three", "four"],
    "//div[@class='box']/p": ["four"],
    '//div[@class="a/b"]//p': ["four"],
    "//div[starts-with(@class,'box') and contains(@class,'big')]/a": ["l1"],
    "//a[contains(@href,'/m/')]": ["l1"],
    "//a[@id]/@href": ["/m/1"],
    "//a[@class]": ["l2"],
    "//*[contains(@class,'t')]/@class": ["t", "t u"],
    "//div//div/a": ["l2", "none"],
    "/html/body/div/a": ["l1"],
    "/body/div": [],
    "//div[contains(@class,'b')]//a": ["l1", "l2", "none"],
    "string(//p)": ["one two"],
    "//table//td": [],
    "//div//@href": ["/m/1", "/t/2"],
    "//b": ["two"],
}


def test_values_of_many_selectors_both_ways(spark):
    n = nodes(spark, PAGE).cache()
    named = S.eval_selectors(n, {x: x for x in CASES}).orderBy("node_id").collect()
    table = spark.createDataFrame([(1, x) for x in CASES], "page_id long, xpath string")
    listed = S.eval_selector_table(n, table).orderBy("node_id").collect()
    for x, want in CASES.items():
        assert [r["value"] for r in named if r["field"] == x] == want, x
        assert [r["value"] for r in listed if r["xpath"] == x] == want, x


def test_nested_matches_each_have_their_text(spark):
    assert run(spark, "//div", body("<div>a<div>b</div>c</div>")) == ["abc", "b"]


def test_counts_agree_with_sparks_own_xpath(spark):
    n = nodes(spark, PAGE, thread_list(5, plain_author=(1,)), thread_list(3, extra_link=True)).cache()
    xml = page_xml(n).cache()
    paths = ["//div", "//div/a", "//*[contains(@class,'row')]//a/@href", "//a[contains(@class,'user')]", "//nav//li/a/text()"]
    ours = S.match_counts(pages(spark, "", "", ""), paths, S.eval_selectors(n, {x: x for x in paths}))
    ours = {(r["page_id"], r["field"]): r["match_count"] for r in ours.collect()}
    for x in paths:
        for r in S.eval_selector_literal(xml, x).collect():
            assert ours[r["page_id"], x] == r["n"], x


def test_syntax(spark):
    rows = [("//a",), ("//a[",), ("",), (None,), ("a b",), ("//a[1]",), ("//div[@id='x']/a",), ("//div[contains(., 'x')]",), ("//a/@data-id",), ("string(//h1)",)]
    by = {r["xpath"]: r["problem"] for r in S.check_syntax(spark.createDataFrame(rows, "xpath string")).collect()}
    got = [by[x] for (x,) in rows]
    assert [g is None for g in got] == [True, False, False, False, False, False, False, False, True, True]
    assert got[6].startswith("Unsupported") and got[1].startswith("Invalid expression")
    with pytest.raises(ValueError):
        S.eval_selectors(nodes(spark, PAGE), {"bad": "//a["})


def test_broken_selectors_of_a_table_give_nothing(spark):
    n = nodes(spark, PAGE)
    t = spark.createDataFrame([(1, "//a["), (1, None), (1, "//b"), (2, "//b")], "page_id long, xpath string")
    assert [(r["page_id"], r["value"]) for r in S.eval_selector_table(n, t).collect()] == [(1, "two")]


def test_quotes_and_special_characters_in_class_tests(spark):
    html = body('<p class="a.b[c]\\E|d">x</p><p class="axb">y</p>')
    assert run(spark, "//p[contains(@class,'a.b')]", html) == ["x"]
    assert run(spark, "//p[contains(@class,'\\E|d')]", html) == ["x"]


def test_element_selector(spark):
    cases = [("//a/text()", "//a"), ("//a/@href", "//a"), ("string(//a/@href)", "//a"), (" //a ", "//a"), ("//a/@data-id", "//a/@data-id"), ("//div/text()/x", "//div/text()/x")]
    df = spark.createDataFrame(cases, "x string, want string")
    assert all(r[0] == r[1] for r in df.select(S.element_selector(F.col("x")), "want").collect())


def test_text_tests_against_sparks_own_xpath(spark):
    html = body('<p> one </p><p>one</p><div>one<b>one</b></div><a>three</a><p>one<i>x</i>one</p><span>Éêvi.</span>')
    n = nodes(spark, html).cache()
    xml = page_xml(n).cache()
    paths = ["//*[text()='one']", "//p[text()=' one ']", "//b[text()=\"one\"]", "//*[text()='éêvi.']", "//*[text()='Éêvi.']",
             "//a[text()='three' and text()='three']", "//p[text()='x']"]
    table = spark.createDataFrame([(1, x) for x in paths], "page_id long, xpath string")
    listed = S.match_counts(pages(spark, ""), paths, S.eval_selector_table(n, table).withColumnRenamed("xpath", "field"))
    ours = {r["field"]: r["match_count"] for r in listed.collect()}
    for x in paths:
        (want,) = S.eval_selector_literal(xml, x).collect()
        assert ours[x] == want["n"], x
    assert ours["//*[text()='one']"] == 4 and ours["//*[text()='éêvi.']"] == 0


def test_function_literals_are_valid_but_unsupported(spark):
    rows = [("count(//a)",), ("normalize-space(//h1)",), ("count(//a",), ("//*[text()='x']",), ("//div[text()='x']//a",)]
    by = {r["xpath"]: r["problem"] for r in S.check_syntax(spark.createDataFrame(rows, "xpath string")).collect()}
    assert by["count(//a)"].startswith("Unsupported") and by["normalize-space(//h1)"].startswith("Unsupported")
    assert by["count(//a"].startswith("Invalid expression")
    assert by["//*[text()='x']"] is None and by["//div[text()='x']//a"].startswith("Unsupported")
