import pytest

from leafmark.operators.tree import ancestors_of, node_path, page_xml, serialize
from leafmark.sources import html_tree
from leafmark.operators.selectors import eval_selector
from leafmark.sources.html_tree import _read_page, shred_html, write_nodes
from tests.fixtures import body, nodes, pages, thread_list


def rows(html):
    names = html_tree._COLUMNS
    return [dict(zip(names, r)) for r in _read_page(1, html)]


def shape(html):
    return [(r["depth"], r["tag"] or r["text"]) for r in rows(html) if r["tag"] not in ("html", "head", "body")]


@pytest.mark.parametrize("html, expected", [
    ("<p>a<p>b", [(3, "p"), (4, "a"), (3, "p"), (4, "b")]),
    ("<p><b>a<br><p>b", [(3, "p"), (4, "b"), (5, "a"), (5, "br"), (3, "p"), (4, "b")]),
    ("<ul><li>a<li>b</ul>c", [(3, "ul"), (4, "li"), (5, "a"), (4, "li"), (5, "b"), (3, "c")]),
    ("<table><tr><td>a<td>b<tr><td>c</table>",
     [(3, "table"), (4, "tr"), (5, "td"), (6, "a"), (5, "td"), (6, "b"), (4, "tr"), (5, "td"), (6, "c")]),
    ("<div><p>a</div>b", [(3, "div"), (4, "p"), (5, "a"), (3, "b")]),
    ("<p>a</div>b</p>", [(3, "p"), (4, "ab")]),
    ("x</p>y", [(3, "x"), (3, "p"), (3, "y")]),
    ("<div><span/>a</div>", [(3, "div"), (4, "span"), (4, "a")]),
    ("<script>if(a<b)'</p>'</script>a", [(3, "script"), (4, "if(a<b)'</p>'"), (3, "a")]),
    ("a &lt;b&gt; &amp;amp; 1 < 2", [(3, "a <b> &amp; 1 < 2")]),
])
def test_tolerant_reading(html, expected):
    assert shape(html) == expected


def test_wrapper_elements_and_attributes():
    r = rows('<HTML lang=en><body class="a/b" class="second"><a HREF="x?a=1&amp;b=2" title=\'t "q"\' checked>l</a>')
    assert [x["tag"] for x in r] == ["html", "body", "a", None]
    assert dict(r[0]["attrs"]) == {"lang": "en"}
    assert dict(r[1]["attrs"]) == {"class": "a/b"}
    assert dict(r[2]["attrs"]) == {"href": "x?a=1&b=2", "title": 't "q"', "checked": ""}
    assert r[2]["trail"] == "/html|/body|a\x01b/a|"


def test_ranges_siblings_and_text_counts():
    r = {x["node_id"]: x for x in rows(body("<div>a<!-- c --><b>b</b>t</div><p>z</p>"))}
    for x in r.values():
        inside = [y for y in r.values() if x["node_id"] in y["anc"]]
        assert x["last_id"] == max([y["node_id"] for y in inside] + [x["node_id"]])
        own = [y for y in inside + [x] if y["kind"] == "text"]
        assert x["text_to"] - x["text_from"] == len(own)
        assert x["parent_id"] == (x["anc"][-1] if x["anc"] else None)
        before = [y["node_id"] for y in r.values() if y["parent_id"] == x["parent_id"] and y["node_id"] < x["node_id"]]
        assert x["prev_id"] == (max(before) if before else None)


def test_hostile_pages_stay_whole():
    deep = rows("<div>" * 1000 + "end")
    assert max(x["depth"] for x in deep) == 1003
    assert sum(x["tag"] == "div" for x in deep) == 1000
    assert rows('<a href="x>never closed')[-1]["text"] == "never closed"
    assert len(_read_page(1, "<a" * 200_000)) == 3


def test_many_rows_are_split_into_batches(spark):
    big = "<p>x</p>" * 20_000
    n = shred_html(pages(spark, big, "<p>y</p>"))
    assert n.filter("tag = 'p'").groupBy("page_id").count().orderBy("page_id").collect()[0]["count"] == 20_000


def test_serialize_then_shred_is_stable(spark):
    htmls = [thread_list(3), body("<p>a &amp; b<br>c<!-- n --><i>d</i> e</p>"), "<ul><li>1<li>2</ul>"]
    once = serialize(nodes(spark, *htmls))
    again = serialize(shred_html(once.withColumnRenamed("markup", "html")))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))


def test_page_xml_is_well_formed(spark):
    import xml.etree.ElementTree as ET

    odd = body('<p @click="x" a:b="y" title="&quot;&lt;">a\x01<br>&amp;<o:p>o</o:p></p><script>a<b && c</script>')
    for row in page_xml(nodes(spark, odd, thread_list(2))).collect():
        ET.fromstring(row["xml"])


def test_paths_and_ancestors(spark):
    n = nodes(spark, body("<div>a</div><div><b>x</b><i>y</i><b>z</b></div>"))
    paths = {r["path"] for r in node_path(n).collect()}
    assert "/html/body/div[2]/b[2]" in paths and "/html/body/div[2]/i" in paths and "/html/body/div[1]" in paths
    wanted = n.filter("tag = 'i'")
    assert [r["path"] for r in node_path(n, wanted).collect()] == ["/html/body/div[2]/i"]
    tags = n.join(ancestors_of(wanted), ["page_id", "node_id"], "left_semi").orderBy("node_id").select("tag")
    assert [r["tag"] for r in tags.collect()] == ["html", "body", "div"]


def test_deep_pages_keep_their_depth_everywhere(spark):
    n = nodes(spark, body("<div class='row'>" * 1500 + "<b>end</b>" + "</div>" * 1500), thread_list(2))
    path = node_path(n, n.filter("tag = 'b' and depth > 1000")).collect()[0]["path"]
    assert path == "/html/body" + "/div" * 1500 + "/b"
    assert page_xml(n).filter("page_id = 1").collect()[0]["xml"].count("</div>") == 1500
    found = eval_selector(n, "//body//div//b").filter("page_id = 1").collect()
    assert [r["value"] for r in found] == ["end"]


def test_source_is_read_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    source = pages(spark, thread_list(2), thread_list(3), thread_list(2))
    write_nodes(source.mapInArrow(count, source.schema))
    assert reads.value == 3
