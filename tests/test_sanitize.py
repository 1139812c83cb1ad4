import random

from pyspark.sql import functions as F

from leafmark.model import BLOCKED_TAGS, STRUCTURAL_TAGS
from leafmark.operators import sanitize as S
from leafmark.sources.html_tree import _read_page, shred_html
from tests.fixtures import body, nodes, pages, thread_list

CASES = [
    ("<script>alert(1)</script><style>p{}</style><svg><path/></svg><img src=x><p>kept</p>", "<p>kept</p>"),
    ("<p>kept</p><!-- secret --><?pi x?>", "<p>kept</p>"),
    ('<div class="a" id="b" data-x="1" aria-label="l"><p class="c">t</p></div>', "<div><p>t</p></div>"),
    ('<a href="/x" class="y">go</a>', '<a href="/x">go</a>'),
    ('<a href="">go</a>', "<a>go</a>"),
    ("<p>a<span></span></p><span>  </span>", "<p>a</p>"),
    ("<p>a<span><em></em></span></p>", "<p>a</p>"),
    ("<div></div><ul><li></li></ul>", "<div></div><ul><li></li></ul>"),
    ("<p><span></span>tail text</p>", "<p>tail text</p>"),
    ("<p>x<b>y</b> <span></span> \n<i>z</i></p>", "<p>x<b>y</b> <i>z</i></p>"),
    ("<p><img> <img>text</p>", "<p> text</p>"),
    ("<form><p>gone</p></form><span><div></div></span>", "<span><div></div></span>"),
]


def test_cases(spark):
    out = S.sanitize_pages(nodes(spark, *[body(c) for c, _ in CASES])).orderBy("page_id").collect()
    assert [r["sanitized"] for r in out] == [f"<html><body>{want}</body></html>" for _, want in CASES]


def _step_by_step(rows):
    """Bottom-up removal on a small tree with text slots, written out plainly."""
    text, tail, kids, parent = {}, {}, {}, {}
    tag, kind = {}, {}
    for r in rows:
        _, node_id, _, par, prev, _, k, t, _, txt = r[:10]
        if k == "text":
            (tail if prev else text)[prev or par] = txt
            continue
        kind[node_id], tag[node_id], parent[node_id] = k, t, par
        kids.setdefault(node_id, [])
        if par:
            kids[par].append(node_id)
    for node in sorted(tag, reverse=True):
        gone = kind[node] != "el" or tag[node] in BLOCKED_TAGS or (
            tag[node] not in STRUCTURAL_TAGS and not text.get(node, "").strip() and not kids[node]
        )
        if not gone or parent[node] is None:
            continue
        siblings = kids[parent[node]]
        at = siblings.index(node)
        rest = tail.get(node, "")
        if rest.strip():
            if at:
                tail[siblings[at - 1]] = tail.get(siblings[at - 1], "") + rest
            else:
                text[parent[node]] = text.get(parent[node], "") + rest
        siblings.remove(node)

    def write(node):
        inner = text.get(node, "") + "".join(write(k) + tail.get(k, "") for k in kids[node])
        return f"<{tag[node]}>{inner}" + ("" if tag[node] == "br" else f"</{tag[node]}>")

    return write(1)


def test_closed_form_equals_step_by_step_removal(spark):
    rng = random.Random(7)

    def markup(depth):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(["", " ", "t", " u "]))
            name = rng.choice(["span", "em", "div", "img", "script", "br", "!", "span"])
            if name in ("img", "br"):
                parts.append(f"<{name}>")
            elif name == "!":
                parts.append("<!--c-->")
            elif name == "script":
                parts.append("<script>s</script>")
            else:
                parts.append(f"<{name}>{markup(depth - 1) if depth else rng.choice(['', ' ', 'x'])}</{name}>")
        parts.append(rng.choice(["", " ", "v"]))
        return "".join(parts)

    htmls = [body(f"<div>{markup(3)}</div>") for _ in range(300)]
    got = {r["page_id"]: r["sanitized"] for r in S.sanitize_pages(nodes(spark, *htmls)).collect()}
    for i, html in enumerate(htmls):
        assert got[i + 1] == _step_by_step(_read_page(1, html)), html


def test_survivors_are_a_subset_closed_under_parents(spark):
    n = nodes(spark, thread_list(4)).cache()
    kept = S.sanitize_nodes(n).cache()
    assert kept.select("page_id", "node_id").subtract(n.select("page_id", "node_id")).count() == 0
    orphans = kept.filter("parent_id is not null").join(
        kept.select("page_id", F.col("node_id").alias("parent_id")), ["page_id", "parent_id"], "left_anti"
    )
    assert orphans.count() == 0


def test_blocked_set_is_a_parameter(spark):
    n = nodes(spark, body("<form><p>in form</p></form>"))
    assert S.sanitize_nodes(n).filter("tag = 'p'").count() == 0
    assert S.sanitize_nodes(n, blocked=["head"]).filter("tag = 'p'").count() == 1


def test_rehomed_tails(spark):
    n = nodes(spark, body("<p>a<b>x</b><img>c<img>d</p>"))
    got = {(r["slot"], r["text"]) for r in S.rehome_tails(n).collect()}
    assert got == {("text", "a"), ("text", "x"), ("tail", "cd")}


def test_rejects_and_reduction(spark):
    p = pages(spark, "", " \n ", body("<script>long long long</script><p>x</p>"))
    assert {(r["page_id"], r["reason"]) for r in S.reject_sanitized(p).collect()} == {
        (1, "Input HTML is empty"), (2, "Input HTML is empty")}
    good = p.filter("page_id = 3")
    row = S.reduction_ratio(good, S.sanitize_pages(shred_html(good))).first()
    assert row["reduction_pct"] == round(100 * (1 - row["kb_out"] / row["kb_in"]), 1) > 0


def test_result_does_not_depend_on_partitioning(spark):
    p = pages(spark, *[thread_list(i) for i in range(1, 8)])
    one = S.sanitize_pages(shred_html(p.coalesce(1))).collect()
    many = S.sanitize_pages(shred_html(p.repartition(7))).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))
