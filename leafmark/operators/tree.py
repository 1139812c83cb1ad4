"""Walking the page tree: ancestors, paths, text content, serialising back to markup.

Joins here are equi-joins on (page_id, node_id): ancestor ids are exploded from `anc`, so no
step compares the nodes of a page with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leafmark.functions.text import escape_markup, strip
from leafmark.sources.html_tree import VOID_TAGS


def elements(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind") == "el")


def trail_tags() -> Column:
    """Tags from the root down, read off the trail."""
    steps = F.filter(F.split("trail", "/"), lambda s: s != "")
    return F.transform(steps, lambda s: F.substring_index(s, "|", 1))


def in_tags(tags: list[str]) -> Column:
    """Is the node one of these elements or below one? A row-local test on the trail."""
    return F.col("trail").rlike(f"/(?:{'|'.join(tags)})\\|")


def attr_value(nodes: DataFrame, tag: str, name: str) -> DataFrame:
    """(page_id, node_id, value) of an attribute, stripped, where it is present."""
    return (
        elements(nodes)
        .filter((F.col("tag") == tag) & F.map_contains_key("attrs", name))
        .select("page_id", "node_id", strip(F.col("attrs")[name]).alias("value"))
    )


def ancestors_of(targets: DataFrame) -> DataFrame:
    """Distinct strict ancestors (page_id, node_id) of the node rows in ``targets``."""
    return targets.select("page_id", F.explode("anc").alias("node_id")).distinct()


def node_path(nodes: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Positional path of elements, /html/body/div[2]/a; a place shows only among namesakes.

    Places are ranks among the siblings of a parent; the steps of a node's ancestors are
    brought together by joining the exploded ancestor ids. ``wanted`` (page_id, node_id)
    limits the answer, not the ranking.
    """
    same = Window.partitionBy("page_id", "parent_id", "tag")
    els = elements(nodes).select("page_id", "node_id", "parent_id", "tag", "anc", "depth")
    steps = els.select(
        "page_id", "node_id", "depth",
        F.concat(
            F.lit("/"), F.col("tag"),
            F.when(
                F.count("*").over(same) > 1,
                F.format_string("[%d]", F.row_number().over(same.orderBy("node_id"))),
            ).otherwise(""),
        ).alias("step"),
    )
    if wanted is not None:
        els = els.join(wanted.select("page_id", "node_id").distinct(), ["page_id", "node_id"], "left_semi")
    chain = els.select(
        "page_id", F.col("node_id").alias("of"),
        F.explode(F.concat("anc", F.array("node_id"))).alias("node_id"),
    )
    return (
        chain.join(steps, ["page_id", "node_id"])
        .groupBy("page_id", F.col("of").alias("node_id"))
        .agg(F.expr("listagg(step, '') within group (order by depth)").alias("path"))
    )


def page_texts(nodes: DataFrame) -> DataFrame:
    """The text nodes of each page as one ordered array: never more than the page itself."""
    return (
        nodes.filter(F.col("kind") == "text")
        .groupBy("page_id")
        .agg(F.array_sort(F.collect_list(F.struct("text_from", "text"))).alias("t"))
        .select("page_id", F.col("t.text").alias("texts"))
    )


def text_content(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add `value`, the stripped text of each target's whole subtree.

    Targets (page_id, text_from, text_to, ...) cut their range out of the page's text
    array, so the work is that of the text returned, however targets are nested.
    """
    piece = F.array_join(
        F.slice("texts", F.col("text_from") + 1, F.col("text_to") - F.col("text_from")), ""
    )
    return (
        targets.join(page_texts(nodes), "page_id", "left")
        .withColumn("value", F.coalesce(strip(piece), F.lit("")))
        .drop("texts")
    )


def _attributes(method: str) -> Column:
    pairs = F.map_entries("attrs")
    if method == "xml":
        pairs = F.filter(pairs, lambda e: e["key"].rlike(r"^[A-Za-z_][\w.\-]*\z"))
    return F.array_join(
        F.transform(
            pairs,
            lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), escape_markup(e["value"], True), F.lit('"')),
        ),
        "",
    )


def serialize(
    nodes: DataFrame, key: tuple[str, ...] = ("page_id",), method: str = "html", pretty: bool = False
) -> DataFrame:
    """Markup of each group of node rows: whole pages, or subtrees under ``key``.

    A row contributes its own tag or characters plus the end tags of all that ends with it:
    the depth of the next row says how many, the trail says which. One window and one
    ordered concatenation over the same partitioning. ``xml`` gives well-formed XHTML for
    Spark's xpath functions; ``pretty`` breaks lines round block elements.
    """
    w = Window.partitionBy(*key).orderBy("node_id")
    is_el = F.col("kind") == "el"
    top = F.lit(1) if key == ("page_id",) else F.min("depth").over(Window.partitionBy(*key))
    rows = nodes.withColumns({
        "_next_kind": F.lead("kind").over(w),
        "_next_last": F.lead("last_id").over(w),
        "_ends": F.col("depth") - F.coalesce(F.lead("depth").over(w), top) + F.when(is_el, 1).otherwise(0),
    })
    name = (lambda t: F.regexp_replace(t, r"^(?![A-Za-z_])|[^\w.\-]", "_")) if method == "xml" else (lambda t: t)
    void = F.array(*[F.lit(t) for t in sorted(VOID_TAGS)])
    stub_text = F.when(~F.array_contains(void, F.col("tag")), F.col("text"))
    own = (
        F.when(is_el, F.concat(
            F.lit("<"), name(F.col("tag")), _attributes(method), F.lit(">"), F.coalesce(stub_text, F.lit(""))
        ))
        .when(F.col("kind") == "text", _text_markup(method))
        .when((F.col("kind") == "comment") & F.lit(method == "html"), F.concat(F.lit("<!--"), F.col("text"), F.lit("-->")))
        .otherwise("")
    )
    if pretty:
        own = F.concat(own, F.when(
            is_el & (F.col("_ends") <= 0) & _breaks(F.col("tag")) & ~F.col("tag").startswith("p")
            & (F.col("_next_kind") != "text") & (F.col("_next_last") != F.col("last_id")), "\n",
        ).otherwise(""))

    # What ends with this row, innermost first.
    ending = F.slice(F.reverse(trail_tags()), 1, F.greatest(F.col("_ends"), F.lit(0)))
    ids = F.reverse(F.when(is_el, F.concat("anc", F.array("node_id"))).otherwise(F.col("anc")))

    def end_tag(tag: Column, i: Column) -> Column:
        markup = F.concat(F.lit("</"), name(tag), F.lit(">"))
        if method == "html":
            markup = F.when(F.array_contains(void, tag), "").otherwise(markup)
        if not pretty:
            return markup
        child = F.when(i == 0, F.col("node_id")).otherwise(F.get(ids, i - 1))
        closes_after_element = F.when(i == 0, F.col("kind") == "comment").otherwise(F.lit(True))
        before = _breaks(tag) & ~tag.startswith("p") & closes_after_element & (child != F.get(ids, i) + 1)
        parent = F.get(F.reverse(trail_tags()), i + 1)
        after = (
            (i == F.col("_ends") - 1) & _breaks(tag)
            & F.coalesce(F.col("_next_kind") != "text", F.lit(False))
            & ~F.coalesce(parent.startswith("p"), F.lit(False))
        )
        return F.concat(F.when(before, "\n").otherwise(""), markup, F.when(after, "\n").otherwise(""))

    piece = F.concat(own, F.array_join(F.transform(ending, end_tag), ""))
    if method == "xml":
        piece = F.regexp_replace(piece, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{fffe}\\x{ffff}]", "")
    return (
        rows.select(*key, "node_id", piece.alias("_piece"))
        .groupBy(*key)
        .agg(F.expr("listagg(_piece, '') within group (order by node_id)").alias("markup"))
    )


def _text_markup(method: str) -> Column:
    if method == "xml":
        return escape_markup(F.col("text"))
    raw = F.col("trail").rlike(r"/(?:script|style)\|[^/]*\z")
    return F.when(raw, F.col("text")).otherwise(escape_markup(F.col("text")))


# The HTML 4 elements a pretty-printed page breaks lines at.
_BREAKING = (
    "address base blockquote body caption center col colgroup dd dir div dl dt fieldset form "
    "frame frameset h1 h2 h3 h4 h5 h6 head hr html legend li link menu meta noframes noscript "
    "ol optgroup option p param pre style table tbody td tfoot th thead title tr ul"
).split()


def _breaks(tag: Column) -> Column:
    return F.array_contains(F.array(*[F.lit(t) for t in _BREAKING]), tag)


def page_xml(nodes: DataFrame) -> DataFrame:
    """(page_id, xml): each page as well-formed XHTML."""
    return serialize(nodes, method="xml").withColumnRenamed("markup", "xml")


def subtrees(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Node rows inside each root (page_id, root_id), keyed by the root they belong to."""
    few = roots.groupBy("page_id").agg(F.collect_set("root_id").alias("_roots"))    # rows of one page
    held = nodes.join(few, "page_id").withColumn(
        "_held", F.array_intersect(F.concat("anc", F.array("node_id")), F.col("_roots"))
    ).filter(F.size("_held") > 0)
    return held.select(*nodes.columns, F.explode("_held").alias("root_id"))
