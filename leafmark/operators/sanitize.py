"""Strip pages to structure and text.

Bottom-up removal has a closed form: an element outside blocked subtrees stays exactly if
some unblocked node of its subtree is a structural element or non-blank text. In document
order that is "the next such node comes no later than my last descendant", one running
minimum per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leafmark.functions.text import is_blank
from leafmark.model import BLOCKED_TAGS, STRUCTURAL_TAGS, rejects
from leafmark.operators.tree import in_tags, serialize
from leafmark.sources.pages import reject_pages, usable_pages
from leafmark.sources.html_tree import shred_html


def drop_comments(nodes: DataFrame) -> DataFrame:
    """Without comments and processing instructions; text beside them is a node of its own."""
    return nodes.filter(F.col("kind").isin("el", "text"))


def drop_blocked(nodes: DataFrame, blocked: list[str] = BLOCKED_TAGS) -> DataFrame:
    """Without blocked elements and everything inside: a filter on the trail."""
    return nodes.filter(~in_tags(blocked))


def _keeps(structural: list[str]) -> Column:
    return F.when(F.col("kind") == "text", ~is_blank(F.col("text"))).otherwise(F.col("tag").isin(structural))


def mark_survivors(nodes: DataFrame, structural: list[str] = STRUCTURAL_TAGS) -> DataFrame:
    """Add `stays` to every element and text row of blocked-free ``nodes``.

    Elements: see above. Text stays with its parent, except blank text after a removed node
    with only blank text up to the next surviving sibling.
    """
    backwards = Window.partitionBy("page_id").orderBy(F.desc("node_id"))
    siblings = Window.partitionBy("page_id", "parent_id").orderBy("node_id")
    upcoming = F.min(F.when(_keeps(structural), F.col("node_id"))).over(backwards)
    is_el = F.col("kind") == "el"
    marked = nodes.withColumn(
        "_el_stays", is_el & (F.coalesce(upcoming <= F.col("last_id"), F.lit(False)) | (F.col("depth") == 1))
    ).withColumn("_owner", F.max(F.when(F.col("_el_stays"), F.col("node_id"))).over(siblings))
    run = Window.partitionBy("page_id", "parent_id", "_owner").orderBy(F.desc("node_id"))
    has_text = (F.col("kind") == "text") & ~is_blank(F.col("text"))
    text_ahead = F.max(has_text).over(run)
    beside = F.col("prev_id").isNull() | F.coalesce(F.col("prev_id") == F.col("_owner"), F.lit(False))
    parent_stays = (
        F.col("trail").rlike(f"/(?:{'|'.join(structural)})\\|[^/]*\\z")
        | F.max(F.col("_el_stays") | has_text).over(Window.partitionBy("page_id", "parent_id"))
    )
    return marked.withColumn(
        "stays", F.when(is_el, F.col("_el_stays")).otherwise((beside | text_ahead) & parent_stays)
    ).drop("_el_stays")


def drop_invisible(nodes: DataFrame, structural: list[str] = STRUCTURAL_TAGS) -> DataFrame:
    """Without elements that show nothing, and without the blank text they leave behind."""
    return mark_survivors(nodes, structural).filter("stays").drop("stays", "_owner")


def rehome_tails(nodes: DataFrame, blocked: list[str] = BLOCKED_TAGS, structural: list[str] = STRUCTURAL_TAGS) -> DataFrame:
    """Where each surviving text belongs afterwards: (page_id, owner_id, slot, text).

    The tail of the last surviving sibling before it, or the text of the parent; pieces
    that meet there are joined in order.
    """
    marked = mark_survivors(drop_blocked(drop_comments(nodes), blocked), structural)
    return (
        marked.filter("stays and kind = 'text'")
        .select(
            "page_id", "node_id", "text",
            F.coalesce("_owner", "parent_id").alias("owner_id"),
            F.when(F.col("_owner").isNull(), "text").otherwise("tail").alias("slot"),
        )
        .groupBy("page_id", "owner_id", "slot")
        .agg(F.expr("listagg(text, '') within group (order by node_id)").alias("text"))
    )


def project_attrs(nodes: DataFrame) -> DataFrame:
    """Clear all attributes but a non-empty href of links."""
    return nodes.withColumn("attrs", F.map_filter(
        "attrs", lambda k, v: (F.col("tag") == "a") & (k == "href") & (v != "")
    ))


def sanitize_nodes(nodes: DataFrame, blocked: list[str] = BLOCKED_TAGS, structural: list[str] = STRUCTURAL_TAGS) -> DataFrame:
    return project_attrs(drop_invisible(drop_blocked(drop_comments(nodes), blocked), structural))


def sanitize_pages(nodes: DataFrame) -> DataFrame:
    """(page_id, sanitized): markup of structure and text only. One shuffle, by page."""
    return serialize(sanitize_nodes(nodes)).withColumnRenamed("markup", "sanitized")


def reduction_ratio(pages: DataFrame, sanitized: DataFrame) -> DataFrame:
    """(page_id, kb_in, kb_out, reduction_pct)."""
    kb_in, kb_out = F.char_length("html") / 1024, F.char_length("sanitized") / 1024
    return pages.join(sanitized, "page_id").select(
        "page_id", kb_in.alias("kb_in"), kb_out.alias("kb_out"),
        F.round(100 * (1 - kb_out / kb_in), 1).alias("reduction_pct"),
    )


def reject_sanitized(pages: DataFrame) -> DataFrame:
    """Pages with nothing to sanitize or nothing left, as rejects rows."""
    empty = reject_pages(pages).select("page_id", F.lit("sanitize").alias("stage"), F.lit("Input HTML is empty").alias("reason"))
    usable = usable_pages(pages)
    left = sanitize_nodes(shred_html(usable)).select("page_id")
    gone = rejects(usable.join(left, "page_id", "left_anti"), "sanitize", "Sanitized HTML is empty")
    return empty.unionByName(gone)
