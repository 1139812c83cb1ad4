"""Table shapes, the field dimension and the fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# One row per node of the page tree. Text is a node of its own (as in the DOM), so removing
# an element never moves text around. node_id is the pre-order number; the subtree of a node
# is node_id..last_id. `anc` lists the ids of the ancestors from the root down, `trail` spells
# the way from the root as /tag|class/tag|class (for text: the trail of its parent).
# text_from/text_to is the half-open range of text nodes below the node, counted per page.
NODES_DDL = (
    "page_id BIGINT, node_id INT, last_id INT, parent_id INT, prev_id INT, depth INT, "
    "kind STRING, tag STRING, attrs MAP<STRING,STRING>, text STRING, anc ARRAY<INT>, "
    "trail STRING, text_from INT, text_to INT"
)

IE_VALUES_DDL = "page_id BIGINT, field STRING, value STRING, cue_text STRING"
ATTEMPTS_DDL = (
    "page_id BIGINT, field STRING, iteration INT, xpath STRING, is_correct BOOLEAN, "
    "match_count INT, matched_values ARRAY<STRING>, feedback_message STRING"
)
RESULTS_DDL = (
    "page_id BIGINT, field STRING, xpath STRING, sample_value STRING, confidence STRING, "
    "iterations INT, match_count INT, original_xpath STRING, explanation STRING"
)
REVISIONS_DDL = "page_id BIGINT, field STRING, iteration INT, explanation STRING, revised_xpath STRING"

# Fixed values -----------------------------------------------------------------------------

# Fields in reporting order, their labels, and the order in which ties for the reference
# field are broken.
FIELDS = ["title", "last_post_author", "last_post_date", "link"]
FIELD_LABELS = {
    "title": "TITLE",
    "last_post_author": "LAST POST AUTHOR",
    "last_post_date": "LAST POST DATE",
    "link": "LINK",
}
REFERENCE_PREFERENCE = ["title", "link", "last_post_date", "last_post_author"]
LINK_FIELD = "link"

CONFIDENCE_ICONS = {"correct": "✓", "best_effort": "⚠", "failed": "✗"}

# Tags removed with everything in them.
BLOCKED_TAGS = [
    "script", "style", "svg", "img", "link", "meta", "noscript", "head", "iframe",
    "canvas", "video", "audio", "input", "button", "form", "select", "textarea",
]

# Tags kept even when empty.
STRUCTURAL_TAGS = [
    "div", "section", "article", "ul", "ol", "li", "table", "thead", "tbody", "tfoot",
    "tr", "th", "td", "dl", "dt", "dd", "figure", "figcaption", "header", "footer",
    "main", "nav", "aside", "html", "body",
]

DISTANCE_LIMIT = 0.1          # edit distance / longer length
PARTIAL_RATIO_LIMIT = 85.0    # similarity of the best window, in percent
HARDCODED_MIN_CHARS = 5       # longer values must not occur in a selector
BROAD_MATCHES = 20
MAX_ROUNDS = 3                # selector attempts per field
MAX_REVISIONS = 2             # repair attempts per field
MAX_ANSWERS = 2               # extraction answers per page
LARGE_CONDENSED_LINES = 500

# ------------------------------------------------------------------------------------------


def literal_map(mapping: dict) -> Column:
    """A map literal for small fixed lookups."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def position_of(col: Column, values: list[str]) -> Column:
    """1-based place of a value in a fixed list, after the last one when it is not in it."""
    place = F.array_position(F.array(*[F.lit(v) for v in values]), col)
    return F.when(place == 0, len(values) + 1).otherwise(place)


def rejects(df: DataFrame, stage: str, reason: Column | str) -> DataFrame:
    """Rows of the common rejects table from the pages in ``df``."""
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return df.select("page_id", F.lit(stage).alias("stage"), reason.alias("reason"))
