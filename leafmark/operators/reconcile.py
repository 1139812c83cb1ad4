"""Compare match counts across a page's fields and repair the selectors that stand out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leafmark.model import FIELDS, MAX_REVISIONS, REFERENCE_PREFERENCE, position_of
from leafmark.operators.selectors import element_selector, match_rows
from leafmark.operators.tree import serialize, subtrees
from leafmark.operators.validate import judge, judged_matches
from leafmark.session import stage

# Counts and flags ---------------------------------------------------------------------------

def count_median(results: DataFrame) -> DataFrame:
    return results.groupBy("page_id").agg(F.median("match_count").alias("median_count"))


def with_reference(results: DataFrame, preference: list[str] = REFERENCE_PREFERENCE) -> DataFrame:
    """Add median_count, reference_count and reference_field; one shuffle, by page.

    The reference is the highest count that is at most twice the median (any, if the median
    is 0), and the preferred field that has it.
    """
    page = Window.partitionBy("page_id")
    median = F.median("match_count").over(page)
    rows = results.withColumn("median_count", median)
    sane = (F.col("match_count") <= 2 * F.col("median_count")) | (F.col("median_count") == 0)
    rows = rows.withColumn("reference_count", F.max(F.when(sane, F.col("match_count"))).over(page))
    holder = F.when(
        F.col("match_count") == F.col("reference_count"),
        F.struct(position_of(F.col("field"), preference).alias("p"), F.col("field").alias("f")),
    )
    return rows.withColumn("reference_field", F.min(holder).over(page)["f"])


def reference_count(results: DataFrame) -> DataFrame:
    return with_reference(results).select("page_id", "reference_count").distinct()


def reference_field(results: DataFrame) -> DataFrame:
    return with_reference(results).select("page_id", "reference_count", "reference_field").distinct()


def is_too_broad() -> Column:
    return (
        (F.col("median_count") > 0) & (F.col("match_count") > 2 * F.col("median_count"))
        & (F.col("confidence") == "correct")
    )


def is_too_few() -> Column:
    return (F.col("match_count") < F.col("reference_count")) & (F.col("confidence") == "correct")


def is_skipped() -> Column:
    """Short of the reference, but its sample value was never verified: reported only."""
    return (F.col("match_count") < F.col("reference_count")) & (F.col("confidence") != "correct")


def with_flags(results: DataFrame) -> DataFrame:
    """Results with the reference columns and `flag`: broad, few, skipped or null."""
    return with_reference(results).withColumn(
        "flag", F.when(is_too_broad(), "broad").when(is_too_few(), "few").when(is_skipped(), "skipped")
    )


def noop_pages(flagged: DataFrame) -> DataFrame:
    """Pages on which nothing is to be repaired."""
    work = F.max(F.coalesce(F.col("flag").isin("broad", "few"), F.lit(False)))
    return flagged.groupBy("page_id").agg(work.alias("w")).filter("not w").select("page_id")


# Rows of the repeating list -----------------------------------------------------------------

def row_containers(refs: DataFrame, keys: list[str] = ["page_id"]) -> DataFrame:
    """Rows round reference nodes (keys…, node_id, anc): (keys…, row_id), distinct.

    Climb until the parent holds another reference node below it. The nodes below any
    element are neighbours in document order, so that parent is the deepest ancestor shared
    with the node before or after; shared ancestors are a common beginning of `anc`.
    """
    order = Window.partitionBy(*keys).orderBy("node_id")
    shared = F.greatest(*[
        F.coalesce(F.size(F.array_intersect("anc", step("anc").over(order))), F.lit(0))
        for step in (F.lag, F.lead)
    ])
    return (
        refs.select(*keys, "node_id", "anc").distinct()
        .withColumn("_shared", shared).filter("_shared > 0")
        .select(*keys, F.get(F.concat("anc", F.array("node_id")), F.col("_shared")).alias("row_id"))
        .distinct()
    )


def matches_in_rows(rows: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Matches with the rows they lie in, by exploding each match's own ancestors."""
    inside = matches.withColumn("row_id", F.explode(F.concat("anc", F.array("node_id"))))
    return inside.join(rows.select(*keys, "row_id"), [*keys, "row_id"])


def problem_rows(rows: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in which the flagged selector finds nothing."""
    return rows.join(matches_in_rows(rows, matches, keys).select(*keys, "row_id").distinct(), [*keys, "row_id"], "left_anti")


def good_rows(rows: DataFrame, matches: DataFrame, keys: list[str], n: int = 2) -> DataFrame:
    """The first ``n`` rows in which it finds something."""
    good = rows.join(matches_in_rows(rows, matches, keys).select(*keys, "row_id").distinct(), [*keys, "row_id"], "left_semi")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("row_id"))
    return good.withColumn("_n", rank).filter(F.col("_n") <= n).drop("_n")


def overmatched_row(rows: DataFrame, matches: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """First row with several matches and its first values: (keys…, row_id, matched_in_row)."""
    per_row = matches_in_rows(rows, matches, keys).groupBy(*keys, "row_id").agg(
        F.count("*").alias("_c"), F.array_sort(F.collect_list(F.struct("node_id", "value"))).alias("_v")
    ).filter("_c > 1")
    first = per_row.groupBy(*keys).agg(F.min(F.struct("row_id", "_v")).alias("r"))
    return first.select(
        *keys, F.col("r.row_id").alias("row_id"),
        F.transform(F.slice("r._v", 1, n), lambda m: m["value"]).alias("matched_in_row"),
    )


def row_markup(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(page_id, row_id, row_html) of rows (page_id, row_id)."""
    parts = subtrees(nodes, rows.select("page_id", F.col("row_id").alias("root_id")))
    return serialize(parts, key=("page_id", "root_id")).select(
        "page_id", F.col("root_id").alias("row_id"), F.col("markup").alias("row_html")
    )


# Evidence -----------------------------------------------------------------------------------

def evidence_numbers(flagged: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """Flagged fields with missing, ratio, and all counts and selectors side by side."""
    side = flagged.groupBy("page_id").pivot("field", fields).agg(
        F.first("match_count").alias("count"), F.first("xpath").alias("xpath")
    )
    ratio = F.when(F.col("reference_count") > 0, F.col("match_count") / F.col("reference_count")).otherwise(0.0)
    return (
        flagged.filter(F.col("flag").isin("broad", "few"))
        .select(
            "page_id", "field", "flag", "xpath", "match_count", "reference_count", "reference_field",
            (F.col("reference_count") - F.col("match_count")).alias("missing"),
            F.round(ratio, 1).alias("ratio"),
        )
        .join(side, "page_id")
    )


def _element_matches(nodes: DataFrame, wanted: DataFrame, values: bool) -> DataFrame:
    """Element matches of (page_id, xpath) pairs: adds node_id, anc and, if asked, value."""
    elements = wanted.select("page_id", "xpath", element_selector(F.col("xpath")).alias("element_xpath"))
    found = match_rows(nodes, elements.select("page_id", F.col("element_xpath").alias("xpath")), values).drop("whole")
    return elements.distinct().join(found.withColumnRenamed("xpath", "element_xpath"), ["page_id", "element_xpath"])


def flagged_rows(nodes: DataFrame, flagged: DataFrame, values: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, matches) of every flagged field: rows of its page's reference selector, and
    the elements the field's own selector finds, both keyed by (page_id, field)."""
    work = flagged.filter(F.col("flag").isin("broad", "few")).select("page_id", "field", "xpath")
    reference = flagged.filter(F.col("field") == F.col("reference_field")).select("page_id", "xpath")
    reference = reference.join(work.select("page_id"), "page_id", "left_semi")
    both = work.select("page_id", "xpath").unionByName(reference).distinct()
    found = stage(_element_matches(nodes, both, values), "row-matches")
    containers = row_containers(reference.join(found, ["page_id", "xpath"]))
    rows = work.select("page_id", "field").join(containers, "page_id")
    return rows, work.join(found, ["page_id", "xpath"]).drop("xpath", "element_xpath")


def discrepancy_evidence(nodes: DataFrame, flagged: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """Evidence table: numbers, and the markup of the rows that show the trouble.

    Too few: up to two rows that match and all rows that do not. Too broad: the first row
    with several matches, and what is matched in it.
    """
    keys = ["page_id", "field"]
    rows, matches = flagged_rows(nodes, flagged)
    numbers = evidence_numbers(flagged, fields)
    few = numbers.filter("flag = 'few'").select(*keys)
    shown = (
        problem_rows(rows, matches, keys).withColumn("role", F.lit("problem"))
        .unionByName(good_rows(rows, matches, keys).withColumn("role", F.lit("good")))
        .join(few, keys, "left_semi")
    )
    over = overmatched_row(rows, matches, keys).join(
        numbers.filter("flag = 'broad'").select(*keys), keys, "left_semi"
    )
    shown = shown.unionByName(over.select(*keys, "row_id", F.lit("example").alias("role")))
    texts = shown.join(row_markup(nodes, shown), ["page_id", "row_id"])

    def listed(role: str) -> Column:
        of_role = F.collect_list(F.when(F.col("role") == role, F.struct("row_id", "row_html")))
        return F.transform(F.array_sort(of_role), lambda r: r["row_html"])

    evidence = texts.groupBy(*keys).agg(
        listed("problem").alias("problem_rows"), listed("good").alias("good_rows"),
        F.get(listed("example"), F.lit(0)).alias("example_row"),
    )
    return (
        numbers.join(evidence, keys, "left")
        .join(over.select(*keys, "matched_in_row"), keys, "left")
    )


# Revisions ----------------------------------------------------------------------------------

def accept_revision(tried: DataFrame, limit: int = MAX_REVISIONS) -> DataFrame:
    """Outcome of revisions, one row per (page_id, field).

    ``tried``: page_id, field, flag, iteration, explanation, revised_xpath, old_count,
    new_count, is_correct, first_value. Taken is the first revision whose count moves the
    right way and that still finds the sample value; an unreadable answer (explanation
    null) or one without a selector ends the series. The last explanation read is kept.
    """
    group = Window.partitionBy("page_id", "field").orderBy("iteration")
    moves = F.when(F.col("flag") == "few", F.col("new_count") > F.col("old_count")).otherwise(
        F.col("new_count") < F.col("old_count")
    )
    has_xpath = F.coalesce(F.col("revised_xpath"), F.lit("")) != ""
    rows = tried.filter(F.col("iteration") <= limit).withColumn(
        "_taken", F.coalesce(moves & F.col("is_correct") & has_xpath & F.col("explanation").isNotNull(), F.lit(False))
    )
    stops = F.col("_taken") | ~has_xpath | F.col("explanation").isNull()
    before = group.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_reached", ~F.coalesce(F.max(stops).over(before), F.lit(False))).filter("_reached")
    read = F.when(F.coalesce("explanation", F.lit("")) != "", F.struct("iteration", "explanation"))
    taken = F.min(F.when(F.col("_taken"), F.struct("iteration", "revised_xpath", "new_count", "first_value")))
    return rows.groupBy("page_id", "field").agg(taken.alias("t"), F.max(read).alias("e")).select(
        "page_id", "field", F.col("e.explanation").alias("new_explanation"),
        F.col("t.revised_xpath").alias("new_xpath"), F.col("t.new_count").alias("new_count"),
        F.col("t.first_value").alias("new_sample"),
    )


def apply_revisions(results: DataFrame, accepted: DataFrame) -> DataFrame:
    """Results with accepted selectors in place and explanations kept either way."""
    took = F.col("new_xpath").isNotNull()
    joined = results.join(accepted, ["page_id", "field"], "left")
    return joined.withColumns({
        "original_xpath": F.when(took, F.col("xpath")).otherwise(F.col("original_xpath")),
        "xpath": F.coalesce("new_xpath", "xpath"),
        "match_count": F.when(took, F.col("new_count")).otherwise(F.col("match_count")),
        "sample_value": F.when(took, F.coalesce("new_sample", F.lit(""))).otherwise(F.col("sample_value")),
        "explanation": F.coalesce("new_explanation", "explanation"),
    }).select(*results.columns)


def keep_explanation(revisions: DataFrame) -> DataFrame:
    """The last readable explanation per field, taken or not."""
    read = revisions.filter(F.coalesce("explanation", F.lit("")) != "")
    return read.groupBy("page_id", "field").agg(F.max_by("explanation", "iteration").alias("explanation"))


def try_revisions(nodes: DataFrame, flagged: DataFrame, revisions: DataFrame) -> DataFrame:
    """Run revised selectors of flagged fields: the input of ``accept_revision``.

    Values are checked against the field's sample value, as found by its old selector.
    """
    old = flagged.select("page_id", "field", "flag", F.col("match_count").alias("old_count"), F.col("sample_value").alias("expected"))
    rows = revisions.join(old, ["page_id", "field"]).withColumn("xpath", F.col("revised_xpath"))
    return judge(rows, judged_matches(nodes, rows)).select(
        "page_id", "field", "flag", "iteration", "explanation", "revised_xpath", "old_count",
        F.col("found_count").alias("new_count"), "is_correct",
        F.get("matched_values", F.lit(0)).alias("first_value"),
    )


def _one_pass(nodes: DataFrame, flagged: DataFrame, revisions: DataFrame, flag: str) -> DataFrame:
    """Outcomes for the fields with ``flag`` that have rows to learn from."""
    keys = ["page_id", "field"]
    here = flagged.withColumn("flag", F.when(F.col("flag") == flag, F.col("flag")))
    rows, matches = flagged_rows(nodes, here, values=False)
    if flag == "broad":
        shown = matches_in_rows(rows, matches, keys).groupBy(*keys, "row_id").count().filter("count > 1")
    else:
        shown = problem_rows(rows, matches, keys)
    shown = stage(shown.select(*keys).distinct(), f"{flag}-fields")
    able = here.filter(F.col("flag") == flag).join(shown, keys, "left_semi")
    return accept_revision(try_revisions(nodes, able, revisions))


def reconcile(nodes: DataFrame, results: DataFrame, revisions: DataFrame) -> DataFrame:
    """Results after repair: too broad fields first, then those with too few matches.

    Flags and counts stay those of the start; the second pass reads the reference selector
    as the first one left it. Pages without flags pass through, nothing here rejects. What
    both passes read again is written: a row per page and field.
    """
    flagged = stage(with_flags(results), "flagged")
    revisions = stage(revisions, "revisions")
    narrowed = stage(apply_revisions(flagged, _one_pass(nodes, flagged, revisions, "broad")), "narrowed")
    widened = apply_revisions(narrowed, _one_pass(nodes, narrowed, revisions, "few"))
    return widened.select(*results.columns)
