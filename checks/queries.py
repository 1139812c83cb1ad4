"""One query per operator, each over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from checks import inputs as I
from leafmark.functions import similarity, text as T
from leafmark.operators import condense, induce, propose, reconcile, report, sanitize, selectors, tree, validate, values
from leafmark.session import shared_folder
from leafmark.sources import html_tree, pages as P, results as R


def _by_tag(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'el'").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def _holed_pages(spark, sf):
    """Pages with a status, and blank where the source was cut off."""
    return I.pages(spark, sf).select(
        "page_id", "url",
        F.when(F.col("html").contains("</html>"), F.col("html")).otherwise(" \n").alias("html"),
        F.when(F.col("url").contains("?"), 404).otherwise(200).alias("status"),
    )


# Sources and sinks

def scan_pages(spark, sf):
    return I.pages(spark, sf)


def reject_pages(spark, sf):
    return P.reject_pages(_holed_pages(spark, sf))


def page_size_kb(spark, sf):
    return P.page_size_kb(I.pages(spark, sf)).withColumn("kb", F.round("kb", 6))


def url_domain(spark, sf):
    return P.with_domain(I.pages(spark, sf)).select("page_id", "domain")


def shred_html(spark, sf):
    return _by_tag(html_tree.shred_html(I.pages(spark, sf)))


def page_xml(spark, sf):
    return tree.page_xml(I.nodes(spark, sf))


def write_results(spark, sf):
    out = report.format_output(I.pages(spark, sf), I.page_results(spark, sf))
    path = f"{shared_folder(spark)}/leafmark/out-{uuid.uuid4().hex}"
    R.write_results(out, path)
    return _flat(R.read_results(spark, path))


def _flat(outputs):
    cols = ["page_id", "url", "status", "summary.correct", "summary.best_effort", "summary.failed"]
    extra = ["domain"] if "domain" in outputs.columns else []
    return outputs.select(*cols, *extra, F.explode("fields").alias("field", "f")).select(
        "page_id", "url", "status", "correct", "best_effort", "failed", *extra, "field",
        "f.xpath", "f.sample_value", "f.confidence", "f.iterations", "f.match_count",
    )


def report_rows(spark, sf):
    return report.report_rows(I.page_results(spark, sf)).select("page_id", "pos", "label", "xpath", "sample", "outcome")


# Tree

def node_path(spark, sf):
    n = I.nodes(spark, sf)
    links = I.page_matches(spark, sf).filter("field = 'title'")
    return tree.node_path(n, links).select("page_id", "path")


def ancestors_of(spark, sf):
    n = I.nodes(spark, sf)
    links = n.join(I.page_matches(spark, sf).filter("field = 'title'").select("page_id", "node_id"), ["page_id", "node_id"], "left_semi")
    return _by_tag(n.join(tree.ancestors_of(links), ["page_id", "node_id"], "left_semi"))


def text_content(spark, sf):
    n = I.nodes(spark, sf)
    wanted = n.filter("tag in ('h1', 'nav', 'footer', 'article')").select("page_id", "tag", "text_from", "text_to")
    return tree.text_content(wanted, n).select("page_id", "tag", "value")


def attr_value(spark, sf):
    return tree.attr_value(I.nodes(spark, sf), "a", "href").select("page_id", "value")


# Sanitizing

def drop_comments(spark, sf):
    n = I.nodes(spark, sf)
    kept = sanitize.drop_comments(n).groupBy("page_id").agg(F.count("*").alias("kept"))
    return n.groupBy("page_id").agg(F.count("*").alias("all")).join(kept, "page_id").select(
        "page_id", (F.col("all") - F.col("kept")).alias("dropped")
    )


def drop_blocked(spark, sf):
    return _by_tag(sanitize.drop_blocked(I.nodes(spark, sf)))


def drop_invisible(spark, sf):
    live = sanitize.drop_blocked(sanitize.drop_comments(I.nodes(spark, sf)))
    return _by_tag(sanitize.drop_invisible(live))


def rehome_tails(spark, sf):
    n = I.nodes(spark, sf)
    homes = sanitize.rehome_tails(n)
    tags = n.filter("kind = 'el'").select("page_id", F.col("node_id").alias("owner_id"), "tag")
    return homes.join(tags, ["page_id", "owner_id"]).select("page_id", "tag", "slot", "text")


def project_attrs(spark, sf):
    n = sanitize.project_attrs(I.nodes(spark, sf)).filter("kind = 'el'")
    return n.select("page_id", F.explode("attrs").alias("name", "value"))


def sanitize_pages(spark, sf):
    return sanitize.sanitize_pages(I.nodes(spark, sf))


def reduction_ratio(spark, sf):
    r = sanitize.reduction_ratio(I.pages(spark, sf), sanitize.sanitize_pages(I.nodes(spark, sf)))
    return r.select("page_id", F.round("kb_in", 6).alias("kb_in"), F.round("kb_out", 6).alias("kb_out"), "reduction_pct")


def reject_sanitized(spark, sf):
    return sanitize.reject_sanitized(_holed_pages(spark, sf).drop("status"))


# Values

def parse_answers(spark, sf):
    parsed = values.parse_answers(I.page_answers(spark, sf))
    link = F.when(F.col("valid"), F.filter("entries", lambda e: e["field"] == "link")[0]["value"])
    return parsed.select("page_id", "try_no", "valid", link.alias("link"))


def first_valid_answer(spark, sf):
    return values.first_valid_answer(values.parse_answers(I.page_answers(spark, sf)))


def fix_mojibake(spark, sf):
    d = I.table(spark, sf, "documents")
    return d.select("doc_id", T.fix_mojibake(T.garble(F.col("text"))).alias("repaired"), T.fix_mojibake(F.col("text")).alias("untouched"))


def link_fallback(spark, sf):
    return values.link_fallback(values.first_valid_answer(values.parse_answers(I.page_answers(spark, sf))))


def require_values(spark, sf):
    return values.require_values(values.first_valid_answer(values.parse_answers(I.page_answers(spark, sf))))


def propose_units(spark, sf):
    n = I.nodes(spark, sf)
    texts = propose.classify_texts(sanitize.sanitize_nodes(n))
    return propose.propose_units(n, texts, ("link",)).groupBy("page_id", "tag", "n_units").agg(F.count("*").alias("n"))


def _list_texts(spark, sf):
    return I.written(spark, sf, "list-texts", lambda: propose.classify_texts(sanitize.sanitize_nodes(I.list_nodes(spark, sf))))


def _list_unit_texts(spark, sf):
    texts = _list_texts(spark, sf)
    return I.written(spark, sf, "list-unit-texts", lambda: propose.unit_texts(texts, propose.propose_units(I.list_nodes(spark, sf), texts)))


def _titles(spark, sf):
    return propose.propose_title_link(I.list_nodes(spark, sf), _list_unit_texts(spark, sf))


def propose_title_link(spark, sf):
    return _titles(spark, sf).select("page_id", "title", "href", "n_units")


def propose_author(spark, sf):
    inside = _list_unit_texts(spark, sf)
    found = propose.propose_author(inside, _titles(spark, sf), propose.propose_date(inside))
    return found.select("page_id", "author")


def propose_date(spark, sf):
    return propose.propose_date(_list_unit_texts(spark, sf)).select("page_id", "date")


def detect_cue(spark, sf):
    t = _list_texts(spark, sf)
    return t.select("page_id", "value", propose.detect_cue(F.col("before"), F.lit("last_post_author")).alias("cue_text"))


def drop_false_positives(spark, sf):
    return propose.drop_false_positives(_list_texts(spark, sf)).select("page_id", "value")


def pick_first_unit(spark, sf):
    inside = _list_unit_texts(spark, sf)
    titles, dates = _titles(spark, sf), propose.propose_date(inside)
    return propose.pick_first_unit(titles, dates, propose.propose_author(inside, titles, dates)).select(
        "page_id", "title", "author", "date", "href"
    )


# Fuzzy match and condensing

def _page_targets(spark, sf):
    return condense.target_texts(I.page_values(spark, sf))


def target_texts(spark, sf):
    return _page_targets(spark, sf)


def edit_distance_ratio(spark, sf):
    o = I.table(spark, sf, "orders")
    return o.select("o_orderkey", F.round(similarity.edit_distance_ratio(
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), F.concat(F.lit("Order "), F.col("o_custkey").cast("string"))
    ), 6).alias("ratio"))


def _list_targets(spark, sf):
    """Titles with two letters changed, and one text no page has."""
    return I.written(spark, sf, "list-targets", lambda: I.list_values(spark, sf).filter("field = 'title'").select(
        "page_id", F.explode(F.array(F.translate("value", "wp", "xx"), F.lit("no such text"))).alias("target")
    ))


def _list_matches(spark, sf):
    return I.written(spark, sf, "list-fuzzy", lambda: condense.fuzzy_node_match(I.list_nodes(spark, sf), _list_targets(spark, sf)))


def fuzzy_node_match(spark, sf):
    n = I.list_nodes(spark, sf).filter("kind = 'el'").select("page_id", "node_id", F.col("attrs")["href"].alias("href"))
    return condense.fuzzy_node_match(I.list_nodes(spark, sf), _list_targets(spark, sf)).join(n, ["page_id", "node_id"]).select("page_id", "href", "target")


def found_targets(spark, sf):
    return condense.found_targets(_list_targets(spark, sf), _list_matches(spark, sf))


def missing_targets(spark, sf):
    return condense.missing_targets(_list_targets(spark, sf), _list_matches(spark, sf))


def reject_no_target(spark, sf):
    odd = I.page_values(spark, sf).filter("field = 'title'").join(
        I.pages(spark, sf).select("page_id", I.language().alias("lang")), "page_id"
    ).select("page_id", F.when(F.col("lang") == "en", F.col("value")).otherwise("no such text anywhere").alias("target"))
    return condense.reject_no_target(I.pages(spark, sf), condense.fuzzy_node_match(I.nodes(spark, sf), odd))


def _head_targets(spark, sf):
    return I.page_values(spark, sf).filter("field = 'last_post_author'").select("page_id", F.col("value").alias("target"))


def condense_nodes(spark, sf):
    c = condense.condense_nodes(I.list_nodes(spark, sf), _home_targets(spark, sf))
    return c.filter("kind = 'el'").groupBy("page_id", "tag").agg(
        F.count("*").alias("n"), F.count_if(F.col("text") == "...").alias("stubs")
    )


def _home_targets(spark, sf):
    """The label of the navigation link and the last line of each order list."""
    return I.list_pages(spark, sf).select("page_id", F.explode(F.array(F.lit("Home"), F.lit("Orders"))).alias("target"))


def condense_pages(spark, sf):
    return condense.condense_pages(I.list_nodes(spark, sf), _home_targets(spark, sf))


def condensed_lines(spark, sf):
    return condense.condensed_lines(condense.condense_pages(I.nodes(spark, sf), _head_targets(spark, sf)), limit=10)


def text_snippet(spark, sf):
    d = I.table(spark, sf, "documents")
    return d.select("doc_id", T.text_snippet(F.col("text"), F.lit("La "), 1).alias("snippet"))


# Selectors

def eval_selector(spark, sf):
    return selectors.eval_selectors(I.nodes(spark, sf), {**I.PAGE_SELECTORS, "ad": "//div[contains(@class,'ad')]/text()"}).select("page_id", "field", "value")


def eval_selector_literal(spark, sf):
    return selectors.eval_selector_literal(tree.page_xml(I.nodes(spark, sf)), "//nav//li[position()=last()]/a")


def _syntax_rows(spark, sf):
    forms = ["//nav//li/a", "//nav//li[", "//p[contains(@class,'x')]/text()", "", "string(//h1)", "//a[1]"]
    return I.pages(spark, sf).select("page_id", F.explode(F.array(*[F.lit(f) for f in forms])).alias("xpath"))


def check_syntax(spark, sf):
    return selectors.check_syntax(_syntax_rows(spark, sf)).select("page_id", "xpath", F.col("problem").isNull().alias("usable"))


def match_count(spark, sf):
    found = selectors.eval_selectors(I.nodes(spark, sf), {**I.PAGE_SELECTORS, "cells": "//table//td"})
    return selectors.match_counts(I.pages(spark, sf), [*I.PAGE_SELECTORS, "cells"], found)


def reject_hardcoded(spark, sf):
    v = I.page_values(spark, sf)
    xpath = F.concat(F.lit("//*[.='"), F.lower("value"), F.lit("']"))
    return v.select("page_id", "field", validate.reject_hardcoded(xpath, F.col("value")).alias("hardcoded"))


def contains_match(spark, sf):
    found = I.page_matches(spark, sf).filter("field = 'title'").groupBy("page_id").agg(F.collect_list("value").alias("v"))
    expected = I.page_values(spark, sf).filter("field = 'last_post_author'").select("page_id", "value")
    return found.join(expected, "page_id").select("page_id", validate.contains_match(F.col("v"), F.col("value")).alias("contained"))


def partial_ratio_match(spark, sf):
    """Headlines against the same without their fourth letter, with other words round it."""
    v = I.page_values(spark, sf).filter("field = 'last_post_author'")
    bent = F.concat(F.lit(">> "), F.overlay("value", F.lit(""), F.lit(4), F.lit(1)), F.lit(" <<"))
    return v.select("page_id", similarity.partial_ratio_match(F.col("value"), bent).alias("close"))


def _kind():
    return F.trim(F.regexp_extract("feedback_message", "^[A-Za-z ]+", 0))


def classify_feedback(spark, sf):
    a = validate.classify_feedback(I.nodes(spark, sf), I.page_rounds(spark, sf), I.page_values(spark, sf))
    return a.select("page_id", "field", "iteration", "is_correct", "match_count", _kind().alias("outcome"))


def flag_broad(spark, sf):
    counts = selectors.match_counts(I.pages(spark, sf), list(I.PAGE_SELECTORS), I.page_matches(spark, sf))
    return counts.select("page_id", "field", validate.flag_broad(F.col("match_count")).alias("is_broad"))


def induce_selectors(spark, sf):
    return induce.induce_selectors(I.list_nodes(spark, sf), I.list_run(spark, sf).ie_values).filter("iteration = 1").select(
        "page_id", "field", "xpath", "is_correct", "match_count"
    )


def site_selectors(spark, sf):
    run = I.list_run(spark, sf)
    best = induce.site_selectors(I.list_pages(spark, sf), run.judged)
    return best.filter("iteration = 1").select("domain", "field", "xpath", F.round("share", 6).alias("share"))


def run_attempts(spark, sf):
    return validate.run_attempts(I.page_attempts(spark, sf)).select("page_id", "field", "iteration")


def select_best(spark, sf):
    return validate.select_best(I.page_attempts(spark, sf)).select("page_id", "field", "xpath", "sample_value", "confidence", "match_count")


def generate_selectors(spark, sf):
    a = validate.classify_feedback(I.nodes(spark, sf), I.page_rounds(spark, sf), I.page_values(spark, sf))
    return induce.generate_selectors(a).select("page_id", "field", "xpath", "sample_value", "confidence", "iterations", "match_count")


def confidence_summary(spark, sf):
    return validate.confidence_summary(I.page_results(spark, sf))


# Reconciling

def count_median(spark, sf):
    return reconcile.count_median(I.page_results(spark, sf))


def reference_count(spark, sf):
    return reconcile.reference_count(I.page_results(spark, sf))


def reference_field(spark, sf):
    return reconcile.reference_field(I.page_results(spark, sf))


def _flagged(spark, sf, name, source=I.list_results):
    return reconcile.with_flags(source(spark, sf)).filter(F.col("flag") == name).select("page_id", "field", "match_count")


def flag_too_broad(spark, sf):
    return _flagged(spark, sf, "broad")


def flag_too_few(spark, sf):
    return _flagged(spark, sf, "few")


def flag_skipped(spark, sf):
    return _flagged(spark, sf, "skipped", I.page_results)


def noop_pages(spark, sf):
    return reconcile.noop_pages(reconcile.with_flags(I.list_results(spark, sf)))


def element_selector(spark, sf):
    forms = ["//a/text()", "//a/@href", "string(//h1)", "string(//a/@href)", "//div[@class='x']", "//a/@data-id"]
    rows = I.pages(spark, sf).select("page_id", F.explode(F.array(*[F.lit(f) for f in forms])).alias("xpath"))
    return rows.select("page_id", "xpath", selectors.element_selector(F.col("xpath")).alias("element_xpath"))


def _rows_and_matches(spark, sf):
    """Rows round the subject links, and what the author selector finds in them."""
    wanted = I.list_pages(spark, sf).select("page_id", F.explode(F.array(
        F.lit("//a[contains(@class,'subject')]"), F.lit("//a[contains(@class,'user')]"),
    )).alias("xpath"))
    found = I.written(spark, sf, "list-row-matches", lambda: selectors.eval_selector_table(I.list_nodes(spark, sf), wanted))
    rows = reconcile.row_containers(found.filter(F.col("xpath").contains("subject")))
    return rows, found.filter(F.col("xpath").contains("user"))


def _row_links(spark, sf, rows):
    """Rows by the href of their subject link."""
    links = I.list_nodes(spark, sf).filter("tag = 'a' and attrs['class'] = 'subject'").select(
        "page_id", F.explode("anc").alias("row_id"), F.col("attrs")["href"].alias("href")
    )
    return rows.join(links, ["page_id", "row_id"])


def row_containers(spark, sf):
    rows, _ = _rows_and_matches(spark, sf)
    return _row_links(spark, sf, rows).select("page_id", "href")


def problem_rows(spark, sf):
    rows, found = _rows_and_matches(spark, sf)
    bad = reconcile.problem_rows(rows, found, ["page_id"])
    return reconcile.row_markup(I.list_nodes(spark, sf), bad).select("page_id", "row_html")


def good_rows(spark, sf):
    rows, found = _rows_and_matches(spark, sf)
    return _row_links(spark, sf, reconcile.good_rows(rows, found, ["page_id"])).select("page_id", "href")


def overmatched_row(spark, sf):
    wanted = I.list_pages(spark, sf).select("page_id", F.explode(F.array(
        F.lit("//a[contains(@class,'subject')]"), F.lit("//div[contains(@class,'last')]/*"),
    )).alias("xpath"))
    found = I.written(spark, sf, "list-over-matches", lambda: selectors.eval_selector_table(I.list_nodes(spark, sf), wanted))
    rows = reconcile.row_containers(found.filter(F.col("xpath").contains("subject")))
    over = reconcile.overmatched_row(rows, found.filter(F.col("xpath").contains("last")), ["page_id"])
    return over.select("page_id", F.array_join("matched_in_row", "|").alias("matched"))


def discrepancy_evidence(spark, sf):
    flagged = I.written(spark, sf, "list-flagged", lambda: reconcile.with_flags(I.list_results(spark, sf)))
    e = reconcile.discrepancy_evidence(I.list_nodes(spark, sf), flagged)
    return e.select(
        "page_id", "field", "flag", "missing", "ratio", "title_count", "last_post_author_count", "link_count",
        F.coalesce(F.size("problem_rows"), F.lit(0)).alias("n_problem"), F.coalesce(F.size("good_rows"), F.lit(0)).alias("n_good"),
        F.coalesce(F.size("matched_in_row"), F.lit(0)).alias("n_over"),
    )


def _tried(spark, sf):
    flagged = I.written(spark, sf, "list-flagged", lambda: reconcile.with_flags(I.list_results(spark, sf)))
    return reconcile.try_revisions(I.list_nodes(spark, sf), flagged.filter("flag in ('broad', 'few')"), I.list_revisions(spark, sf))


def accept_revision(spark, sf):
    return reconcile.accept_revision(_tried(spark, sf))


def keep_explanation(spark, sf):
    return reconcile.keep_explanation(I.list_revisions(spark, sf))


def reconcile_pages(spark, sf):
    out = reconcile.reconcile(I.list_nodes(spark, sf), I.list_results(spark, sf), I.list_revisions(spark, sf))
    return out.select("page_id", "field", "xpath", "sample_value", "match_count", "original_xpath", "explanation")


# Output

def assemble_fields(spark, sf):
    m = report.assemble_fields(I.page_results(spark, sf))
    return m.select("page_id", F.explode("fields").alias("field", "f")).select("page_id", "field", "f.xpath", "f.confidence")


def null_empty_sample(spark, sf):
    return report.null_empty_sample(I.page_results(spark, sf)).select("page_id", "field", "sample_value")


def summary_counts(spark, sf):
    return report.summary_counts(I.page_results(spark, sf))


def page_status(spark, sf):
    s = report.summary_counts(I.page_results(spark, sf))
    return s.select("page_id", report.page_status(F.col("total_fields"), F.col("correct")).alias("status"))


def format_output(spark, sf):
    return _flat(report.format_output(I.pages(spark, sf), I.page_results(spark, sf)))


def run_all_stages(spark, sf):
    return _flat(I.list_run(spark, sf).outputs)


def run_rejects(spark, sf):
    return I.list_run(spark, sf).rejects


ALL = [
    scan_pages, reject_pages, page_size_kb, url_domain, shred_html, page_xml, write_results, report_rows,
    node_path, ancestors_of, text_content, attr_value,
    drop_comments, drop_blocked, drop_invisible, rehome_tails, project_attrs, sanitize_pages, reduction_ratio, reject_sanitized,
    parse_answers, first_valid_answer, fix_mojibake, link_fallback, require_values,
    propose_units, propose_title_link, propose_author, propose_date, detect_cue, drop_false_positives, pick_first_unit,
    target_texts, edit_distance_ratio, fuzzy_node_match, found_targets, missing_targets, reject_no_target,
    condense_nodes, condense_pages, condensed_lines, text_snippet,
    eval_selector, eval_selector_literal, check_syntax, match_count, reject_hardcoded, contains_match, partial_ratio_match,
    classify_feedback, flag_broad, induce_selectors, site_selectors, run_attempts, select_best, generate_selectors, confidence_summary,
    count_median, reference_count, reference_field, flag_too_broad, flag_too_few, flag_skipped, noop_pages, element_selector,
    row_containers, problem_rows, good_rows, overmatched_row, discrepancy_evidence, accept_revision, keep_explanation, reconcile_pages,
    assemble_fields, null_empty_sample, summary_counts, page_status, format_output, run_all_stages, run_rejects,
]
# `reconcile` as a name belongs to the module above.
QUERIES = {("reconcile" if f is reconcile_pages else f.__name__): f for f in ALL}
