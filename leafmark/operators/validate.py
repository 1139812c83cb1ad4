"""Check selectors against pages, record attempts, pick the best one per field."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType

from leafmark.functions.similarity import window_reaches
from leafmark.functions.text import plural, strip
from leafmark.model import BROAD_MATCHES, HARDCODED_MIN_CHARS, MAX_ROUNDS
from leafmark.operators.selectors import UNSUPPORTED, _first_only, check_syntax, match_sets, set_rows
from leafmark.session import stage

# The feedback texts, with the places where numbers and values go.
INVALID_ANSWER = "Invalid JSON response"
HARDCODED = "Hardcoded value: XPath contains the literal target value '"
SYNTAX_ERROR = "XPath syntax error: "
MISSING = "Missing: XPath matched 0 elements. Expected to find: '"
CORRECT, CORRECT_AMONG = "Correct", "Correct (found among %d matches)"
REDUNDANT, REDUNDANT_FOUND = "Redundant: XPath matched %d elements but none contained '", "'. Matched: "


def reject_hardcoded(xpath: Column, expected: Column) -> Column:
    """Does the selector spell out the value it should find?"""
    return (F.char_length(expected) > HARDCODED_MIN_CHARS) & F.contains(F.lower(xpath), F.lower(expected))


def contains_match(values: Column, expected: Column) -> Column:
    """Does some non-empty match contain the expected value, or the other way round?"""
    e = F.lower(strip(expected))

    def fits(m: Column) -> Column:
        low = F.lower(m)
        return (low != "") & (F.contains(low, e) | F.contains(e, low))

    return F.coalesce(F.exists(values, fits), F.lit(False))


def value_fits(value: Column, expected: Column) -> Column:
    """``contains_match`` for one value."""
    low, e = F.lower(value), F.lower(strip(expected))
    return F.coalesce((low != "") & (F.contains(low, e) | F.contains(e, low)), F.lit(False))


@F.pandas_udf(BooleanType())
def _close(expected: pd.Series, value: pd.Series) -> pd.Series:
    return pd.Series([bool(v) and window_reaches(e, v) for e, v in zip(expected, value)], dtype=bool)


def quote_list(values: Column) -> Column:
    return F.concat(
        F.lit("["),
        F.array_join(F.transform(values, lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "),
        F.lit("]"),
    )


def flag_broad(match_count: Column) -> Column:
    """Worth a note, never a reason to reject."""
    return match_count > BROAD_MATCHES


#: Values kept of a selector's matches: those a message shows.
SHOWN_VALUES = 3
#: Bytes of the matches of one selector and page that are held together to be compared.
MOST_OPEN_BYTES = 1 << 16


def judged_matches(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """What each selector finds, against the expected value: (page_id, xpath, expected,
    found_count, fits, close, matched_values), only where something is found.

    Matches are judged row by row and then counted; of their texts only the first few are
    kept. Selectors that read the same nodes are judged once. The window similarity runs in
    Python on what is left: the different texts of those matches of which none fits. These are
    written with the counts, or, where they are much text, read from the page once more.
    """
    asked = wanted.filter(F.col("xpath").isNotNull()).groupBy("page_id", "xpath").agg(
        F.collect_set(F.struct("expected")).alias("asks"))
    sets = match_sets(nodes, asked)
    rows = set_rows(nodes, sets.withColumn("asks", F.array_distinct(F.flatten("members.asks"))))
    rows = rows.select("page_id", "set_id", "node_id", "whole", "value", F.inline("asks"))
    keys = ["page_id", "set_id", "expected"]
    group = Window.partitionBy(*keys)
    n, value = F.col("_n"), F.col("value")
    rows = rows.withColumn("_n", F.row_number().over(group.orderBy("node_id"))).filter(~F.col("whole") | (n == 1))
    rows = rows.withColumn("_fits", value_fits(value, F.col("expected")))
    rows = rows.withColumns({"_settled": F.max("_fits").over(group), "_size": F.sum(F.octet_length("value")).over(group)})
    is_open = ~F.col("_settled") & F.col("expected").isNotNull() & (value != "")
    is_much = F.col("_size") > MOST_OPEN_BYTES
    seen = stage(rows.groupBy(*keys).agg(
        F.count("*").cast("int").alias("found_count"), F.max("_fits").alias("fits"),
        F.array_compact(F.array(*[F.max(F.when(n == i + 1, value)) for i in range(SHOWN_VALUES)])).alias("matched_values"),
        F.collect_set(F.when(is_open & ~is_much, F.lower(value))).alias("_open"), F.max(is_open & is_much).alias("_much"),
    ), "seen")
    texts = seen.filter(F.size("_open") > 0).select(*keys, F.explode("_open").alias("_open"))
    much = seen.filter("_much").select(*keys)
    if not much.isEmpty():
        again = _first_only(set_rows(nodes, sets.join(much, ["page_id", "set_id"])), keys).filter(value != "")
        texts = texts.unionByName(again.select(*keys, F.lower(value).alias("_open")))
    close = texts.filter(_close(F.lower(strip(F.col("expected"))), F.col("_open"))).select(*keys).distinct()
    found = seen.drop("_open", "_much").join(close.withColumn("close", F.lit(True)), keys, "left").fillna(False, ["close"])
    found = found.withColumnsRenamed({"set_id": "_s", "expected": "_e", "page_id": "_p"})
    asks = sets.select("page_id", "set_id", F.inline("members")).select("page_id", "set_id", "xpath", F.inline("asks"))
    return asks.join(
        found, (F.col("page_id") == F.col("_p")) & (F.col("set_id") == F.col("_s")) & F.col("expected").eqNullSafe(F.col("_e"))
    ).drop("set_id", "_p", "_s", "_e")


def judge(selectors: DataFrame, matches: DataFrame) -> DataFrame:
    """Attempts rows from selectors (…, xpath, expected) and their ``judged_matches``.

    First of: unreadable answer, spelled-out value, syntax error or unsupported form, no
    match, contained value, similar value, other matches. `found_count` is what the selector
    finds even if it is stopped for another reason.
    """
    found = matches.withColumnsRenamed({"page_id": "_p", "xpath": "_x", "expected": "_e"})
    rows = check_syntax(selectors).join(
        found, (F.col("page_id") == F.col("_p")) & (F.col("xpath") == F.col("_x")) & F.col("expected").eqNullSafe(F.col("_e")), "left"
    ).drop("_p", "_x", "_e")
    xpath, expected, problem = F.col("xpath"), F.col("expected"), F.col("problem")
    hard = F.coalesce(reject_hardcoded(xpath, expected), F.lit(False))
    stopped = xpath.isNull() | hard | problem.isNotNull()
    empty = F.array().cast("array<string>")
    n = F.col("match_count")
    rows = rows.withColumns({
        "found_count": F.coalesce("found_count", F.lit(0)),
        "matched_values": F.when(stopped, empty).otherwise(F.coalesce("matched_values", empty)),
        "match_count": F.when(stopped, 0).otherwise(F.coalesce("found_count", F.lit(0))),
        "is_correct": F.when(stopped, False).otherwise(F.coalesce(F.col("fits") | F.col("close"), F.lit(False))),
        "_hard": hard,
    })
    message = (
        F.when(xpath.isNull(), INVALID_ANSWER)
        .when(F.col("_hard"), F.concat(F.lit(HARDCODED), expected, F.lit("'.")))
        .when(problem.startswith(UNSUPPORTED), problem)
        .when(problem.isNotNull(), F.concat(F.lit(SYNTAX_ERROR), problem))
        .when(n == 0, F.concat(F.lit(MISSING), expected, F.lit("'")))
        .when(F.col("is_correct") & (n == 1), CORRECT)
        .when(F.col("is_correct"), F.format_string(CORRECT_AMONG, n))
        .otherwise(F.concat(F.format_string(REDUNDANT, n), expected, F.lit(REDUNDANT_FOUND), quote_list(F.col("matched_values"))))
    )
    return rows.withColumn("feedback_message", message).drop("_hard", "fits", "close", "problem")


def classify_feedback(nodes: DataFrame, selectors: DataFrame, ie_values: DataFrame) -> DataFrame:
    """Attempts table for selectors (page_id, field, iteration, xpath) and expected values."""
    wanted = selectors.join(
        ie_values.select("page_id", "field", F.col("value").alias("expected")), ["page_id", "field"]
    )
    judged = judge(wanted, judged_matches(nodes, wanted))
    return judged.select(
        "page_id", "field", "iteration", "xpath", "is_correct", "match_count", "matched_values", "feedback_message"
    )


def run_attempts(attempts: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """The attempts that are made: up to the first correct one, at most ``rounds``."""
    group = Window.partitionBy("page_id", "field")
    first_ok = F.min(F.when(F.col("is_correct"), F.col("iteration"))).over(group)
    return (
        attempts.filter(F.col("iteration") <= rounds)
        .withColumn("_last", F.coalesce(first_ok, F.lit(rounds)))
        .filter(F.col("iteration") <= F.col("_last")).drop("_last")
    )


def select_best(attempts: DataFrame) -> DataFrame:
    """Results rows: the first correct selector, else the one with most matches (earliest
    on a tie), else the last one written; confidence says which. One partial aggregate.
    """
    n, at = F.col("match_count"), F.col("iteration")
    usable = F.coalesce(F.col("xpath"), F.lit("")) != ""
    rank = (
        F.when(F.col("is_correct"), F.struct(F.lit(0).alias("c"), at.alias("k"), F.lit(0).alias("t")))
        .when(n > 0, F.struct(F.lit(1).alias("c"), (-n).alias("k"), at.alias("t")))
        .otherwise(F.struct(F.lit(2).alias("c"), (-at).alias("k"), F.lit(0).alias("t")))
    )
    sample = F.coalesce(F.get("matched_values", F.lit(0)), F.lit(""))
    pick = F.min(F.when(usable, F.struct(rank.alias("rank"), "xpath", sample.alias("sample_value"), n.alias("n"))))
    best = attempts.groupBy("page_id", "field").agg(pick.alias("b"), F.count("*").cast("int").alias("iterations"))
    c = F.col("b.rank.c")
    return best.select(
        "page_id", "field",
        F.coalesce("b.xpath", F.lit("")).alias("xpath"),
        F.when(c <= 1, F.col("b.sample_value")).otherwise("").alias("sample_value"),
        F.when(c == 0, "correct").when(c == 1, "best_effort").otherwise("failed").alias("confidence"),
        "iterations",
        F.when(c <= 1, F.col("b.n")).otherwise(0).alias("match_count"),
        F.lit(None).cast("string").alias("original_xpath"),
        F.lit(None).cast("string").alias("explanation"),
    )


def outcome_line() -> Column:
    rounds = plural(F.col("iterations"), "iteration")
    return (
        F.when(F.col("confidence") == "correct", F.concat(F.lit("right value found after "), rounds))
        .when(F.col("confidence") == "best_effort",
              F.concat(F.lit("only other values found in "), rounds))
        .otherwise(F.concat(F.lit("nothing found in "), rounds))
    )


def confidence_summary(results: DataFrame) -> DataFrame:
    """How often each field ended how: (field, confidence, iterations, n, line)."""
    return (
        results.groupBy("field", "confidence", "iterations").agg(F.count("*").alias("n"))
        .withColumn("line", outcome_line())
    )
