"""Secret scans with an incremental ledger of blobs.

Texts are content-addressed (SHA-256). The ledger has a row for every blob and rule version
ever scanned, with the places found. A scan takes the distinct blobs, leaves out the pairs the
ledger knows, scans the rest once, adds them to the ledger, and joins the findings back to
every path that has the blob.

Defined results: null text counts as empty; an empty text, a text without findings and an empty
table give no findings; repeated rows get the findings once each.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from leafmark.llm.common import documents, fresh_path, staged


@dataclass(frozen=True)
class Rule:
    """A pattern and the least length of the group that counts; a new version scans anew."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


# The rules' patterns and lengths.
RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)
SPAN = "array<struct<start:bigint,end:bigint>>"
LEDGER = f"blob string, kind string, version int, spans {SPAN}"


def _places(rule: Rule, text: Column) -> Column:
    """Code point ranges of the rule's matches: the pieces between the matches and the matches,
    laid end to end, are the text, so their lengths give the places.

    Two rules state their least length in the pattern: a shorter run has no longer run within.
    """
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("bigint"))
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda x: F.length(x).cast("bigint"))
    valued = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda x: F.length(x) >= rule.least)
    steps = F.arrays_zip(between.alias("gap"), whole.alias("run"), valued.alias("good"))
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(state, item):
        start = state["at"] + item["gap"]
        end = start + F.coalesce(item["run"], F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            end.alias("at"), F.when(F.coalesce(item["good"], F.lit(False)), F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans")
        )

    found = F.aggregate(steps, empty, step, lambda s: s["spans"])
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(SPAN))


def read_ledger(spark, ledger: str | None) -> DataFrame:
    """All batches of a ledger; a new one has none yet."""
    try:
        return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(ledger)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEDGER)


def scan_secrets(
    docs: DataFrame, ledger: str | None = None, batch: str | None = None, rules: tuple[Rule, ...] = RULES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, blob, findings (array of kind, version, start, end).

    ``ledger`` is a folder that grows by one sub-folder per ``batch``; a batch that is run again
    after a failure overwrites its own folder only. Without a batch name every call writes a new
    folder, so no earlier scan is ever replaced. Without a ledger, a new one is begun.
    """
    spark = docs.sparkSession
    ledger = ledger or fresh_path(spark, "ledger")
    batch = batch or f"batch-{uuid.uuid4().hex}"
    rows = documents(docs, id_col, text_col).withColumn("blob", F.sha2(F.encode("text", "UTF-8"), 256))
    known = read_ledger(spark, ledger).filter(~F.input_file_name().contains(f"/{batch}/")).select("blob", "kind", "version")
    current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    done = known.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("done"))  # at most one per rule version
    # Copies collapse within each task before the shuffle, however frequent a text is.
    blobs = rows.groupBy("blob").agg(F.first("text").alias("text"))
    open_pairs = blobs.join(done, "blob", "left").withColumn(
        "todo", F.array_except(current, F.coalesce("done", F.array().cast("array<struct<kind:string,version:int>>")))
    ).filter(F.size("todo") > 0)
    per_rule = F.array(*[
        F.when(
            F.array_contains("todo", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))),
            F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), _places(r, F.col("text")).alias("spans")),
        ) for r in rules
    ])
    scanned = open_pairs.select("blob", F.inline(F.filter(per_rule, lambda x: x.isNotNull())))
    scanned.write.mode("overwrite").parquet(f"{ledger}/{batch}")
    hits = read_ledger(spark, ledger).filter(F.size("spans") > 0).join(
        F.broadcast(spark.createDataFrame([(r.kind, r.version, k) for k, r in enumerate(rules)], "kind string, version int, place int")),
        ["kind", "version"],
    )
    hit = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("place"), F.col("kind"), F.col("version"), s["end"].alias("end")))
    per_blob = staged(hits.select("blob", hit.alias("found")).groupBy("blob").agg(
        F.array_sort(F.flatten(F.collect_list("found"))).alias("found")  # one list per rule
    ), "secret-findings")
    return rows.select("doc_id", "blob").join(per_blob, "blob", "left").select(
        "doc_id", "blob", F.coalesce(F.transform("found", lambda x: F.struct(
            x["kind"].alias("kind"), x["version"].alias("version"), x["start"].alias("start"), x["end"].alias("end")
        )), F.array().cast("array<struct<kind:string,version:int,start:bigint,end:bigint>>")).alias("findings"),
    )


def joined_spans(findings: str) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """Counts per kind, the digest of the spans, and the spans."""
    found = scan_secrets(docs, **options)

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(r.kind) for r in RULES], F.sha2(joined_spans("findings").cast("binary"), 256).alias("base_sha256"), joined_spans("findings").alias("spans")
    )


def mask_secrets(docs: DataFrame, mask: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every finding replaced by ``mask``; other texts and columns stay as they are."""
    spark, columns = docs.sparkSession, docs.columns
    ledger = fresh_path(spark, "ledger")
    scan_secrets(docs, ledger=ledger, id_col=id_col, text_col=text_col)
    per_blob = read_ledger(spark, ledger).filter(F.size("spans") > 0).groupBy("blob").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("__lm_spans")
    ).withColumnRenamed("blob", "__lm_found")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def cut(state, span):
        # Spans of different rules can overlap: what a former span covered is not repeated.
        kept = F.when(span["start"] > state["at"], F.substring(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))).otherwise("")
        inside = span["end"] <= state["at"]
        joins = (span["start"] < state["at"])
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(inside | joins, state["out"]).otherwise(F.concat(state["out"], kept, F.lit(mask))).alias("out"),
        )

    masked = F.aggregate("__lm_spans", start, cut, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    out = docs.withColumn("__lm_blob", F.sha2(F.encode(text, "UTF-8"), 256)).join(
        per_blob, F.col("__lm_blob") == F.col("__lm_found"), "left"
    ).withColumn(text_col, F.when(F.col("__lm_spans").isNull(), F.col(f"`{text_col}`")).otherwise(masked))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("__lm_spans").isNull(), F.col("n_chars")).otherwise(F.length(text).cast("bigint")))
    return out.select(*[F.col(f"`{c}`") for c in columns])
