"""Tables the checked queries read: the given ones, and what Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmark.functions.text import strip
from leafmark.operators.report import complete_results
from leafmark.operators.selectors import eval_selectors
from leafmark.operators.validate import classify_feedback, run_attempts, select_best
from leafmark.plans.full_run import run_all_stages
from leafmark.session import stage, tune
from leafmark.sources.html_tree import write_nodes
from leafmark.sources.pages import scan_pages

# Where the four fields stand on the given pages.
PAGE_SELECTORS = {
    "title": "//nav//li/a",
    "last_post_author": "//article/h1",
    "last_post_date": "//article//p",
    "link": "//nav//li/a/@href",
}
ORDERS_PER_LIST = 12

_written: dict[tuple[str, str, str], object] = {}


def written(spark: SparkSession, sf: str, name: str, make) -> DataFrame:
    """A derived table, written once per application and data set and scanned afterwards."""
    return _once(spark, sf, name, lambda: stage(make(), name))


def _once(spark, sf, name, make):
    tune(spark)
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _written:
        _written[key] = make()
    return _written[key]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return scan_pages(spark, f"{sf}/pages.parquet")


def language(url="url"):
    return F.regexp_extract(url, r"^https?://[^/]*/([a-z]+)/", 1)


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "page-nodes", lambda: write_nodes(pages(spark, sf)))


def page_matches(spark: SparkSession, sf: str) -> DataFrame:
    return written(spark, sf, "page-matches", lambda: eval_selectors(nodes(spark, sf), PAGE_SELECTORS))


def page_values(spark: SparkSession, sf: str) -> DataFrame:
    """First value of each field; the date's is one that stands on no page."""
    first = page_matches(spark, sf).groupBy("page_id", "field").agg(F.min_by("value", "node_id").alias("value"))
    value = F.when(F.col("field") == "last_post_date", "@@@").otherwise(F.col("value"))
    return first.select("page_id", "field", value.alias("value"), F.lit("").alias("cue_text"))


def page_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Three selector attempts per page and field: wrong, broken, missing and right ones."""
    h1 = page_values(spark, sf).filter("field = 'last_post_author'").select(
        "page_id", F.concat(F.lit("//*[text()='"), F.lower("value"), F.lit("']")).alias("spelled")
    )
    rounds = {
        "title": [F.lit("//table//td/a"), F.lit("//html/@lang"), F.lit("//nav//li/a")],
        "last_post_author": [F.col("spelled"), F.lit("//h2"), F.lit("//article/h1")],
        "last_post_date": [F.lit("//article//p"), F.lit("//p["), F.lit(None).cast("string")],
        "link": [F.lit("//nav//li/a/@href"), F.lit("//a/@href"), F.lit("//nav//a/@href")],
    }
    rows = F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(i + 1).alias("iteration"), x.alias("xpath"))
        for f, xs in rounds.items() for i, x in enumerate(xs)
    ])
    return pages(spark, sf).select("page_id").join(h1, "page_id").select("page_id", F.inline(rows))


def page_attempts(spark: SparkSession, sf: str) -> DataFrame:
    return written(spark, sf, "page-attempts", lambda: classify_feedback(
        nodes(spark, sf), page_rounds(spark, sf), page_values(spark, sf)
    ))


def page_results(spark: SparkSession, sf: str) -> DataFrame:
    return written(spark, sf, "page-results", lambda: select_best(run_attempts(page_attempts(spark, sf))))


def page_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answer tries per page: what is wrong with the first ones depends on the language."""
    wide = (
        page_matches(spark, sf).groupBy("page_id").pivot("field", list(PAGE_SELECTORS))
        .agg(F.min_by("value", "node_id"))
    )
    src = pages(spark, sf).select("page_id", language().alias("lang")).join(wide, "page_id")

    def part(col):
        return F.struct(col.alias("value"), F.lit("").alias("cue_text"))

    label, head, href = F.col("title"), F.col("last_post_author"), F.col("link")
    good = F.to_json(F.struct(
        part(label).alias("title"), part(head).alias("last_post_author"),
        part(F.lit("Yesterday")).alias("last_post_date"),
        part(F.when(F.col("lang") == "de", "").otherwise(href)).alias("link"),
    ))
    missing = F.to_json(F.struct(part(label).alias("title"), part(head).alias("last_post_author")))
    number = F.to_json(F.struct(
        part(F.lit(5)).alias("title"), part(head).alias("last_post_author"),
        part(F.lit("Yesterday")).alias("last_post_date"), part(href).alias("link"),
    ))
    first = (
        F.when(F.col("lang") == "fr", F.concat(F.lit("{"), good)).when(F.col("lang") == "de", missing)
        .when(F.col("lang") == "es", number).otherwise(good)
    )
    second = F.when(F.col("lang") == "es", "not json").otherwise(good)
    return src.select("page_id", F.posexplode(F.array(first, second, good)).alias("n", "content")).select(
        "page_id", (F.col("n") + 1).alias("try_no"), "content"
    )


def list_pages(spark: SparkSession, sf: str, per_list: int = ORDERS_PER_LIST, wrappers: int = 0) -> DataFrame:
    """Order lists as web pages with one row per order; at most ``per_list`` rows each.

    Authors of urgent and high orders are plain text, the others are links. ``wrappers`` nests
    the list in so many elements with long classes.
    """
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    user = F.concat(F.lit("user_"), key)
    author = F.when(
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
        F.concat(F.lit('<span class="user">'), user, F.lit("</span>")),
    ).otherwise(F.concat(F.lit('<a class="user" href="/u/'), key, F.lit('">'), user, F.lit("</a>")))
    row = F.concat(
        F.lit('<div class="row"><div class="main"><a class="subject" href="/orders/'), key, F.lit('">Order '), key,
        F.lit(" with priority "), F.col("o_orderpriority"),
        F.lit('</a></div><div class="last"><span>Latest: </span>'), author,
        F.lit('<time class="when">'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</time></div></div>"),
    )
    block = F.floor(F.col("o_orderkey") / per_list)
    page_id = block * 4 + F.array_position(F.array(F.lit("O"), F.lit("F"), F.lit("P")), F.col("o_orderstatus"))
    return (
        o.select(page_id.alias("page_id"), "o_orderkey", row.alias("row"))
        .groupBy("page_id").agg(F.expr("listagg(row, '') within group (order by o_orderkey)").alias("rows"))
        .select(
            "page_id", F.concat(F.lit("https://shop.example/list/"), F.col("page_id").cast("string")).alias("url"),
            F.concat(
                F.lit("<!DOCTYPE html><html><head><title>Orders</title></head><body><nav><a href=\"/\">Home</a></nav>"),
                F.lit('<div class="wrap flex items-center justify-between gap-4 rounded border p-2">' * wrappers),
                F.lit('<div class="list">'), F.col("rows"), F.lit("</div>" + "</div>" * wrappers),
                F.lit("<footer>End of list</footer></body></html>"),
            ).alias("html"),
        )
    )


def list_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "list-nodes", lambda: write_nodes(list_pages(spark, sf)))


def list_selectors(spark: SparkSession, sf: str) -> DataFrame:
    """One selector per field of the order lists: a too broad title, an author that misses
    plain text, and two right ones."""
    return list_pages(spark, sf).select("page_id", F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(1).alias("iteration"), F.lit(x).alias("xpath"))
        for f, x in [
            ("title", "//div[contains(@class,'list')]//*"),
            ("last_post_author", "//a[contains(@class,'user')]"),
            ("last_post_date", "//time"),
            ("link", "//a[contains(@class,'subject')]/@href"),
        ]
    ])))


def list_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values for ``list_selectors``: those of the first order whose author is a link."""
    found = eval_selectors(list_nodes(spark, sf), {
        "title": "//a[contains(@class,'subject')]", "last_post_author": "//a[contains(@class,'user')]",
        "last_post_date": "//time", "link": "//a[contains(@class,'subject')]/@href",
    })
    return found.groupBy("page_id", "field").agg(F.min_by("value", "node_id").alias("value")).withColumn("cue_text", F.lit(""))


def list_results(spark: SparkSession, sf: str) -> DataFrame:
    return written(spark, sf, "list-results", lambda: complete_results(list_pages(spark, sf), select_best(classify_feedback(
        list_nodes(spark, sf), list_selectors(spark, sf), list_values(spark, sf)
    ))))


def list_revisions(spark: SparkSession, sf: str) -> DataFrame:
    """Revisions for title (one that changes nothing, one that narrows) and author."""
    offers = [
        ("title", 1, "same again", "//div[contains(@class,'list')]//*"),
        ("title", 2, "only the subject links", "//a[contains(@class,'subject')]"),
        ("last_post_author", 1, "plain text too", "//*[contains(@class,'user')]"),
        ("last_post_author", 2, "never read", "//span"),
    ]
    return list_pages(spark, sf).select("page_id", F.inline(F.array(*[
        F.struct(
            F.lit(f).alias("field"), F.lit(i).alias("iteration"),
            F.lit(e).alias("explanation"), F.lit(x).alias("revised_xpath"),
        ) for f, i, e, x in offers
    ])))


def list_run(spark: SparkSession, sf: str):
    """One whole run over the order lists, shared by the queries that show its tables."""
    return _once(spark, sf, "list-run", lambda: run_all_stages(list_pages(spark, sf)))
