"""Time the headline steps on local[$BENCH_CPUS]; prints one JSON line.

Each time is that of one fresh execution into a no-op sink. The node tables the later steps
read are written first; `shred_html` and `run_all_stages` contain that work themselves.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession, functions as F  # noqa: E402

from checks import inputs as I  # noqa: E402
from leafmark.operators import condense, induce, propose, reconcile, sanitize, selectors, tree, validate  # noqa: E402
from leafmark.plans.full_run import run_all_stages  # noqa: E402
from leafmark.session import stage, tune  # noqa: E402
from leafmark.sources.html_tree import shred_html, write_nodes  # noqa: E402


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("leafmark-bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    seconds: dict[str, float] = {}

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def timed(name: str, make) -> None:
        start = time.perf_counter()
        df = make()
        if df is not None:
            drain(df)
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)

    pages = I.pages(spark, sf)
    drain(shred_html(pages))                       # starts the Python workers
    lists = stage(I.list_pages(spark, sf), "bench-lists")
    n_pages, n_lists = pages.count(), lists.count()

    timed("scan_pages", lambda: I.pages(spark, sf))
    timed("shred_html", lambda: shred_html(pages))
    nodes = write_nodes(pages)
    timed("sanitize_pages", lambda: sanitize.sanitize_pages(nodes))
    timed("page_xml", lambda: tree.page_xml(nodes))
    timed("eval_selector", lambda: selectors.eval_selectors(nodes, I.PAGE_SELECTORS))
    timed("eval_selector_attr", lambda: selectors.eval_selector(nodes, "//nav//li/a/@href"))

    list_nodes = write_nodes(lists)
    timed("propose_values", lambda: propose.propose_values(list_nodes))
    values = stage(propose.propose_values(list_nodes).select("page_id", "field", "value", "cue_text"), "bench-values")
    targets = condense.target_texts(values)
    timed("fuzzy_node_match", lambda: condense.fuzzy_node_match(list_nodes, targets))
    timed("condense_pages", lambda: condense.condense_pages(list_nodes, targets))
    timed("induce_selectors", lambda: induce.induce_selectors(list_nodes, values))
    table = lists.select("page_id", F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(1).alias("iteration"), F.lit(x).alias("xpath"))
        for f, x in [
            ("title", "//div[contains(@class,'list')]//*"), ("last_post_author", "//a[contains(@class,'user')]"),
            ("last_post_date", "//time"), ("link", "//a[contains(@class,'subject')]/@href"),
        ]
    ])))
    timed("classify_feedback", lambda: validate.classify_feedback(list_nodes, table, values))
    results = stage(validate.select_best(validate.classify_feedback(list_nodes, table, values)), "bench-results")
    timed("reconcile", lambda: reconcile.reconcile(list_nodes, results, I.list_revisions(spark, sf)))
    timed("run_all_stages", lambda: run_all_stages(lists).outputs)

    # The same orders in few large pages: several hundred rows each, nested, with long classes.
    wide = stage(I.list_pages(spark, sf, per_list=1600, wrappers=15), "bench-wide")
    n_wide, html_bytes = wide.agg(F.count("*"), F.sum(F.octet_length("html"))).first()
    wide_nodes = write_nodes(wide)
    n_nodes, node_bytes = wide_nodes.agg(F.count("*"), F.sum(F.octet_length("trail") + 4 * F.size("anc") + F.coalesce(F.octet_length("text"), F.lit(0)))).first()
    headline = dict(seconds)
    timed("wide_shred_html", lambda: shred_html(wide))
    timed("wide_run_all_stages", lambda: run_all_stages(wide).outputs)

    per_second = {
        name: round((n_pages if name in ("shred_html", "sanitize_pages", "page_xml", "eval_selector", "eval_selector_attr") else n_lists) / s)
        for name, s in headline.items() if s > 0 and name != "scan_pages"
    }
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(headline.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf.rsplit("sf", 1)[-1], "pages": n_pages, "list_pages": n_lists,
        "pages_per_second": per_second, "cpus": cpus,
        "wide_pages": n_wide, "wide_nodes": n_nodes, "wide_rows_bytes_over_html": round(node_bytes / max(1, html_bytes), 2),
        "wide_nodes_per_second": {k: round(n_nodes / s) for k, s in seconds.items() if k.startswith("wide_") and s > 0},
    }))


if __name__ == "__main__":
    main()
