"""Run queries against their SQL: python -m checks.compare [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return f"{value:.6f}"
    return "NULL" if value is None else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, sf: str, query, sql: str | None):
    """(ok, message) of one query."""
    df = query(spark, sf)
    columns, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"{len(got)} rows, no SQL"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.execute(sql)
    want_columns, want = _rows([d[0] for d in rel.description], rel.fetchall())
    if columns != want_columns:
        return False, f"columns {columns} != {want_columns}"
    if got == want:
        return True, f"{len(got)} rows"
    extra, missing = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    return False, f"{len(got)} rows, SQL {len(want)}; only here {extra[:2]}; only SQL {missing[:2]}"


def main() -> int:
    from checks.oracles import ORACLES
    from checks.queries import QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    bad = 0
    for name in names:
        start = time.time()
        try:
            ok, note = compare(spark, sf, QUERIES[name], ORACLES.get(name))
        except Exception as error:  # report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.1f}s {note[:1200]}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(main())
