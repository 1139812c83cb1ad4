"""Merkle manifest against a plain recursive build with hashlib."""

import hashlib
import zlib

from pyspark.sql import functions as F, types as T

from leafmark.llm.manifest import merkle_manifest

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return H("".join(field(v) for v in (r[0], r[3], r[2], r[4], text)))


def tamper(r):
    if r[0] is None or r[1] is None or zlib.crc32(str(r[0]).encode()) % 2:
        return r[1]
    return r[1].replace("\n", "")


def tree(nodes):
    """Levels of a tree of threes: list of node lists, bottom first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        cur = levels[-1]
        levels.append([H("".join(cur[i:i + 3])) for i in range(0, len(cur), 3)])
    return levels


def path(levels, pos):
    out = []
    for lv in levels[:-1]:
        run = pos // 3 * 3
        out.append(("".join(lv[run:pos]), "".join(lv[pos + 1:run + 3])))
        pos //= 3
    return out


def fold(p, h):
    for left, right in p:
        h = H(left + h + right)
    return h


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    keys = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees, sub = {}, []
    for s in keys:
        ordered = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = (ordered, tree([leaf(r, r[1]) for r in ordered]))
        sub.append(trees[s][1][-1][0])
    top = tree(sub)
    root = top[-1][0]
    out = []
    for k, s in enumerate(keys):
        ordered, levels = trees[s]
        for pos, r in enumerate(ordered):
            p = path(levels, pos) + path(top, k)
            out.append((r[0], leaf(r, r[1]), levels[-1][0], root, H("".join(a + b for a, b in p)),
                        fold(p, leaf(r, tamper(r))), fold(p, leaf(r, tamper(r))) == root))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("rk", F.lit("clash")).withColumn("tkey", F.lit(1)).repartition(3)


def rows_of(n, sources):
    rows = []
    for i in range(n):
        text = None if i % 11 == 0 else ("line\n" * (i % 4)) + "é" * (i % 3) + str(i)
        rows.append((i * 7 + (1 << 17) * (i % 2), text, None if i % 5 == 0 else "en", sources[i % len(sources)],
                     None if text is None else len(text)))
    return rows


def check(spark, rows):
    got = merkle_manifest(table(spark, rows)).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_many_sources_and_levels(spark):
    check(spark, rows_of(130, ["a", "b", None, "ä", "B", "zz"]))


def test_repeated_and_null_ids(spark):
    rows = rows_of(20, ["a", "b"])
    rows += [(None, "x\ny", "en", "a", 3), (None, "x\ny", "en", "a", 3), (None, "q", None, "a", 1), (14, "dup\n", "en", "a", 4),
             (14, "dup\n", "en", "a", 4), (-5, "neg", "en", "b", 3), (-(1 << 40), None, None, None, None)]
    check(spark, rows)


def test_single_leaf_and_single_source(spark):
    check(spark, [(3, "one\nline", "en", "s", 8)])
    check(spark, rows_of(10, ["only"]))


def test_empty_table(spark):
    assert merkle_manifest(spark.createDataFrame([], SCHEMA)).count() == 0
