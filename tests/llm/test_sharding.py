import random
import zlib

from leafmark.llm.sharding import shard_documents


def check(docs, rows, shards=8):
    got = shard_documents(docs(rows), shards=shards).collect()
    assert len(got) == len(rows)
    want = sorted([(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows], key=str)
    assert sorted([(r.doc_id, r["size"], r.text_crc32) for r in got], key=str) == want
    by = {}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by.setdefault(r.shard, []).append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for part in by.values():
        assert abs(sum(r["size"] for r in part) - total / shards) <= 2 * largest + 0.02 * total / shards
    return got


def test_even_with_hot_text_nulls_and_repeats(docs):
    draw = random.Random(3)
    rows = [(i, "w" * draw.randint(0, 400)) for i in range(600)]
    rows += [(1000 + i, "the same text " * 8) for i in range(300)] + [(None, None), (7, None), (7, ""), (8, "é" * 40)]
    check(docs, rows)


def test_small_groups_stay_together(docs):
    rows = [(10 * i + k, f"text number {i} " * 3) for i in range(3000) for k in range(2)]
    got = check(docs, rows, shards=4)
    shards = {}
    for r in got:
        shards.setdefault(r.doc_id // 10, set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 1


def test_fewer_rows_than_shards_and_none(docs):
    check(docs, [(1, "a"), (2, "b")], shards=40)
    assert shard_documents(docs([(1, "a")]).filter("false"), shards=40).count() == 0


def test_very_long_texts_and_clashing_columns(docs):
    from pyspark.sql import functions as F

    rows = [(i, "short text") for i in range(50)] + [(100, "é" * 1_500_000), (101, "x" * 3_000_000), (None, "null id")]
    got = shard_documents(docs(rows, shard=F.lit("theirs"), slot=F.lit(-1), size=F.lit(0)), shards=8).collect()
    assert len(got) == len(rows)
    sizes = {r.doc_id: r["size"] for r in got}
    assert sizes[100] == 3_000_016 and sizes[101] == 3_000_016 and sizes[None] == 7 + 16
    for r in got:
        assert 0 <= r.shard < 8
