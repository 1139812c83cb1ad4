import hashlib

from pyspark.sql import functions as F

from leafmark.llm.exact_dedup import drop_copies, exact_dedup


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), digest) for i in ids]
    return sorted(out, key=str)


def check(docs, rows):
    got = exact_dedup(docs(rows)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)
    kept = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_nulls_empty_repeats_and_ties(docs):
    check(docs, [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "a"), (None, "lonely"), (6, "A"), (7, "a ")])


def test_hot_text_is_split_and_merged(docs):
    check(docs, [(i, "copy " * 5) for i in range(400)] + [(400 + i, f"own {i}") for i in range(300)] + [(900, "copy " * 5 + "x")])


def test_same_beginning_and_long_texts(docs):
    check(docs, [(i, "x" * 50_000 + str(i // 2)) for i in range(10)])


def test_empty_table(docs):
    assert exact_dedup(docs([(1, "a")]).filter("false")).count() == 0
    assert drop_copies(docs([(1, "a")]).filter("false")).count() == 0


def test_drop_copies_keeps_columns_and_one_row_each(docs):
    rows = [(i, "hot") for i in range(200)] + [(500, "x"), (500, "x"), (501, None), (502, ""), (None, "n")]
    df = docs(rows, __lm_other=F.lit(1), text_sha256=F.lit("theirs"))
    out = drop_copies(df)
    assert out.columns == df.columns
    assert sorted([(r.doc_id, r.text or "") for r in out.collect()], key=str) == sorted([(199, "hot"), (500, "x"), (502, ""), (None, "n")], key=str)


def test_smallest(docs):
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup(docs([(3, "a"), (1, "a"), (2, "a")]), keep="smallest").collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (1, False)}


def test_staged_tables_can_be_dropped(spark, docs):
    import os

    from leafmark.session import shared_folder, staging

    folder = f"{shared_folder(spark)}/leafmark-corpus"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with staging() as staged:
        assert exact_dedup(docs([(1, "a"), (2, "a")])).count() == 2
        assert set(os.listdir(folder)) > before
        staged.drop(spark)
    assert set(os.listdir(folder)) == before
