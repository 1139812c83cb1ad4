"""The stages over the smallest data set, each against plain Python over what it was given."""

import os
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_jaccard import components
from tests.llm.test_packing import check as check_packing
from tests.llm.test_quality import brute as counts
from tests.llm.test_secret_scan import brute as secrets

SF = "/root/testdata/sf0.001"


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "jaccard_join", "secret_scan", "packing"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given, tables = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        tables.append(docs)
    before = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for table in tables[:-1]:
        assert table.columns == given

    quality = {r.doc_id: r for r in tables[0].collect()}
    for doc_id, row in before.items():
        n_words, _, _, _, repeated = counts(row.text)
        if n_words < 50 or 100 * repeated > 50 * n_words:
            assert doc_id not in quality
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    passing = [i for i, r in before.items() if counts(r.text)[0] >= 50 and 2 * counts(r.text)[4] <= counts(r.text)[0]]
    good = [i for i in passing if labels.get(i) == 1]
    assert sum(i in quality for i in good) >= 0.97 * len(good)

    newest = {}
    for doc_id, row in quality.items():
        newest[row.text] = max(doc_id, newest.get(row.text, doc_id))
    distinct = {r.doc_id: r for r in tables[1].collect()}
    assert sorted(distinct) == sorted(newest.values())

    groups = components([(i, r.text) for i, r in distinct.items()], 5, 80)
    single = {r.doc_id: r for r in tables[2].collect()}
    assert sorted(single) == sorted(i for i, _, c in groups if i == c)

    masked = {r.doc_id: r for r in tables[3].collect()}
    assert sorted(masked) == sorted(single)
    for doc_id, row in single.items():
        spans = [tuple(map(int, s.split(":")[1:])) for s in secrets(row.text).split(",") if s]
        assert (masked[doc_id].text == row.text) == (not spans)
        assert masked[doc_id].n_chars == len(masked[doc_id].text)
        for a, b in spans:
            assert row.text[a:b] not in masked[doc_id].text
        kept = re.sub(r"\[secret\]", "", masked[doc_id].text)
        assert len(kept) <= len(row.text)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: tokenizer.encode(r.text, add_special_tokens=False).ids + [0] for i, r in masked.items()}
    packed = tables[4].collect()
    sequences = check_packing(packed, ids, 2048)
    assert {r.doc_id for r in packed} == set(masked)
    assert len(sequences) <= 1.03 * sum(map(len, ids.values())) / 2048 + 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_odd_rows_empty_table_and_clashing_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    from tests.llm.conftest import SCHEMA

    long_text = " ".join(f"word{k % 997} other{k % 13}" for k in range(30_000))
    rows = [(None, long_text, "en", "s", 1), (None, None, "en", "s", 0), (5, long_text, "en", "s", 1), (6, "", None, None, None),
            (7, "token = 'abcdefghijkl' " * 40 + long_text[:2000], "en", "s", 3)]
    extra = {"keep_id": F.lit("theirs"), "piece": F.lit(9), "ids": F.lit(None).cast("string"), "blob": F.lit("b")}
    for name, docs in (("rows", spark.createDataFrame(rows, SCHEMA)), ("empty", spark.createDataFrame([], SCHEMA))):
        docs = docs.withColumns(extra)
        given = docs.columns
        for k, (stage_name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            path = str(tmp_path / f"{name}-{k}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == given, stage_name
        if name == "empty":
            assert docs.count() == 0
        else:
            assert docs.count() >= 1
