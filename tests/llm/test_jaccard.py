import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmark.llm import jaccard
from leafmark.llm.components import connected_components
from leafmark.llm.jaccard import jaccard_components, jaccard_join, keep_one_of_each
from leafmark.llm.shingles import shingle_set
from leafmark.session import staging


def sets(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1)))


def components(rows, width, percent):
    own = [(i, sets(t, width)) for i, t in rows]
    parent = {i: i for i, _ in own if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(own):
        for j, b in own[:k]:
            if a and b and None not in (i, j) and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted([(i, len(s), None if i is None else find(i)) for i, s in own], key=str)


def check(docs, rows, width, percent):
    got = jaccard_components(docs(rows, node=F.lit(1), component_id=F.lit("theirs")), width, percent).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == components(rows, width, percent)


def variants(seed, bases, copies, words=60, vocabulary=400):
    """Texts and copies of them with a few words changed, and a passage that many share."""
    draw = random.Random(seed)
    passage = [f"p{k}" for k in range(20)]
    rows = []
    for b in range(bases):
        base = [f"w{draw.randrange(vocabulary)}" for _ in range(draw.randint(words // 2, words))]
        if b % 3 == 0:
            base += passage
        rows.append(" ".join(base))
        for _ in range(copies):
            other = list(base)
            for _ in range(draw.randint(0, 4)):
                other[draw.randrange(len(other))] = f"c{draw.randrange(50)}"
            rows.append(" ".join(other))
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (1, 60)])
def test_against_all_pairs(docs, width, percent):
    check(docs, variants(width, 25, 6), width, percent)


def test_odd_rows(docs):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one"), (7, "é É"), (8, "é é"), (8, "one"),
            (9, "a b c d e"), (9, "x y z"), (10, "X Y Z"), (11, "w " * 40_000), (12, "w " * 40_000 + "v"), (-5, "a b c d e")]
    check(docs, rows, 3, 90)


def test_long_lists_go_by_pivots(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_SHINGLE", 20)
    check(docs, variants(11, 2, 90, words=50), 3, 90)
    check(docs, variants(12, 6, 40, words=90), 3, 80)


def test_one_large_group_of_copies(docs):
    check(docs, [(i, "the same words again and again " * 9) for i in range(300)] + variants(1, 3, 3), 3, 90)


def check_links(docs, rows, width, percent):
    own = [(i, sets(t, width)) for i, t in rows if i is not None]
    found = {(i, j): len(a & b) for i, a in own for j, b in own if i < j and a and b and a != b and 100 * len(a & b) >= percent * len(a | b)}
    least = {s: min(i for i, t in own if t == s) for _, s in own}
    joined = jaccard_join(docs(rows), width, percent)
    links = joined.links.collect()
    assert len(links) == len({(r.class_a, r.class_b) for r in links})
    assert sorted((r.a, r.b, r.common) for r in links) == sorted((i, j, c) for (i, j), c in found.items() if {i, j} <= set(least.values()))
    members = joined.members.collect()
    n_links = {i: sum(bool(s) and i != j and 100 * len(s & o) >= percent * len(s | o) for j, o in own) for i, s in own}
    assert {r.doc_id: r.n_links for r in members if r.doc_id is not None} == n_links
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in members], key=str) == components(rows, width, percent)
    return links


@pytest.mark.parametrize("sent", [500_000, 0])
def test_first_shingles_travel_only_for_pairs_whose_sketches_fit(spark, monkeypatch, sent):
    """Also where an id has several sets: each pair of sets is judged by its own rows."""
    draw = random.Random(9)

    def sketch(tokens):
        bits = np.bincount([t % 256 for t in tokens], minlength=256) & 1
        return np.packbits(bits).view(np.int64).tolist()

    own = {}
    for k in range(60):
        tokens = sorted(draw.sample(range(100_000), 40)) if k % 3 == 0 else sorted({*own[k - k % 3][1][1:], 200_000 + k})
        own[k] = (k if k != 58 else 10, tokens, sketch(tokens))          # id 10 has two sets
    firsts = spark.createDataFrame([(k, node, len(t), t[:9], s) for k, (node, t, s) in own.items()],
                                   "class_no bigint, node bigint, n bigint, prefix array<bigint>, sketch array<bigint>")
    pairs = spark.createDataFrame([(a, b, True) for a in range(58) for b in range(a)], "a bigint, b bigint, pivot boolean")
    written = {}

    def staged(df, name):
        written[name] = df.localCheckpoint()
        return written[name]

    monkeypatch.setattr(jaccard, "staged", staged)
    monkeypatch.setattr(jaccard, "SENT_IDS", sent)
    got = sorted((r.a, r.b, r.pivot, r.common) for r in jaccard._plausible(pairs, firsts, 90).collect())
    want, near = [], 0
    for x, s, u in own.values():
        for y, t, v in own.values():
            differ = sum(bin((p ^ q) & (1 << 64) - 1).count("1") for p, q in zip(u, v))
            least = -(-90 * (len(s) + len(t)) // 190)
            if y < x < 58 and differ <= len(s) + len(t) - 2 * least:
                near += 1
                common = len({*s[:9]} & {*t[:9]})
                if common + max(len(s), len(t)) - 9 >= least:
                    want.append((x, y, True, common))
    assert got == sorted(want) and len(want) > 20
    narrow = written["near-pairs"]
    assert narrow.count() == near < pairs.count() // 5
    assert not any(kind.startswith("array") for _, kind in narrow.dtypes)


def test_tables_with_sets_are_dropped_when_used(docs):
    with staging() as kept:
        joined = jaccard_join(docs(variants(4, 4, 6)), 3, 90)
        members = joined.members.count()
    names = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in kept.paths}
    assert members == 28 and {"signatures", "class-components", "all-links"} <= names
    assert not names & {"shingle-index", "shingle-sets", "sets", "chunks"}


@pytest.mark.parametrize("width, percent, chunk", [(3, 60, 512), (3, 60, 7)])
def test_every_link(docs, monkeypatch, width, percent, chunk):
    """Links inside components too, also where a component is cut into many chunks."""
    monkeypatch.setattr(jaccard, "CHUNK_SETS", chunk)
    rows = [*variants(3, 3, 30, words=50), (None, "x y z"), (900, "x y z"), (901, "X y z"), (902, None), (903, "")]
    links = check_links(docs, rows, width, percent)
    assert len(links) > len({x for r in links for x in (r.a, r.b)})


def test_links_of_long_texts(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_SHINGLES", 4000)
    monkeypatch.setattr(jaccard, "COLUMNS", 300)
    check_links(docs, variants(5, 2, 25, words=2000, vocabulary=9000), 3, 90)


def test_links_of_an_id_with_several_sets(docs):
    rows = [(1, "a b c d e f g h i j k l m"), (1, "n o p q r s t u v w x y z"), (2, "a b c d e f g h i j k l m n"), (3, "n o p q r s t u v w x y z z"),
            (2, "a b c d e f g h i j k l m n")]
    joined = jaccard_join(docs(rows), 3, 90)
    assert sorted((r.a, r.b) for r in joined.links.collect()) == [(1, 2), (1, 3)]
    assert {r.component_id for r in joined.members.collect()} == {1}


def test_empty_table(docs):
    assert jaccard_components(docs(["a"]).filter("false")).count() == 0


def test_empty_table_has_no_links(docs):
    joined = jaccard_join(docs(["a"]).filter("false"))
    assert joined.links.count() == joined.members.count() == 0


def test_keep_one(docs):
    rows = [(3, "a b c d e f g"), (1, "A b c d e f g"), (2, "other words stand here now"), (None, "a b c d e f g"), (4, None)]
    out = keep_one_of_each(docs(rows))
    assert sorted([r.doc_id for r in out.collect()], key=str) == [1, 2, 4, None] and out.columns == docs(rows).columns


def test_list_reader_over_batches():
    """Lists that go over batch borders give the same pairs, long ones their entries."""
    draw = random.Random(2)
    entries = sorted((t, draw.randint(20, 26), draw.randint(0, 3), 100 * t + k)
                     for t in range(40) for k in range(draw.choice([1, 2, 3, 9, 16, 17, 40])))

    def read(size):
        pairs, long = [], []
        parts = [entries[k:k + size] for k in range(0, len(entries), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*p)], names=["token", "n", "pos", "node"]) for p in parts]
        for batch in jaccard._read_lists(80)(iter(batches)):
            for row in batch.to_pylist():
                (long if row["b"] is None else pairs).append(tuple(row.values()))
        return sorted(pairs), sorted(long, key=str)

    want = read(10_000)
    assert want[0] and {t for _, _, t, _, _ in want[1]} == {t for t in range(40) if sum(e[0] == t for e in entries) > 16}
    for size in (1, 7, 50):
        assert read(size) == want
    plain = {(min(a[3], b[3]), max(a[3], b[3])) for a in entries for b in entries if a[0] == b[0] and a[3] < b[3]
             and sum(e[0] == a[0] for e in entries) <= 16 and 100 * min(a[1], b[1]) >= 80 * max(a[1], b[1])
             and min(a[1] - a[2], b[1] - b[2]) >= -(-80 * (a[1] + b[1]) // 180)}
    assert {(a, b) for a, b, *_ in want[0]} == plain


def test_shingle_sets_count_like_plain_ones():
    for text in ["", "a", "A a", "x y z x y z", "é ü é ü", "a\x0bb\x1cc", "w " * 100, "one  two\n\nthree"]:
        for width in (1, 3, 5):
            assert len(shingle_set(np.frombuffer(text.encode(), dtype=np.uint8), width)) == len(sets(text, width))


def test_components(spark):
    draw = random.Random(8)
    edges = [(k, k + 1) for k in range(100, 180)] + [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(5, 5), (999, 900)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
