import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from leafmark.llm.crf import Crf
from leafmark.llm.quality import drop_low_quality, judge_quality, measure
from leafmark.llm.shingles import text_chunks

TEXTS = [
    None, "", " ", "a", "a b", "a b c a b c", "\n\n", "x\n\ny\nx\n x\n\r\nx", "é ü\né ü\n#|<", "end\n", "\n lead", "a\x0bb\x1cc", "a\n\nb\n",
    "w " * 49, "w v u " * 60, "🎉 $$ <&>\n" * 5, "long" * 20_000,
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = defaultdict(list)
    for k in range(len(words) - 2):
        windows[tuple(words[k:k + 3])].append(k)
    repeated = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(3)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(repeated)


def random_text(draw):
    return "".join(draw.choice("ab \n\t#é|") for _ in range(draw.randint(0, 200)))


def prose(draw, n=90):
    return " ".join(f"w{draw.randrange(5000)}" + "." * (k % 9 == 8) + "\n" * (k % 30 == 29) for k in range(n))


def junk(draw, n=90):
    return "\n".join(" | ".join(f"W{draw.randrange(5000)}###" for _ in range(10)) for _ in range(n // 10))


def test_counts(docs, spark):
    draw = random.Random(1)
    texts = TEXTS + [random_text(draw) for _ in range(300)]
    got = judge_quality(docs(texts, n_words=F.lit(0)), spark.createDataFrame([], "doc_id bigint, quality int")).collect()
    assert len(got) == len(texts)
    for r in got:
        counts = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert r.kept == (not r.base_failed)          # nothing to train on: the base rules decide


def test_counts_do_not_depend_on_stretches():
    draw = random.Random(2)
    texts = [t or "" for t in TEXTS] + [random_text(draw) for _ in range(200)]
    for size in (1, 64, 1 << 20):
        for row, data, offsets in text_chunks(pa.array(texts), size):
            m = measure(data, offsets)
            for k in range(len(offsets) - 1):
                assert tuple(int(m[c][k]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(texts[row + k])


def test_held_out_accuracy_and_stage(docs, spark):
    draw = random.Random(3)
    rows = [(k, junk(draw) if k % 4 == 0 else prose(draw)) for k in range(400)] + [(None, prose(draw)), (900, None)]
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(0, 200)] + [(None, 1), (3, None), (200, None)], "doc_id bigint, quality int")
    df = docs(rows, kept=F.lit("theirs"))
    got = {r.doc_id: r.kept for r in judge_quality(df, labels).collect()}
    assert all(got[k] == (k % 4 != 0) for k in range(200, 400)) and got[None] and not got[900]
    stage = drop_low_quality(df, labels)
    assert stage.columns == df.columns
    assert sorted(r.doc_id for r in stage.collect() if r.doc_id is not None) == sorted(k for k, v in got.items() if v and k is not None)


def test_empty_table(docs, spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    assert judge_quality(docs(["a"]).filter("false"), labels).count() == 0


def test_viterbi_is_the_best_path():
    draw = np.random.default_rng(4)
    field = Crf(draw.normal(size=(12, 3)), draw.normal(size=(3, 3)))
    lengths = np.array([0, 5, 1, 0, 4, 5])
    features = draw.integers(0, 12, size=(int(lengths.sum()), 2))
    labels, at = field.decode(features, lengths), 0
    for n in lengths:
        score = field.scores(features[at:at + n])
        paths = [[]]
        for _ in range(n):
            paths = [[*p, y] for p in paths for y in range(3)]
        total = [sum(score[t, y] for t, y in enumerate(p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:])) for p in paths]
        assert list(labels[at:at + n]) == paths[int(np.argmax(total))]
        at += n


def test_slopes_are_those_of_the_likelihood():
    draw = np.random.default_rng(5)
    field = Crf(draw.normal(size=(6, 2)), draw.normal(size=(2, 2)))
    lengths, features, labels = np.array([3, 1, 4]), draw.integers(0, 6, size=(8, 2)), draw.integers(0, 2, size=8)
    _, slope, moves = field.gradient(features, lengths, labels)
    for table, found in ((field.weights, slope), (field.moves, moves)):
        for place in np.ndindex(table.shape):
            ends = []
            for step in (1e-5, -1e-5):
                table[place] += step
                ends.append(field.gradient(features, lengths, labels)[0])
                table[place] -= step
            assert abs((ends[0] - ends[1]) / 2e-5 - found[place]) < 1e-5
