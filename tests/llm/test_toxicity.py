import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from leafmark.llm.shingles import text_chunks
from leafmark.llm.toxicity import STRIDE, WINDOW, Network, read_words, score_toxicity, windows


def test_windows_cover_every_word():
    for lengths in ([0], [1], [WINDOW], [WINDOW + 1], [0, 5, 3 * WINDOW + 7, 2 * STRIDE]):
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        places, text = windows(offsets)
        for k, n in enumerate(lengths):
            mine = places[text == k]
            assert len(mine) >= 1 and set(mine[mine >= 0]) == set(range(offsets[k], offsets[k] + n))


def test_words_do_not_depend_on_neighbours():
    texts = ["", "Ab cd", "cd", "éa 12 b", "", "ab"]
    whole = [(row, read_words(data, offsets)) for row, data, offsets in text_chunks(pa.array(texts), 1 << 20)]
    words = whole[0][1]
    assert np.diff(words.offsets).tolist() == [0, 2, 1, 2, 0, 1]
    own = words.own[words.place]
    assert own[0] == own[5] and own[1] == own[2]


def test_slopes_are_those_of_the_loss():
    net = Network(3)
    data = np.frombuffer(b"some words here and others there with more of them", dtype=np.uint8)
    words = read_words(data, np.array([0, len(data)]))
    net.learn_words(words)
    net.known[:] = True
    index = np.full((6, 2), len(words.own))
    index[:, 0] = words.place[:6]
    index[:4, 1] = words.place[4:8]
    target, weight = np.array([1.0, 0.0], np.float32), np.array([0.5, 1.5])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    slopes = net.slopes(words, index, target, weight)

    def loss():
        p = 1 / (1 + np.exp(-net.run(net.gates(net.inputs(words)), index).astype(np.float64)))
        p = np.where(target > 0, p, 1 - p)
        return float((weight * (1 - p ** 0.7) / 0.7).sum())

    draw = np.random.default_rng(1)
    for name, value in net.p.items():
        places = [tuple(draw.integers(0, s) for s in value.shape) for _ in range(4)]
        if name in ("words", "grams", "heads"):
            rows = {"words": words.own, "grams": words.grams, "heads": words.heads}[name]
            places = [(int(draw.choice(rows)), int(draw.integers(0, value.shape[1]))) for _ in range(4)]
        for place in places:
            ends = []
            for step in (1e-2, -1e-2):
                value[place] += step
                ends.append(loss())
                value[place] -= step
            assert abs((ends[0] - ends[1]) / 2e-2 - slopes[name][place]) < 2e-3, (name, place)


def test_held_out_accuracy(docs, spark):
    draw = random.Random(6)
    bad = ["vilewort", "grimfool", "muckling", "snarlpot"]

    def text(toxic):
        words = ["".join(draw.choice("abcdeilmnorst") for _ in range(draw.randint(2, 7))) for _ in range(draw.randint(60, 200))]
        for _ in range(3 * toxic):
            words[draw.randrange(len(words))] = draw.choice(bad) + draw.choice(["", ".", ","])
        return " ".join(words)

    rows = [(k, text(int(k % 4 == 0))) for k in range(2100)] + [(None, None), (2000, ""), (2001, "12 34 !!"), (2002, "fine " * 9000 + bad[0] + " here " * 3)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(1800)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    got = score_toxicity(docs(rows, score=F.lit("theirs"), held_out=F.lit(1)), labels).collect()
    assert len(got) == len(rows)
    hits = [(r.predicted == int(r.doc_id % 4 == 0)) for r in got if r.doc_id is not None and 1800 <= r.doc_id < 2100]
    assert sum(hits) >= 0.95 * len(hits)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1)


def test_without_labels_and_rows(docs, spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.score for r in score_toxicity(docs(["a b"]), none).collect()] == [0.0]
    assert score_toxicity(docs(["a"]).filter("false"), none).count() == 0


def test_repeated_id_sends_one_text(docs, spark):
    """An id in many rows is trained on once: the sample holds one text per id."""
    rows = [(7, f"awful vilewort text number {k}") for k in range(300)] + [(8, "gentle kind words")] * 3 + [(9, None)]
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id bigint, toxic int")
    got = score_toxicity(docs(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
