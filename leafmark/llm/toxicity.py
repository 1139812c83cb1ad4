"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

Each word enters as three vectors: one of its own, the mean of its character trigrams' and the
mean of its beginnings' of four to ten bytes (all hashed). Windows of words, each overlapping the next, run through the network in
both directions; attention pools a window's states, and a text's score is that of its highest
window, so one passage in a long text is enough. The network is trained in numpy on a bounded
sample of the labelled documents that are not held out. Scoring reads every word of every text.

Defined results: null and empty texts and texts without letters get the score of a window
without words; repeated rows are scored each; a null id counts as the empty string for the
fold; if the labels lack one of the two classes every score is 0; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from leafmark.llm.common import TRAIN_TEXT_BYTES, documents
from leafmark.llm.shingles import mix, range_hashes, text_chunks

#: Most labelled documents of each class that the network is trained on.
TRAIN_PER_CLASS = 1200
#: ... and most bytes of text in all, first by a hash of their ids.
TRAIN_BYTES = 24_000_000
WINDOW, STRIDE = 48, 40
WORDS, TRIGRAMS, HEADS, WIDTH, STATE = 1 << 14, 1 << 12, 1 << 14, 8, 8
HEAD_BYTES = range(4, 11)
INPUTS = ("words", "grams", "heads")
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
EPOCHS, WARM_UP, BATCH, RATE, DECAY = 14, 4, 256, 0.02, 0.2
#: How far an unlikely label is mistrusted, and in how many texts a word must be to be learnt.
TRUST, LEAST_TEXTS = 0.7, 4
OUT = "doc_id bigint, held_out boolean, score double, predicted int"
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


@dataclass
class Words:
    """Distinct words of a stretch of texts, each word's place among them, and each text's words."""

    own: np.ndarray            # hashed id of each distinct word
    grams: np.ndarray          # hashed trigrams of the distinct words, end to end
    gram_of: np.ndarray        # which distinct word a trigram belongs to
    heads: np.ndarray          # hashed beginnings, and their words
    head_of: np.ndarray
    place: np.ndarray
    offsets: np.ndarray

    def pieces(self) -> list[tuple[str, np.ndarray, np.ndarray]]:
        return [("grams", self.grams, self.gram_of), ("heads", self.heads, self.head_of)]


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Letter runs of texts laid end to end; a run that goes over a text's end is cut there."""
    flags = np.concatenate(([False], _LETTER[data], [False]))
    start = np.flatnonzero(flags[1:] & ~flags[:-1])
    stop = np.flatnonzero(flags[:-1] & ~flags[1:])
    inner = offsets[1:-1]
    slot = np.searchsorted(start, inner, side="right") - 1
    if len(start):
        inner = np.unique(inner[(slot >= 0) & (start[slot] < inner) & (inner < stop[slot])])
        start, stop = np.sort(np.concatenate((start, inner))), np.sort(np.concatenate((stop, inner)))
    first = np.searchsorted(start, offsets)
    if not len(start):
        return Words(*[np.zeros(0, dtype=np.int64)] * 6, first)
    hashes = range_hashes(data, start, stop, fold=True)
    keys, where, place = np.unique(hashes, return_index=True, return_inverse=True)
    begin, length = start[where], (stop - start)[where]
    # Trigrams of "<word>": one for each byte, around it; the word's ends count as byte 0.
    total = np.cumsum(length)
    of = np.repeat(np.arange(len(keys)), length)
    at = np.arange(total[-1]) - np.repeat(total - length, length)
    here = np.repeat(begin, length) + at
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    before = np.where(at > 0, lower[np.maximum(here - 1, 0)], 0).astype(np.uint64)
    after = np.where(at + 1 < np.repeat(length, length), lower[np.minimum(here + 1, len(data) - 1)], 0).astype(np.uint64)
    grams = mix(before * np.uint64(65536) + lower[here] * np.uint64(256) + after) % np.uint64(TRIGRAMS)
    long_enough = [np.flatnonzero(length >= k) for k in HEAD_BYTES]
    head_of = np.concatenate(long_enough)
    size = np.repeat(np.array(HEAD_BYTES), [len(x) for x in long_enough])
    heads = range_hashes(data, begin[head_of], begin[head_of] + size, fold=True) % np.uint64(HEADS)
    order = np.argsort(head_of, kind="stable")
    return Words(
        (keys % np.uint64(WORDS)).astype(np.int64), grams.astype(np.int64), of,
        heads[order].astype(np.int64), head_of[order], place.reshape(-1), first,
    )


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, text) of all windows: word numbers, -1 beyond the text; each text has one at least."""
    lengths = np.diff(offsets)
    count = np.maximum(1, -(-(lengths - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(lengths)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    # The last window ends with the text.
    start = np.minimum(k * STRIDE, np.maximum(0, lengths[text] - WINDOW))
    at = start[:, None] + np.arange(WINDOW)[None]
    return np.where(at < lengths[text][:, None], at + offsets[:-1][text][:, None], -1), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Weights and passes; states are kept as (state, window) so that every gate is contiguous."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (draw.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "words": np.zeros((WORDS, WIDTH), np.float32), "grams": normal(TRIGRAMS, WIDTH, scale=0.1),
            "heads": normal(HEADS, WIDTH, scale=0.02),
            "attend": normal(2 * STATE, scale=0.3), "out": normal(2 * STATE, scale=0.5), "bias": np.zeros(1, np.float32),
        }
        for side in "fb":
            self.p[f"in_{side}"] = normal(3 * STATE, 3 * WIDTH, scale=0.4)
            self.p[f"rec_{side}"] = normal(3 * STATE, STATE, scale=0.3)
            self.p[f"gate_{side}"] = np.zeros(3 * STATE, np.float32)
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, words: Words) -> np.ndarray:
        """Vector of each distinct word, and last one of zeros for the places beyond a text."""
        n = len(words.own)
        x = np.zeros((n + 1, 3 * WIDTH), np.float32)
        x[:n, :WIDTH] = self.p["words"][words.own]
        for k, (name, parts, of) in enumerate(words.pieces(), 1):
            counts = np.bincount(of, minlength=n)
            some = counts > 0
            if some.any():
                starts = (np.cumsum(counts) - counts)[some]
                x[:n, k * WIDTH:(k + 1) * WIDTH][some] = np.add.reduceat(self.p[name][parts], starts, axis=0) / counts[some, None]
        return x

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Each word's part of the update gate, reset gate and new state: (3 states, words)."""
        return {s: np.ascontiguousarray(self.p[f"in_{s}"] @ x.T + self.p[f"gate_{s}"][:, None]) for s in "fb"}

    def run(self, gates: dict[str, np.ndarray], index: np.ndarray, keep: bool = False):
        """Logits of windows; row t of ``index`` has the t-th word of each."""
        width, n = index.shape
        mask = (index < gates["f"].shape[1] - 1).astype(np.float32)
        full = bool(mask.all())
        states = np.empty((width, 2 * STATE, n), np.float32)
        memory: dict[str, list] = {"f": [], "b": []}
        for side, steps, part in (("f", range(width), slice(0, STATE)), ("b", range(width - 1, -1, -1), slice(STATE, None))):
            h = np.zeros((STATE, n), np.float32)
            table, rec = gates[side], self.p[f"rec_{side}"]
            for t in steps:
                own, past = table.take(index[t], axis=1), rec @ h
                zr = own[:2 * STATE]
                zr += past[:2 * STATE]
                np.maximum(zr, -30, out=zr)
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                z, r = zr[:STATE], zr[STATE:]
                new = r * past[2 * STATE:]
                new += own[2 * STATE:]
                np.tanh(new, out=new)
                if keep:
                    memory[side].append((t, h, z, r, new, past[2 * STATE:]))
                change = new - h
                change *= 1 - z
                if not full:
                    change *= mask[t]
                h = h + change
                states[t, part] = h
        weight = self.p["attend"] @ states
        weight[mask == 0] = -1e9
        weight -= weight.max(axis=0)
        np.exp(weight, out=weight)
        weight *= np.maximum(mask, 1e-9)
        weight /= weight.sum(axis=0)
        pooled = np.zeros((2 * STATE, n), np.float32)
        for t in range(width):
            pooled += weight[t] * states[t]
        result = self.p["out"] @ pooled + self.p["bias"]
        return (result, mask, states, weight, pooled, memory) if keep else result

    def slopes(self, words: Words, index: np.ndarray, target: np.ndarray, weight_of: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient over windows, by going back through time.

        The loss is (1 - p^q) / q of the label's probability p: like cross entropy, but a label
        that the network finds very unlikely pulls little, since some labels are wrong.
        """
        used, inverse = np.unique(index, return_inverse=True)
        inverse = inverse.reshape(index.shape)
        last = len(words.own)
        if used[-1] != last:
            used = np.append(used, last)
        x = self.inputs(words)[used]
        gates = self.gates(x)
        result, mask, states, weight, pooled, memory = self.run(gates, inverse, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in INPUTS}
        positive = _sigmoid(result)
        trust = np.where(target > 0, positive, 1 - positive) ** TRUST
        d = ((positive - target) * trust * weight_of).astype(np.float32)
        g["out"] += pooled @ d
        g["bias"] += d.sum()
        d_pooled = self.p["out"][:, None] * d
        d_weight = np.einsum("hn,thn->tn", d_pooled, states)
        d_logit = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_states = weight[:, None] * d_pooled[None] + d_logit[:, None] * self.p["attend"][None, :, None]
        g["attend"] += np.einsum("tn,thn->h", d_logit, states)
        d_x = np.zeros_like(x)
        for side, part in (("f", slice(0, STATE)), ("b", slice(STATE, None))):
            rec, size = self.p[f"rec_{side}"], gates[side].shape
            d_own = np.empty((index.shape[0], size[0], index.shape[1]), np.float32)
            d_h = np.zeros((STATE, index.shape[1]), np.float32)
            for t, h, z, r, new, past in reversed(memory[side]):
                d_h = d_h + d_states[t, part]
                moved = d_h * mask[t]
                d_new = moved * (1 - z) * (1 - new * new)
                d_own[t, :STATE] = -moved * (new - h) * z * (1 - z)
                d_own[t, STATE:2 * STATE] = d_new * past * r * (1 - r)
                d_own[t, 2 * STATE:] = d_new
                d_past = np.concatenate((d_own[t, :2 * STATE], d_new * r))
                g[f"rec_{side}"] += d_past @ h.T
                d_h = d_h - moved * (1 - z) + rec.T @ d_past
            flat = inverse.reshape(-1)
            d_gates = np.stack([np.bincount(flat, weights=d_own[:, k].reshape(-1), minlength=size[1]) for k in range(size[0])]).astype(np.float32)
            g[f"gate_{side}"] += d_gates.sum(axis=1)
            g[f"in_{side}"] += d_gates @ x
            d_x += d_gates.T @ self.p[f"in_{side}"]
        g.update(self._input_slopes(words, used, d_x))
        return g

    def _input_slopes(self, words: Words, used: np.ndarray, d_x: np.ndarray) -> dict[str, np.ndarray]:
        n = len(words.own)
        slopes = {name: np.zeros_like(self.p[name]) for name in INPUTS}
        known = used[np.append(self.known, False)[used]]
        np.add.at(slopes["words"], words.own[known], d_x[np.searchsorted(used, known), :WIDTH])
        real = used < n
        hit = np.zeros(n, dtype=bool)
        hit[used[real]] = True
        for k, (name, parts, of) in enumerate(words.pieces(), 1):
            spread = np.zeros((n, WIDTH), np.float32)
            spread[used[real]] = d_x[real, k * WIDTH:(k + 1) * WIDTH]
            spread /= np.maximum(np.bincount(of, minlength=n), 1)[:, None]
            chosen = hit[of]
            np.add.at(slopes[name], parts[chosen], spread[of[chosen]])
        return slopes

    def logits(self, words: Words, places: np.ndarray, size: int = 4096) -> np.ndarray:
        gates = self.gates(self.inputs(words))
        last = len(words.own)
        out = np.empty(len(places), np.float32)
        place = np.append(words.place, last)
        for k in range(0, len(places), size):
            out[k:k + size] = self.run(gates, np.ascontiguousarray(place[places[k:k + size]].T))
        return out

    def learn_words(self, words: Words) -> None:
        """Only words that several training texts have get a vector of their own."""
        text_of = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))
        pairs = np.unique(words.place * len(words.offsets) + text_of)
        texts = np.bincount(pairs // len(words.offsets), minlength=len(words.own))
        self.known = texts >= LEAST_TEXTS

    def score(self, logit: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * logit + self.shift).astype(np.float64)


def fit(text: pa.Array, toxic: np.ndarray, epochs: int = EPOCHS) -> Network | None:
    """Train on texts: in each epoch a toxic text is stood for by its highest window, another
    by its two highest and a random one, each class with the same total weight.

    Every fifth text is kept back: it decides which epoch's weights stay and gives the line
    that turns a text's highest logit into a probability.
    """
    if not ((toxic == 1).any() and (toxic == 0).any()):
        return None
    net, draw = Network(), np.random.default_rng(11)
    (_, data, offsets), = text_chunks(text, size=1 << 62)
    words = read_words(data, offsets)
    net.learn_words(words)
    places, owner = windows(words.offsets)
    index = np.append(words.place, len(words.own))[places]
    n = len(toxic)
    first = np.searchsorted(owner, np.arange(n))
    count = np.bincount(owner, minlength=n)
    backs = np.zeros(n, dtype=bool)
    for label in (0, 1):
        backs[np.flatnonzero(toxic == label)[4::5]] = True
    learned = np.flatnonzero(~backs)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    balance = np.where(toxic == 1, 0.5 / (toxic == 1).mean(), 0.5 / (toxic == 0).mean())
    best, kept, step = np.inf, net.p, 0
    for epoch in range(epochs):
        random = [(first + (draw.random(n) * count).astype(np.int64))[learned] for _ in range(2)]
        if epoch < WARM_UP:
            chosen = np.concatenate(random)
        else:
            every = net.logits(words, places)
            top = np.maximum.reduceat(every, first)
            loss = _line(top[backs], toxic[backs], balance[backs])[2]
            if loss < best - 1e-4:
                best, kept = loss, {k: v.copy() for k, v in net.p.items()}
                net.scale, net.shift, _ = _line(top[backs], toxic[backs], np.ones(int(backs.sum())))
            order = np.lexsort((-every, owner))
            highest, second = order[first][learned], order[first + np.minimum(1, count - 1)][learned]
            calm = toxic[learned] == 0
            chosen = np.concatenate((highest, second[calm], random[0][calm]))
        chosen = draw.permutation(chosen)
        for k in range(0, len(chosen), BATCH):
            batch = chosen[k:k + BATCH]
            slopes = net.slopes(words, np.ascontiguousarray(index[batch].T), toxic[owner[batch]].astype(np.float32), balance[owner[batch]] / len(batch))
            step += 1
            for name, value in net.p.items():
                m, v = moments[name]
                g = slopes[name]
                m += np.float32(0.1) * (g - m)
                v += np.float32(0.01) * (g * g - v)
                value *= np.float32(1 - DECAY * RATE)
                value -= np.float32(RATE / (1 - 0.9 ** step)) * m / (np.sqrt(v / np.float32(1 - 0.99 ** step)) + np.float32(1e-6))
    net.p = kept
    return net


def _line(top: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Scale, shift and loss of the logistic line from logits to labels."""
    weight = weight / weight.sum()
    middle, spread = float((weight * top).sum()), float(np.sqrt((weight * (top - top.mean()) ** 2).sum())) + 1e-6
    x, a, b = (top - middle) / spread, 1.0, 0.0
    for _ in range(300):
        gap = weight * (_sigmoid(a * x + b) - toxic)
        a, b = a - 2.0 * float((gap * x).sum()), b - 2.0 * float(gap.sum())
    a = max(a, 0.1)
    p = np.clip(_sigmoid(a * x + b), 1e-6, 1 - 1e-6)
    loss = -float((weight * (toxic * np.log(p) + (1 - toxic) * np.log(1 - p))).sum())
    return a / spread, b - a * middle / spread, loss


def _score(net: Network | None):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(1), size=1 << 20):
                n = len(offsets) - 1
                scores = np.zeros(n)
                if net is not None:
                    words = read_words(data, offsets)
                    places, owner = windows(words.offsets)
                    top = np.maximum.reduceat(net.logits(words, places), np.searchsorted(owner, np.arange(n)))
                    scores = net.score(top)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, n), batch.column(2).slice(row, n), pa.array(scores),
                    pa.array((scores >= THRESHOLD).astype(np.int32)),
                ], schema=schema)

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; ``labels``: doc_id, toxic."""
    rows = documents(docs)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    # At most 2 * per_class ids: sent to every task, so that no text moves but the sample's.
    short = rows.filter(F.octet_length("text") <= TRAIN_TEXT_BYTES)
    # One text per chosen id (the least), reduced on the executors: an id repeated in many rows
    # still sends one text.
    sample = short.join(F.broadcast(some[0].unionAll(some[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = sample.select("doc_id", "text", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    if sample.num_rows:
        sizes = pc.binary_length(sample.column("text").combine_chunks())
        sample = sample.filter(pc.less_equal(pc.cumulative_sum(sizes.cast(pa.int64())), TRAIN_BYTES))
    net = fit(sample.column("text").combine_chunks(), sample.column("toxic").to_numpy()) if sample.num_rows else None
    return rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(_score(net), OUT)
