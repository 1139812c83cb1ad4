"""Linear-chain conditional random field over indicator features, in numpy.

Sequences are stored one after the other; a step handles the items at one position of all
sequences at once, longest first, so nothing is padded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _plan(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the non-empty sequences, longest first, and how many reach each position."""
    start = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    longest = int(lengths[order[0]]) if len(order) else 0
    ordered = lengths[order]
    active = np.searchsorted(-ordered, -np.arange(longest), side="left")
    return start[order], active


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Crf:
    weights: np.ndarray        # features x labels
    moves: np.ndarray          # labels x labels

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=1)

    def decode(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best label of every item (Viterbi); of equal paths the lower label wins."""
        score = self.scores(features)
        n, k = score.shape
        labels = np.zeros(n, dtype=np.int64)
        first, active = _plan(np.asarray(lengths))
        if not len(first):
            return labels
        back = np.zeros((n, k), dtype=np.int8)
        best = score.copy()
        for t in range(1, len(active)):
            at = first[:active[t]] + t
            via = best[at - 1][:, :, None] + self.moves[None]
            back[at] = via.argmax(axis=1)
            best[at] = via.max(axis=1) + score[at]
        spans = np.zeros(len(first), dtype=np.int64)
        for t in range(len(active)):
            spans[:active[t]] = t
        at = first + spans
        labels[at] = best[at].argmax(axis=1)
        for t in range(len(active) - 1, 0, -1):
            at = first[:active[t]] + t
            labels[at - 1] = back[at, labels[at]]
        return labels

    def gradient(self, features: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood and its slope, by forward and backward sums."""
        score = self.scores(features)
        first, active = _plan(np.asarray(lengths))
        ahead, behind = score.copy(), np.zeros_like(score)
        for t in range(1, len(active)):
            at = first[:active[t]] + t
            ahead[at] = _log_sum(ahead[at - 1][:, :, None] + self.moves[None], 1) + score[at]
        for t in range(len(active) - 1, 0, -1):
            at = first[:active[t]] + t
            behind[at - 1] = _log_sum(self.moves[None] + (score[at] + behind[at])[:, None, :], 2)
        total = _log_sum(ahead[first] + behind[first], 1)
        whole = np.empty(len(score))
        moves = np.zeros_like(self.moves)
        value = -float(total.sum())
        for t in range(len(active)):
            at = first[:active[t]] + t
            whole[at] = total[:active[t]]
            if t:
                both = ahead[at - 1][:, :, None] + self.moves[None] + (score[at] + behind[at])[:, None, :] - total[:active[t], None, None]
                np.add.at(moves, (labels[at - 1], labels[at]), 1.0)
                moves -= np.exp(both).sum(axis=0)
                value += float(self.moves[labels[at - 1], labels[at]].sum())
        value += float(score[np.arange(len(score)), labels].sum())
        gap = -np.exp(ahead + behind - whole[:, None])
        gap[np.arange(len(score)), labels] += 1.0
        slope = np.zeros_like(self.weights)
        for column in range(features.shape[1]):
            np.add.at(slope, features[:, column], gap)
        return value, slope, moves


def train(features: np.ndarray, lengths: np.ndarray, labels: np.ndarray, n_features: int, n_labels: int,
          epochs: int = 60, rate: float = 0.3, ridge: float = 1e-3) -> Crf:
    """Full-batch steps with per-weight scaling; the same table always gives the same model."""
    model = Crf(np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels)))
    if not len(features):
        return model
    seen = [np.zeros_like(model.weights), np.zeros_like(model.moves)]
    for _ in range(epochs):
        _, *slopes = model.gradient(features, lengths, labels)
        for part, slope, past in zip((model.weights, model.moves), slopes, seen):
            slope = slope / len(lengths) - ridge * part
            past += slope * slope
            part += rate * slope / np.sqrt(past + 1e-10)
    return model
