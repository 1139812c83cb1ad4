"""String similarity: edit distance in the JVM, best-window similarity as an Arrow UDF."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BooleanType

from leafmark.model import DISTANCE_LIMIT, PARTIAL_RATIO_LIMIT


def edit_distance_ratio(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length, 0.0 for two empty texts."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(a, b) / longest)


def is_near(a: Column, b: Column, limit: float = DISTANCE_LIMIT) -> Column:
    """Is the edit distance ratio at most ``limit``? Lengths first, then a bounded distance."""
    la, lb = F.char_length(a), F.char_length(b)
    allowed = F.floor(F.greatest(la, lb) * F.lit(limit)).cast("int")
    bounded = F.call_function("levenshtein", a, b, allowed)
    return (a == b) | ((allowed >= 1) & (F.abs(la - lb) <= allowed) & (bounded >= 0))


def _window_starts(short: str, long: str, floor: float) -> list[tuple[int, int]]:
    """Windows of ``long`` (start, length) that could reach the ratio ``floor``.

    A window shares at most min(count in short, count in window) of each character with
    ``short``; running counts give that bound for all windows at once. Dropping a window
    below the bound never drops the best one that reaches ``floor``.
    """
    m, n = len(short), len(long)
    starts = np.arange(1 - m, n)
    lo = np.maximum(starts, 0)
    hi = np.minimum(starts + m, n)
    codes = np.frombuffer(long.encode("utf-32-le"), dtype=np.uint32)
    shared = np.zeros(len(starts), dtype=np.int64)
    for char, count in Counter(short).items():
        running = np.concatenate(([0], np.cumsum(codes == ord(char))))
        shared += np.minimum(running[hi] - running[lo], count)
    bound = 200.0 * shared / (m + hi - lo)
    keep = np.nonzero(bound >= floor)[0]
    keep = keep[np.argsort(-bound[keep], kind="stable")]
    return [(int(lo[i]), int(hi[i] - lo[i])) for i in keep]


def _common_length(masks: dict[str, int], ones: int, window: str) -> int:
    """Length of the longest common subsequence, one machine-integer step per character."""
    row = ones
    for char in window:
        hit = row & masks.get(char, 0)
        row = ((row + hit) | (row - hit)) & ones
    return (~row & ones).bit_count()


def best_window_reaches(a: str, b: str, floor: float = PARTIAL_RATIO_LIMIT) -> bool:
    """Does some window of the longer text have 200*LCS/(total length) >= floor?"""
    if not a or not b:
        return not a and not b
    pairs = [(a, b)] if len(a) < len(b) else [(b, a)] if len(b) < len(a) else [(a, b), (b, a)]
    for short, long in pairs:
        # No window shares more characters with `short` than the whole text, or is shorter than that.
        shared = sum(min(short.count(c), long.count(c)) for c in set(short))
        if 200.0 * shared / (len(short) + shared) < floor:
            continue
        ones = (1 << len(short)) - 1
        masks: dict[str, int] = {}
        for i, char in enumerate(short):
            masks[char] = masks.get(char, 0) | (1 << i)
        for start, size in _window_starts(short, long, floor):
            common = _common_length(masks, ones, long[start:start + size])
            if 200.0 * common / (len(short) + size) >= floor:
                return True
    return False


@lru_cache(maxsize=1 << 14)
def _remembered(a: str, b: str) -> bool:
    return best_window_reaches(a, b)


def window_reaches(a: str, b: str) -> bool:
    """``best_window_reaches``, remembered for short texts: selectors of a page find the same ones."""
    return _remembered(a, b) if len(a) + len(b) <= 500 else best_window_reaches(a, b)


@F.pandas_udf(BooleanType())
def partial_ratio_match(a: pd.Series, b: pd.Series) -> pd.Series:
    """Best-window similarity of at least 85 percent; run it only on rows that need it."""
    return pd.Series([
        None if x is None or y is None else best_window_reaches(x, y) for x, y in zip(a, b)
    ], dtype=object)
