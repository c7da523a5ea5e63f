"""String similarity scores, 0 to 100, for Arrow batches of distinct pairs.

The weighted ratio follows the published description of the WRatio scorer. A batch holds distinct pairs, and scores
are remembered, so a pair is scored once per worker.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a and b else 0.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter with a stretch of the longer, stretches cut at its edges included."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    n = len(short)
    return max(ratio(short, long[max(0, k) : k + n]) for k in range(1 - n, len(long)))


def _sorted_words(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_sorted_words(a), _sorted_words(b))


def _word_sets(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return tuple(" ".join(sorted(s)) for s in (x & y, x - y, y - x))


def token_set_ratio(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    both, left, right = _word_sets(a, b)
    if both and (not left or not right):
        return 100.0
    with_left, with_right = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max([ratio(with_left, with_right)] + ([ratio(both, with_left), ratio(both, with_right)] if both else []))


def partial_token_ratio(a: str, b: str) -> float:
    both, left, right = _word_sets(a, b)
    return 100.0 if both else max(partial_ratio(_sorted_words(a), _sorted_words(b)), partial_ratio(left, right))


@lru_cache(maxsize=200_000)
def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    plain = ratio(a, b)
    if longer < 1.5:
        return max(plain, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if longer <= 8 else 0.6
    return max(plain, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


SCORERS = {"wratio": weighted_ratio, "ratio": ratio, "partial_ratio": partial_ratio, "token_set_ratio": token_set_ratio}


def score(a: Column, b: Column, scorer: str = "wratio") -> Column:
    """Score of two string columns; an unknown scorer is taken as ``wratio``."""
    of = SCORERS.get(scorer, weighted_ratio)

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([of(p or "", q or "") for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)
