"""String scorers as Arrow-batched pandas UDFs; common subsequences by bit-parallel rows on Python integers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * 2 LCS / (len a + len b); 100 for two empty strings."""
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """100 where one side's words are all on the other, else the best of common words and each side's rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = sorted(x & y)
    if both and (x <= y or y <= x):
        return 100.0
    common = " ".join(both)
    one, two = (" ".join([*both, *sorted(z)]) for z in (x - y, y - x))
    best = ratio(one, two)
    return max(best, ratio(common, one), ratio(common, two)) if common else best


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter string and a window of the longer one, windows at both ends being cut short."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    n, letters, best = len(a), set(a), 0.0
    for end in range(1, len(b) + n):
        lo, hi = max(0, end - n), min(end, len(b))
        if b[hi - 1] in letters or b[lo] in letters:
            best = max(best, ratio(a, b[lo:hi]))
    return best


def jaro_winkler(a: str, b: str) -> float:
    """From 0 to 1; prefixes of up to four letters count a tenth each, above 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    m, theirs = len(mine), [b[j] for j in range(len(b)) if used[j]]
    half = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _column(scorer):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        memo: dict[tuple, float] = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair not in memo:
                memo[pair] = scorer(pair[0] or "", pair[1] or "")
            out.append(memo[pair])
        return pd.Series(out, dtype="float64")
    return run


ratio_of, token_sort_of, token_set_of, partial_of, jaro_winkler_of = map(_column, (ratio, token_sort, token_set, partial, jaro_winkler))
