"""String similarities that Spark lacks, as Arrow UDFs: Indel ratio, token-set ratio, edit distance with transpositions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    if not a or not b:
        return 0
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
    """100 times the share of both strings' characters in their longest common subsequence."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * common(a, b) / total


def token_set_ratio(a: str, b: str) -> float:
    """Compares common and remaining tokens; 100 if one's tokens are all among the other's, 0 if either has none."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared = x & y
    if shared and (x <= y or y <= x):
        return 100.0
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    base = len(" ".join(sorted(shared)))
    joint = 1 if base else 0
    with_left, with_right = base + joint + len(left), base + joint + len(right)
    apart = len(left) + len(right) - 2 * common(left, right)
    best = 100.0 - 100.0 * apart / (with_left + with_right)
    if base:
        best = max(best, 100.0 - 100.0 * (joint + len(left)) / (base + with_left), 100.0 - 100.0 * (joint + len(right)) / (base + with_right))
    return best


def edits(a: str, b: str) -> int:
    """Insertions, deletions, changes and swaps of neighbours that turn a into b."""
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = [i]
        for j, d in enumerate(b, 1):
            cost = min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d))
            if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        before, last = last, row
    return last[-1]


def _over(function, kind: T.DataType):
    @F.pandas_udf(kind)
    def column(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b)], dtype="object")

    return column


indel_ratio = _over(ratio, T.DoubleType())
token_set = _over(token_set_ratio, T.DoubleType())
edit_distance = _over(edits, T.IntegerType())
