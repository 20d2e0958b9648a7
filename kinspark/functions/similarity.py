"""Similarities of two values. All but Jaro-Winkler are built-in expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _jaro_winkler(a: str, b: str) -> float:
    """1 for equal strings, 0 if either is empty; the prefix counts above 0.7 only."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for c, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(mine, theirs)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + 0.1 * same * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Arrow batches; each distinct pair of values is computed once per task. Null gives null."""
    known: dict[tuple[str, str], float] = {}
    for left, right in pairs:
        out = []
        if len(known) > 500_000:
            known.clear()
        for a, b in zip(left, right):
            if a is None or b is None:
                out.append(None)
                continue
            x = known.get((a, b))
            if x is None:
                x = known[a, b] = _jaro_winkler(a, b)
            out.append(x)
        yield pd.Series(out, dtype="float64")


def exact(a: Column, b: Column) -> Column:
    """1 if equal, else 0; 0 if either is missing."""
    return F.coalesce((a == b).cast("double"), F.lit(0.0))


def similar(jw: Column, threshold: float) -> Column:
    """1 if a Jaro-Winkler similarity reaches the threshold, else 0; 0 if it is missing."""
    return F.coalesce((jw >= threshold).cast("double"), F.lit(0.0))


def gauss(a: Column, b: Column, offset: float, scale: float) -> Column:
    """1 up to ``offset``, then falling to a half at offset + scale; 0 if either is missing."""
    d = F.abs(a - b)
    return F.coalesce(F.when(d <= offset, 1.0).otherwise(F.pow(F.lit(2.0), -F.pow((d - offset) / scale, 2))), F.lit(0.0))


def edit_distance_share(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; null if either is missing or empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.levenshtein(a, b) / longer)


def log_ratio(a: Column, b: Column) -> Column:
    """Absolute difference of decimal logarithms; null unless both are positive."""
    return F.when((a > 0) & (b > 0), F.abs(F.log10(a) - F.log10(b)))
