"""Edit distance in which swapping two neighbouring characters is one edit (optimal string alignment)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edit_distance(a: str, b: str) -> int:
    older: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        older, last = last, row
    return last[-1]


@F.pandas_udf(T.IntegerType())
def _exact(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b)], dtype="Int32")


def within(a: Column, b: Column, most: int) -> Column:
    """Whether the distance is at most ``most``. Lengths come first, then Levenshtein, which is at most twice the distance; the exact distance is computed for what is left, and in the JVM where ``most`` is 1."""
    near = (F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b) <= 2 * most)
    if most == 1:
        swaps = F.exists(
            F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
            lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b,
        )
        return near & ((F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & swaps))
    return near & F.when(near, _exact(a, b) <= most).otherwise(False)


def distance(a: Column, b: Column) -> Column:
    return _exact(a, b)
