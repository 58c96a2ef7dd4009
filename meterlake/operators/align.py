"""Which value of a row stands under which header: an order-preserving assignment of least cost.

There is no built-in for this, so it is an Arrow UDF; it sees the offsets of cells only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

AWAY = 40.0  # cost of leaving a value without a header


def _distance(value: tuple[int, int], header: tuple[int, int]) -> float:
    (a, b), (c, d) = value, header
    if c <= a and b <= d or a <= c and d <= b:
        return 0.0
    return min(abs(a - c), abs(b - d), abs(a + b - c - d) / 2)


def assign(values: list[tuple[int, int]], headers: list[tuple[int, int]]) -> list[int]:
    """For each header the place of its value in ``values``, -1 without one.

    Of assignments with the same cost the one that, seen from the right, rather matches than leaves a header empty, and
    rather that than a value out.
    """
    best = [0.0] * (len(headers) + 1)
    moves: list[list[int]] = []
    for i, v in enumerate(values, 1):
        row, chosen = [i * AWAY], [2]
        for j, h in enumerate(headers):
            options = (best[j] + _distance(v, h), row[j], best[j + 1] + AWAY)
            k = min(range(3), key=options.__getitem__)
            row.append(options[k])
            chosen.append(k)
        best = row
        moves.append(chosen)
    out = [-1] * len(headers)
    i, j = len(values), len(headers)
    while i and j:
        move = moves[i - 1][j]
        if move == 0:
            out[j - 1] = i - 1
        i, j = i - (move != 1), j - (move != 2)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _assigned(value_starts: pd.Series, value_ends: pd.Series, header_starts: pd.Series, header_ends: pd.Series) -> pd.Series:
    return pd.Series([assign(list(zip(a, b)), list(zip(c, d))) for a, b, c, d in zip(value_starts, value_ends, header_starts, header_ends)])


def assigned(values: Column, headers: Column) -> Column:
    """``assign`` of two arrays of cells."""
    return _assigned(values["start"], values["end"], headers["start"], headers["end"])
