"""Uniform numbers in [0, 1) from whole numbers: alike in every engine, partition and run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, so that other engines give the same numbers.
PRIME = 2147483647
TERMS = (1000003, 10007, 101, 7919, 12345)
ROUNDS = ((48271, 11), (69621, 13), (16807, 17))


def uniform(i: Column, j: Column | int, seed: int, stream: int) -> Column:
    a, b, c, d, e = TERMS
    j = F.lit(j) if isinstance(j, int) else j
    h = (i.cast("bigint") * a + j.cast("bigint") * b + F.lit(seed * c + stream * d + e).cast("bigint")) % PRIME
    for m, k in ROUNDS:
        h = (h * h + h * m + k) % PRIME
    return h / F.lit(float(PRIME))


def uniform_sql(i: str, j: str | int, seed: int, stream: int) -> str:
    """The same as SQL text, for DuckDB."""
    a, b, c, d, e = TERMS
    h = f"((CAST({i} AS BIGINT) * {a} + CAST({j} AS BIGINT) * {b} + {seed * c + stream * d + e}) % {PRIME})"
    for m, k in ROUNDS:
        h = f"list_transform([{h}], lambda h: (h * h + h * {m} + {k}) % {PRIME})[1]"
    return f"({h} / CAST({PRIME} AS DOUBLE))"
