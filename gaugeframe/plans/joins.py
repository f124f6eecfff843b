"""Joins that treat NULL as a key value of its own."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)`` in which NULL keys meet; the key columns are those of ``left``."""
    names = [f"_key_{i}" for i in range(len(keys))]
    other = right.withColumnsRenamed(dict(zip(keys, names)))
    return left.join(other, reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]), how).drop(*names)


def whole_key(columns: Sequence[str]) -> Column:
    """The columns as one key that is never NULL: rows grouped by it join by it where they lie, and NULL fields meet."""
    return F.struct(*columns)
