"""Grouping by dimensions with mergeable states: fold() of rows, merge() of states, roll_up() for queries.

Each is one hash aggregation with partial sums before its shuffle; distinct sketches in exact mode are grouped on their own (by register)
and joined on the same keys.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import hll, metrics
from tallyloom.types import MetricType

#: (output column, kind, input column).
Item = tuple[str, MetricType, str]


def dim(tag: int) -> str:
    return f"d{tag}"


def met(tag: int) -> str:
    return f"m{tag}"


def _grouped(df: DataFrame, keys: list[str], items: list[Item], mode: str, of: Callable[[MetricType, str], Column], apart: Callable[[DataFrame, list[str], str], DataFrame]) -> DataFrame:
    plain = [i for i in items if not metrics.grouped_by_register(i[1], mode)]
    by_register = [i for i in items if i not in plain]
    if plain or not keys:
        out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *(of(kind, c).alias(name) for name, kind, c in plain))
        out = (out if keys else out.where("_rows > 0")).drop("_rows")
    else:
        out = df.select(*keys).distinct()
    for name, _, c in by_register:
        states = apart(df, keys, c).withColumnRenamed(c, name)
        if keys:
            states = states.select(*(F.col(k).alias(f"_{k}") for k in keys), name)
            same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
            out = out.join(states, same, "left").drop(*(f"_{k}" for k in keys))
        else:
            # One row at most on both sides.
            out = out.withColumn("_one", F.lit(1)).join(states.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    return out.select(*keys, *(name for name, _, _ in items))


def fold(rows: DataFrame, keys: list[str], items: list[Item], order: list[Column], mode: str) -> DataFrame:
    """Rows to states."""
    return _grouped(rows, keys, items, mode, lambda kind, c: metrics.partial(kind, F.col(c), order), hll.exact_partial)


def merge(states: DataFrame, keys: list[str], items: list[Item], mode: str) -> DataFrame:
    """States to states of the same keys."""
    return _grouped(states, keys, items, mode, lambda kind, c: metrics.merge(kind, F.col(c)), hll.exact_merge)


def roll_up(states: DataFrame, keys: list[str], items: list[Item], view_key: list[str], mode: str) -> DataFrame:
    """States of a view to states of some of its dimensions; no keys: one row, or none if there are no states."""
    return _grouped(states, keys, items, mode, lambda kind, c: metrics.roll_up(kind, F.col(c), [F.col(k) for k in view_key]), hll.exact_merge)
