"""Metric states: how rows fold into a state, how states merge, and how a state becomes a value.

Nulls are the identity: a null input changes no state. Sums of integers raise on overflow. A gauge's state carries the order by which
its last value is known, so states merge in any order; at query time the row with the greatest view key has the last value.

KINDS has what each metric type does; register() puts another in its place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions import hll
from tallyloom.types import MetricType

EXACT, SKETCH = "exact", "sketch"


@dataclass(frozen=True)
class Kind:
    """fold: (value, order) to a state, as an aggregate; merge: states to a state, as an aggregate; value: a state to what users see, by mode.

    roll_up: merge() for a query, with the view's key; by_register: the modes in which states are built by further grouping (functions.hll).
    """

    fold: Callable[[Column, Sequence[Column]], Column]
    merge: Callable[[Column], Column]
    value: Callable[[Column, str], Column]
    roll_up: Callable[[Column, Sequence[Column]], Column] | None = None
    by_register: tuple[str, ...] = ()


def _gauge(value: Column, order: Sequence[Column]) -> Column:
    ord_ = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))) if order else F.struct(value.alias("o0"))
    return F.max(F.when(value.isNotNull(), F.struct(ord_.alias("ord"), value.alias("value"))))


def _gauge_by_key(state: Column, view_key: Sequence[Column]) -> Column:
    key = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(view_key)), F.lit(0).alias("end"))
    return F.max(F.when(state.isNotNull(), F.struct(key.alias("ord"), state["value"].alias("value"))))


_SUM = Kind(lambda value, order: F.sum(value), F.sum, lambda state, mode: F.coalesce(state, F.lit(0).cast("bigint")))

KINDS: dict[MetricType, Kind] = {
    MetricType.VARINT_SUM: _SUM,
    MetricType.FLOAT_SUM: replace(_SUM, value=lambda state, mode: F.coalesce(state, F.lit(0.0))),
    MetricType.VARINT_GAUGE: Kind(_gauge, F.max, lambda state, mode: F.coalesce(state["value"], F.lit(0).cast("bigint")), _gauge_by_key),
    MetricType.STRING_HLL: Kind(
        lambda value, order: hll.sketch_partial(value),
        hll.sketch_merge,
        lambda state, mode: hll.exact_estimate(state) if mode == EXACT else hll.sketch_estimate(state),
        by_register=(EXACT,),
    ),
}


def register(kind: MetricType, what: Kind) -> Kind:
    """Makes `what` the meaning of a metric type, for all sessions of this process; returns what it was before."""
    before, KINDS[kind] = KINDS[kind], what
    return before


def grouped_by_register(kind: MetricType, mode: str) -> bool:
    return mode in KINDS[kind].by_register


def partial(kind: MetricType, value: Column, order: Sequence[Column]) -> Column:
    """The state of a group of rows."""
    return KINDS[kind].fold(value, order)


def merge(kind: MetricType, state: Column) -> Column:
    """The state of a group of states."""
    return KINDS[kind].merge(state)


def roll_up(kind: MetricType, state: Column, view_key: Sequence[Column]) -> Column:
    """merge() for a query: a gauge takes the value of the row with the greatest view key."""
    rule = KINDS[kind].roll_up
    return rule(state, view_key) if rule else merge(kind, state)


def flatten(kind: MetricType, state: Column, mode: str = SKETCH) -> Column:
    """The value that users see."""
    return KINDS[kind].value(state, mode)
