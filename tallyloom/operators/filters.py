"""Inclusive range filters: checking them once, and turning them into predicates that reach the Parquet scan."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.types import DimensionType, Filter, ValidationError

#: An inclusive range; None is an open side.
Range = tuple[Any, Any]

_FIELD = {DimensionType.VARINT: "ints", DimensionType.FLOAT: "floats", DimensionType.STRING: "strings", DimensionType.TIMESTAMP: "times"}
#: Values that stand for an open side, besides None.
_OPEN = {DimensionType.VARINT: (0,), DimensionType.FLOAT: (0.0,), DimensionType.STRING: ("",), DimensionType.TIMESTAMP: (dt.datetime(1, 1, 1, tzinfo=dt.timezone.utc),)}


def ranges_of(filter_: Filter, kind: DimensionType, now: dt.datetime) -> list[Range]:
    """The ranges of a filter over a dimension of this type, checked; relative times are taken from now."""
    items = getattr(filter_, _FIELD[kind])
    if not items:
        raise ValidationError(f"expected {_FIELD[kind].capitalize()}")
    bound = lambda x: None if x is None or x in _OPEN[kind] else x
    out: list[Range] = []
    for x in items:
        begin, end = bound(x.begin), bound(x.end)
        if kind is DimensionType.TIMESTAMP:
            begin = now + x.relative_begin if begin is None and x.relative_begin else begin
            end = now + x.relative_end if end is None and x.relative_end else end
        # Each range lies wholly after the one before, so only the first is open below and only the last above.
        if begin is not None and end is not None and begin > end or out and (out[-1][1] is None or begin is None or out[-1][1] >= begin):
            raise ValidationError("invalid range order")
        out.append((begin, end))
    return out


def in_range(column: Column, kind: DimensionType, bounds: Range) -> Column | None:
    """NaN is less than any number, so it is inside a range that is open below; None if every value is inside."""
    begin, end = (None if x is None else F.lit(x) for x in bounds)
    if begin is None and end is None:
        return None
    if kind is DimensionType.FLOAT:
        if begin is None:
            return (column <= end) | F.isnan(column)
        inside = (column >= begin) & ~F.isnan(column)
        return inside if end is None else inside & (column <= end)
    tests = [*([] if begin is None else [column >= begin]), *([] if end is None else [column <= end])]
    return reduce(and_, tests)


def predicate(column: Column, kind: DimensionType, ranges: list[Range]) -> Column | None:
    tests = [in_range(column, kind, r) for r in ranges]
    return None if any(t is None for t in tests) or not tests else reduce(or_, tests)


def sort_keys(column: Column, kind: DimensionType) -> list[Column]:
    """Ascending order: strings by bytes, NaN below all numbers."""
    return [(~F.isnan(column)).asc(), column.asc()] if kind is DimensionType.FLOAT else [column.asc()]
