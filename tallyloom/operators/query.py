"""Queries: resolving names against a schema, and the one plan that answers them.

scan of the view's state -> range predicates -> group by the query's dimensions and merge states -> values -> order by dimensions.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import metrics
from tallyloom.operators.aggregate import dim, fold, merge, met, roll_up
from tallyloom.operators.extract import extracted, mapped
from tallyloom.operators.filters import Range, predicate, ranges_of, sort_keys
from tallyloom.schema import Schema
from tallyloom.types import MetricType, QuerySpec, ValidationError


class ResultTooLarge(RuntimeError):
    pass


@dataclass(frozen=True)
class ResolvedQuery:
    """A query by tags, with the time that relative ranges refer to already in them."""

    view: int
    dimensions: tuple[int, ...]
    metrics: tuple[int, ...]
    filters: tuple[tuple[int, tuple[Range, ...]], ...] = ()


def _listed(schema: Schema, kind: str, names: list[str], inside: list[str]) -> tuple[int, ...]:
    what = kind.capitalize()
    look = getattr(schema, kind)
    tags = []
    for i, name in enumerate(names):
        try:
            tags.append(look(name).tag)
        except ValidationError as e:
            raise e.within(f"{what}s[{i}]").within("View") from None
    for i, name in enumerate(names):
        wrong = f"not part of MaterializedView ({name})" if name not in inside else f"duplicated {what} ({name})" if name in names[:i] else ""
        if wrong:
            raise ValidationError(wrong, "View", f"{what}s[{i}]")
    return tuple(tags)


def resolve(schema: Schema, spec: QuerySpec, now: dt.datetime | None = None) -> ResolvedQuery:
    """spec by tags; raises ValidationError for what the schema does not have, or the view, or for ranges out of order."""
    now = now or dt.datetime.now(dt.timezone.utc)
    view = schema.view(spec.materialized_view)
    dims = _listed(schema, "dimension", spec.view.dimensions, view.view.dimensions)
    mets = _listed(schema, "metric", spec.view.metrics, view.view.metrics)
    seen, filters = set(), []
    for i, f in enumerate(spec.filters):
        try:
            d = schema.dimension(f.dimension)
            if f.dimension not in view.view.dimensions:
                raise ValidationError(f"Dimension is not part of MaterializedView ({f.dimension})")
            if f.dimension in seen:
                raise ValidationError(f"duplicated Dimension ({f.dimension})")
            filters.append((d.tag, tuple(ranges_of(f, d.type, now))))
        except ValidationError as e:
            raise e.within(f"Filters[{i}]") from None
        seen.add(f.dimension)
    return ResolvedQuery(view.tag, dims, mets, tuple(filters))


def check_tags(schema: Schema, query: ResolvedQuery) -> None:
    """A resolved query may come from elsewhere, or from an older schema."""
    if query.view not in schema.views:
        raise ValidationError(f"MvTag not found ({query.view})")
    view = schema.views[query.view].view
    dims = {schema.dimension(n).tag for n in view.dimensions}
    mets = {schema.metric(n).tag for n in view.metrics}
    for tag in (*query.dimensions, *(t for t, _ in query.filters)):
        if tag not in dims:
            raise ValidationError(f"DimTag not part of MaterializedView ({tag})")
    for tag in query.metrics:
        if tag not in mets:
            raise ValidationError(f"MetTag not part of MaterializedView ({tag})")


def execute(schema: Schema, query: ResolvedQuery, state: DataFrame, mode: str = metrics.SKETCH, merged: bool = False, max_rows: int | None = None) -> DataFrame:
    """state: the view's rows of states, of which several may share a key unless merged. Returns dimensions, then metrics, by name, ordered by dimensions.

    A query without dimensions has one row, or none if nothing matched. Without metrics, rows are distinct. max_rows raises
    ResultTooLarge for a result that has more: the query runs once, to at most one row more than that, and those rows are what is returned.
    """
    check_tags(schema, query)
    view_dims = [schema.dimension(n) for n in schema.views[query.view].view.dimensions]
    specs = [schema.metrics[t] for t in query.metrics]
    for tag, ranges in query.filters:
        if (test := predicate(F.col(dim(tag)), schema.dimensions[tag].type, list(ranges))) is not None:
            state = state.where(test)
    keys, view_key = [dim(t) for t in query.dimensions], [dim(d.tag) for d in view_dims]
    items = [(met(s.tag), s.type, met(s.tag)) for s in specs]
    gauges = any(s.type is MetricType.VARINT_GAUGE for s in specs)
    if gauges and not merged:
        # A gauge's last value by ingestion comes before its last value by key.
        state = merge(state, view_key, items, mode)
    if not (merged and keys == [c for c in state.columns if c.startswith("d")]):
        state = roll_up(state.select(*dict.fromkeys([*(view_key if gauges else keys), *(i[0] for i in items)])), keys, items, view_key, mode)
    out = state.select(*(F.col(dim(t)).alias(schema.dimensions[t].name) for t in query.dimensions), *(metrics.flatten(s.type, F.col(met(s.tag)), mode).alias(s.name) for s in specs))
    if max_rows is not None:
        out = out.limit(max_rows + 1).persist()
        if out.count() > max_rows:
            out.unpersist()
            raise ResultTooLarge("result set is too large for buffering")
    order = [k for t in query.dimensions for k in sort_keys(F.col(f"`{schema.dimensions[t].name}`"), schema.dimensions[t].type)]
    return out.orderBy(*order) if order else out


def over_rows(schema: Schema, query: ResolvedQuery, source: DataFrame, mode: str = metrics.SKETCH) -> DataFrame:
    """execute() straight from a relation's source, without stored state: filters come before grouping, and only the query's
    dimensions are grouped by (gauges need the view's first, for their last value by key), so there is one shuffle before the final sort."""
    check_tags(schema, query)
    view = schema.views[query.view]
    names = {d.tag: d.name for d in map(schema.dimension, view.view.dimensions)}
    specs = [schema.metrics[t] for t in query.metrics]
    gauges = any(s.type is MetricType.VARINT_GAUGE for s in specs)
    rows = extracted(schema, view, mapped(schema, schema.relation(view.relation), source))
    for tag, ranges in query.filters:
        if (test := predicate(F.col(dim(tag)), schema.dimensions[tag].type, list(ranges))) is not None:
            rows = rows.where(test)
    order = [F.col(c) for c in rows.columns if c.startswith("o")]
    keys = [dim(t) for t in (names if gauges else query.dimensions)]
    items = [(met(s.tag), s.type, f"s{schema.dimension(s.dimension).tag}") for s in specs]
    return execute(schema, ResolvedQuery(query.view, query.dimensions, query.metrics), fold(rows, keys, items, order, mode), mode, merged=True)
