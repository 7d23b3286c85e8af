"""From source rows to partial aggregates of a view: mapping, dimension extraction, grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import metrics
from tallyloom.operators.aggregate import dim, fold, met
from tallyloom.schema import Schema
from tallyloom.types import MaterializedViewSpec, RelationSpec


def column(x: Column | str) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def mapped(schema: Schema, relation: RelationSpec, source: DataFrame) -> DataFrame:
    """The relation's rows, of any columns: what the source decodes to, mapped."""
    ext = schema.extractors
    return ext.mappings[schema.tags["mapping"][relation.mapping]](ext.new_source(source))


def order_columns(schema: Schema, relation: RelationSpec) -> list[Column]:
    return [column(c) for c in schema.extractors.order_by.get(schema.tags["mapping"][relation.mapping], [])]


def extracted(schema: Schema, view: MaterializedViewSpec, rows: DataFrame) -> DataFrame:
    """View dimensions as d<tag>, what metrics are computed from as s<tag>, gauge order as o<i>: typed, and nothing else."""
    specs = [schema.dimension(n) for n in view.view.dimensions]
    sources = {schema.metric(n).dimension: schema.dimension(schema.metric(n).dimension) for n in view.view.metrics}
    ext = schema.extractors

    def typed(spec) -> Column:
        return column(ext.of(spec.type)[spec.tag]).cast(spec.type.sql)

    order = order_columns(schema, schema.relation(view.relation))
    return rows.select(*(typed(s).alias(dim(s.tag)) for s in specs), *(typed(s).alias(f"s{s.tag}") for s in sources.values()), *(c.alias(f"o{i}") for i, c in enumerate(order)))


def partials(schema: Schema, view: MaterializedViewSpec, source: DataFrame, mode: str = metrics.SKETCH, is_mapped: bool = False) -> DataFrame:
    """One row of states (m<tag>) for each combination of the view's dimensions (d<tag>) in source."""
    relation = schema.relation(view.relation)
    rows = extracted(schema, view, source if is_mapped else mapped(schema, relation, source))
    order = [F.col(f"o{i}") for i in range(len(order_columns(schema, relation)))]
    specs = [schema.metric(n) for n in view.view.metrics]
    keys = [dim(schema.dimension(n).tag) for n in view.view.dimensions]
    items = [(met(s.tag), s.type, f"s{schema.dimension(s.dimension).tag}") for s in specs]
    return fold(rows, keys, items, order, mode)
