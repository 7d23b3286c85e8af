"""Building, checking and evolving schemas."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame

from tallyloom.types import DimensionSpec, DimensionType, MappingSpec, MaterializedViewSpec, MetricSpec, MetricType, RelationSpec, SchemaSpec, ValidationError

_TOKEN = re.compile(r"[\w\-+/.~!%&*'`^|#$]+", re.ASCII)
_LENGTH = (2, 128)
_MIN_RETENTION = dt.timedelta(minutes=1)


@dataclass
class Extractors:
    """Functions that users register by tag.

    new_source gives a source's DataFrame its columns (decoding, say); a mapping turns that into a DataFrame of rows; a dimension's extractor
    is a Column over those rows. order_by lists, for a mapping, the Columns by whose order a gauge's last value is known.
    """

    new_source: Callable[[DataFrame], DataFrame] | None = None
    mappings: dict[int, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    ints: dict[int, Column | str] = field(default_factory=dict)
    floats: dict[int, Column | str] = field(default_factory=dict)
    strings: dict[int, Column | str] = field(default_factory=dict)
    times: dict[int, Column | str] = field(default_factory=dict)
    order_by: dict[int, list[Column | str]] = field(default_factory=dict)

    def of(self, kind: DimensionType) -> dict[int, Column | str]:
        return {DimensionType.VARINT: self.ints, DimensionType.FLOAT: self.floats, DimensionType.STRING: self.strings, DimensionType.TIMESTAMP: self.times}[kind]


def _fail(message: str, *path: str):
    raise ValidationError(message, *path)


def check_token(name: str, at: str = "Name") -> None:
    if not _LENGTH[0] <= len(name) <= _LENGTH[1]:
        _fail(f"invalid length ({len(name)}; expected {_LENGTH[0]} <= length <= {_LENGTH[1]})", at)
    if not _TOKEN.fullmatch(name):
        _fail(f"not a valid token ({name})", at)


def _each(kind: str, items: Iterable, check: Callable) -> None:
    for i, x in enumerate(items):
        try:
            check(x)
        except ValidationError as e:
            raise e.within(f"{kind}[{i}]") from None


class Schema:
    """A checked specification, indexed by tag and by name, with the extractors that go with it, if there are any."""

    def __init__(self, spec: SchemaSpec, extractors: Extractors | None = None):
        if extractors is not None and extractors.new_source is None:
            _fail("NewMessage not defined", "ExtractFns")
        self.spec, self.extractors = spec, extractors
        self.mappings: dict[int, MappingSpec] = {}
        self.dimensions: dict[int, DimensionSpec] = {0: DimensionSpec(type=DimensionType.VARINT)}
        self.metrics: dict[int, MetricSpec] = {}
        self.relations: dict[int, RelationSpec] = {}
        self.views: dict[int, MaterializedViewSpec] = {}
        self.reserved: set[int] = set()
        self.tags: dict[str, dict[str, int]] = {k: {} for k in ("mapping", "dimension", "metric", "relation", "view")}
        self._names: set[str] = set()
        for kind, items, check in (
            ("Mappings", spec.mappings, self._mapping),
            ("Dimensions", spec.dimensions, self._dimension),
            ("Metrics", spec.metrics, self._metric),
            ("Relations", spec.relations, self._relation),
            ("ReservedViewTags", spec.reserved_view_tags, self._reserved),
            ("Views", spec.views, self._view),
        ):
            _each(kind, items, check)

    # Lookups by name.

    def dimension(self, name: str) -> DimensionSpec:
        if (tag := self.tags["dimension"].get(name)) is None:
            _fail(f"no such Dimension ({name})")
        return self.dimensions[tag]

    def metric(self, name: str) -> MetricSpec:
        if (tag := self.tags["metric"].get(name)) is None:
            _fail(f"no such Metric ({name})")
        return self.metrics[tag]

    def relation(self, name: str) -> RelationSpec:
        if (tag := self.tags["relation"].get(name)) is None:
            _fail(f"no such Relation ({name})")
        return self.relations[tag]

    def view(self, name: str) -> MaterializedViewSpec:
        if (tag := self.tags["view"].get(name)) is None:
            _fail(f"no such MaterializedView ({name})")
        return self.views[tag]

    # Rules, in the order in which they are tried.

    def _named(self, spec) -> None:
        check_token(spec.name)
        if spec.name in self._names:
            _fail(f"duplicated Name ({spec.name})")

    def _add(self, spec, kind: str, index: dict) -> None:
        self._names.add(spec.name)
        index[spec.tag] = spec
        self.tags[kind][spec.name] = spec.tag

    def _mapping(self, spec: MappingSpec) -> None:
        self._named(spec)
        if spec.tag in self.mappings:
            _fail(f"MapTag already specified ({spec.tag})")
        if self.extractors is not None and spec.tag not in self.extractors.mappings:
            _fail(f"extractor not registered ({spec.tag})")
        self._add(spec, "mapping", self.mappings)

    def _dimension(self, spec: DimensionSpec) -> None:
        self._named(spec)
        if spec.tag in self.dimensions:
            _fail(f"DimTag already specified ({spec.tag})")
        if spec.type is DimensionType.INVALID_DIM_TYPE:
            _fail(f"invalid DimensionType ({spec.type.name})")
        if self.extractors is not None and spec.tag not in self.extractors.of(spec.type):
            _fail(f"extractor not registered ({spec.tag}; type {spec.type.name})")
        self._add(spec, "dimension", self.dimensions)

    def _metric(self, spec: MetricSpec) -> None:
        self._named(spec)
        if spec.tag in self.metrics:
            _fail(f"MetTag already specified ({spec.tag})")
        dim = self.dimension(spec.dimension)
        if spec.type is MetricType.INVALID_METRIC_TYPE:
            _fail(f"invalid MetricType ({spec.type.name})")
        if dim.type is not spec.type.over:
            _fail(f"Metric Type mismatch ({dim.name} has type {dim.type.name}; expected {spec.type.over.name})")
        self._add(spec, "metric", self.metrics)

    def _dimensions(self, names: list[str], inside: list[str] | None = None) -> None:
        seen = set()
        for i, name in enumerate(names):
            try:
                self.dimension(name)
                if inside is not None and name not in inside:
                    _fail(f"not part of Relation ({name})")
                if name in seen:
                    _fail(f"duplicated Dimension ({name})")
            except ValidationError as e:
                raise e.within(f"Dimensions[{i}]") from None
            seen.add(name)

    def _relation(self, spec: RelationSpec) -> None:
        self._named(spec)
        if spec.tag in self.relations:
            _fail(f"RelTag already specified ({spec.tag})")
        for side, labels in (("Include", spec.selector.include.labels), ("Exclude", spec.selector.exclude.labels)):
            for i, x in enumerate(labels):
                check_token(x.name, f"Selector.{side}.Labels[{i}].Name")
        if spec.mapping not in self.tags["mapping"]:
            _fail(f"no such Mapping ({spec.mapping})")
        self._dimensions(spec.dimensions)
        self._add(spec, "relation", self.relations)

    def _reserved(self, spec) -> None:
        if spec.tag in self.reserved:
            _fail(f"MVTag already reserved ({spec.tag})")
        self.reserved.add(spec.tag)

    def _view(self, spec: MaterializedViewSpec) -> None:
        self._named(spec)
        if spec.tag in self.views:
            _fail(f"MVTag already specified ({spec.tag})")
        if spec.tag in self.reserved:
            _fail(f"MVTag reserved ({spec.tag})")
        relation = self.relation(spec.relation)
        for i, name in enumerate(spec.view.dimensions):
            if name not in self.tags["dimension"]:
                _fail(f"no such Dimension ({name})", f"Dimensions[{i}]")
        for i, name in enumerate(spec.view.metrics):
            if name not in self.tags["metric"]:
                _fail(f"no such Metric ({name})", f"Metrics[{i}]")
        self._dimensions(spec.view.dimensions, relation.dimensions)
        if spec.retention is not None:
            self._retention(spec)
        seen = set()
        for i, name in enumerate(spec.view.metrics):
            if (dim := self.metric(name).dimension) not in relation.dimensions:
                _fail(f"Dimension not part of Relation ({dim}; metric {name})", f"Metrics[{i}]")
            if name in seen:
                _fail(f"duplicated Metric ({name})", f"Metrics[{i}]")
            seen.add(name)
        self._add(spec, "view", self.views)

    def _retention(self, spec: MaterializedViewSpec) -> None:
        keep, name = spec.retention, spec.retention.relative_to
        if keep.remove_after < _MIN_RETENTION:
            _fail(f"invalid RemoveAfter ({keep.remove_after.total_seconds():g}s; expected >= 1m)", "Retention")
        if name not in self.tags["dimension"]:
            _fail(f"no such Dimension ({name})", "Retention", "RelativeTo")
        if name not in spec.view.dimensions:
            _fail(f"not a View Dimension ({name})", "Retention", "RelativeTo")
        if (kind := self.dimension(name).type) is not DimensionType.TIMESTAMP:
            _fail(f"mismatched Type ({kind.name}; expected TIMESTAMP)", "Retention", "RelativeTo")


def validate_transition(old: Schema, new: Schema) -> None:
    """Raises if new changes what old has fixed, by tag: types, a metric's dimension, a relation's mapping, a view's dimensions and metrics.

    Adding, removing and renaming are free, and so are descriptions, selectors, retention and a relation's dimensions.
    """

    def view(schema: Schema, x: MaterializedViewSpec) -> tuple:
        return tuple(schema.tags["dimension"][n] for n in x.view.dimensions), tuple(schema.tags["metric"][n] for n in x.view.metrics)

    facts: dict[str, list[tuple[str, Callable[[Schema, Any], Any]]]] = {
        "dimensions": [("Type", lambda s, x: x.type.name)],
        "metrics": [("Type", lambda s, x: x.type.name), ("DimTag", lambda s, x: s.tags["dimension"][x.dimension])],
        "relations": [("MapTag", lambda s, x: s.tags["mapping"][x.mapping])],
        "views": [("View", view)],
    }
    for kind, rules in facts.items():
        was = getattr(old, kind)

        def check(now):
            if now.tag in was:
                for what, fact in rules:
                    if (a := fact(old, was[now.tag])) != (b := fact(new, now)):
                        _fail(f"cannot alter immutable {what} ({a} != {b})")

        _each(kind.capitalize(), getattr(new.spec, kind), check)
