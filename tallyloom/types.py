"""Specifications that users write (YAML, JSON or Python), as plain dataclasses.

A schema declares mappings, typed dimensions, mergeable metrics, relations and materialized views. Every entity has a
name, unique among all of them, and an immutable integer tag by which revisions of a schema are compared.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import enum
import re
import types as pytypes
import typing
from dataclasses import dataclass, field
from typing import Any

import yaml


class ValidationError(ValueError):
    """A rule that a specification or query breaks, with the path to the entity that breaks it."""

    def __init__(self, message: str, *path: str):
        super().__init__(".".join(path) + ": " + message if path else message)
        self.message, self.path = message, path

    def within(self, part: str) -> ValidationError:
        return ValidationError(self.message, part, *self.path)


class DimensionType(enum.Enum):
    INVALID_DIM_TYPE = 0
    VARINT = 1
    FLOAT = 3
    STRING = 4
    TIMESTAMP = 5

    @property
    def sql(self) -> str:
        """The Spark type of such a dimension."""
        return {"VARINT": "bigint", "FLOAT": "double", "STRING": "string", "TIMESTAMP": "timestamp"}[self.name]


class MetricType(enum.Enum):
    INVALID_METRIC_TYPE = 0
    VARINT_SUM = 1
    VARINT_GAUGE = 2
    STRING_HLL = 3
    FLOAT_SUM = 4

    @property
    def over(self) -> DimensionType:
        """The type of dimension that it is computed from."""
        return {"VARINT_SUM": DimensionType.VARINT, "VARINT_GAUGE": DimensionType.VARINT, "FLOAT_SUM": DimensionType.FLOAT, "STRING_HLL": DimensionType.STRING}[self.name]


@dataclass
class MappingSpec:
    name: str = ""
    desc: str = ""
    tag: int = 0


@dataclass
class DimensionSpec:
    name: str = ""
    type: DimensionType = DimensionType.INVALID_DIM_TYPE
    desc: str = ""
    tag: int = 0


@dataclass
class MetricSpec:
    name: str = ""
    dimension: str = ""
    type: MetricType = MetricType.INVALID_METRIC_TYPE
    desc: str = ""
    tag: int = 0


@dataclass
class Label:
    name: str = ""
    value: str = ""


@dataclass
class LabelSet:
    labels: list[Label] = field(default_factory=list)


@dataclass
class Selector:
    """Sources that have one of the values of every included label, and no excluded label. An empty value stands for any."""

    include: LabelSet = field(default_factory=LabelSet)
    exclude: LabelSet = field(default_factory=LabelSet)

    def matches(self, labels: dict[str, str]) -> bool:
        wanted: dict[str, set[str]] = {}
        for x in self.include.labels:
            wanted.setdefault(x.name, set()).add(x.value)
        inside = all(n in labels and ("" in values or labels[n] in values) for n, values in wanted.items())
        return inside and not any(x.name in labels and x.value in ("", labels[x.name]) for x in self.exclude.labels)


@dataclass
class RelationSpec:
    name: str = ""
    selector: Selector = field(default_factory=Selector)
    mapping: str = ""
    dimensions: list[str] = field(default_factory=list)
    desc: str = ""
    tag: int = 0


@dataclass
class ViewSpec:
    """Dimensions, in order, and metrics of a view or of a query."""

    dimensions: list[str] = field(default_factory=list)
    metrics: list[str] = field(default_factory=list)


@dataclass
class Retention:
    remove_after: dt.timedelta = dt.timedelta()
    relative_to: str = ""


@dataclass
class MaterializedViewSpec:
    name: str = ""
    relation: str = ""
    view: ViewSpec = field(default_factory=ViewSpec)
    desc: str = ""
    retention: Retention | None = None
    tag: int = 0


@dataclass
class ReservedTagSpec:
    tag: int = 0
    desc: str = ""


@dataclass
class SchemaSpec:
    mappings: list[MappingSpec] = field(default_factory=list)
    dimensions: list[DimensionSpec] = field(default_factory=list)
    metrics: list[MetricSpec] = field(default_factory=list)
    relations: list[RelationSpec] = field(default_factory=list)
    views: list[MaterializedViewSpec] = field(default_factory=list)
    reserved_view_tags: list[ReservedTagSpec] = field(default_factory=list)


@dataclass
class IntRange:
    begin: int | None = None
    end: int | None = None


@dataclass
class FloatRange:
    begin: float | None = None
    end: float | None = None


@dataclass
class StringRange:
    begin: str | None = None
    end: str | None = None


@dataclass
class TimeRange:
    begin: dt.datetime | None = None
    end: dt.datetime | None = None
    relative_begin: dt.timedelta | None = None
    relative_end: dt.timedelta | None = None


@dataclass
class Filter:
    """Inclusive ranges of one dimension. None stands for an open side, and so do 0, 0.0, "" and the zero time."""

    dimension: str = ""
    ints: list[IntRange] = field(default_factory=list)
    floats: list[FloatRange] = field(default_factory=list)
    strings: list[StringRange] = field(default_factory=list)
    times: list[TimeRange] = field(default_factory=list)


@dataclass
class QuerySpec:
    materialized_view: str = ""
    view: ViewSpec = field(default_factory=ViewSpec)
    filters: list[Filter] = field(default_factory=list)


_UNIT = {"ns": 1e-3, "us": 1, "µs": 1, "ms": 1e3, "s": 1e6, "m": 60e6, "h": 3600e6, "d": 86400e6}


def parse_duration(text: str | int | float | dt.timedelta) -> dt.timedelta:
    """'1h30m', '-41s', '250ms'; a plain number is nanoseconds."""
    if isinstance(text, dt.timedelta):
        return text
    if isinstance(text, (int, float)):
        return dt.timedelta(microseconds=text / 1000)
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h|d)", text)
    sign = -1 if text.startswith("-") else 1
    if "".join(a + b for a, b in parts) != text.lstrip("+-"):
        raise ValidationError(f"not a duration ({text})")
    return sign * dt.timedelta(microseconds=sum(float(a) * _UNIT[b] for a, b in parts))


def _parse_time(value: Any) -> dt.datetime:
    if not isinstance(value, dt.datetime):
        value = dt.datetime.fromisoformat(str(value))
    return value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)


def _parse(kind: Any, value: Any, at: str) -> Any:
    args = typing.get_args(kind)
    if value is None:
        return None
    if isinstance(kind, pytypes.UnionType):
        return _parse(next(a for a in args if a is not type(None)), value, at)
    if typing.get_origin(kind) is list:
        if not isinstance(value, list):
            raise ValidationError("expected a list", at)
        return [_parse(args[0], x, f"{at}[{i}]") for i, x in enumerate(value)]
    if dataclasses.is_dataclass(kind):
        return load(kind, value, at)
    if isinstance(kind, type) and issubclass(kind, enum.Enum):
        names = [x.name for x in kind]
        if value not in names:
            raise ValidationError(f"{value!r} is not a valid {kind.__name__} (options are {names})", at)
        return kind[value]
    if kind is dt.timedelta:
        return parse_duration(value)
    if kind is dt.datetime:
        return _parse_time(value)
    if isinstance(value, bool) or not isinstance(value, (int, float) if kind is float else kind):
        raise ValidationError(f"expected {kind.__name__}, not {value!r}", at)
    return kind(value)


def load(kind: type, data: Any, at: str = "") -> Any:
    """A dataclass from parsed YAML or JSON; unknown fields are errors, absent and null ones have their defaults."""
    if data is None:
        return kind()
    if not isinstance(data, dict):
        raise ValidationError("expected a mapping", *([at] if at else []))
    hints, names = typing.get_type_hints(kind), {f.name for f in dataclasses.fields(kind)}
    if unknown := sorted(set(data) - names):
        raise ValidationError(f"unknown fields {unknown}", *([at] if at else []))
    return kind(**{k: _parse(hints[k], v, f"{at}.{k}".lstrip(".")) for k, v in data.items() if v is not None})


def loads(kind: type, text: str) -> Any:
    """load() of a YAML or JSON text (JSON is YAML)."""
    return load(kind, yaml.safe_load(text))


def dump(value: Any) -> Any:
    """The reverse of load(): plain data, without what is at its default."""
    if dataclasses.is_dataclass(value):
        blank = type(value)()
        return {f.name: dump(v) for f in dataclasses.fields(value) if (v := getattr(value, f.name)) != getattr(blank, f.name)}
    if isinstance(value, list):
        return [dump(x) for x in value]
    if isinstance(value, enum.Enum):
        return value.name
    if isinstance(value, dt.timedelta):
        return f"{'-' if value < dt.timedelta() else ''}{abs(value) // dt.timedelta(microseconds=1)}us"
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def dumps(value: Any) -> str:
    return yaml.safe_dump(dump(value), sort_keys=False, allow_unicode=True)
