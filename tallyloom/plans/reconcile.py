"""Which streams a schema asks for: one for every view and every source that its relation selects."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from tallyloom.schema import Schema
from tallyloom.sources.registry import Sources


@dataclass(frozen=True, order=True)
class Stream:
    id: str
    view: int
    source: str


@dataclass(frozen=True)
class Changes:
    start: tuple[Stream, ...]
    stop: tuple[Stream, ...]
    keep: tuple[Stream, ...]

    def __str__(self) -> str:
        sign = (("+", self.start), ("-", self.stop), ("=", self.keep))
        return "".join(f"{s} {x.id} view={x.view} source={x.source}\n" for s, items in sign for x in items)


def stream_id(instance: str, view: int, source: str) -> str:
    """The same for the same view and source, whoever computes it."""
    return hashlib.sha1(f"{instance}:{view}:{source}".encode()).hexdigest()[:24]


def wanted(schema: Schema, sources: Sources, instance: str) -> list[Stream]:
    return sorted(Stream(stream_id(instance, tag, s.name), tag, s.name) for tag, view in schema.views.items() for s in sources.select(schema.relation(view.relation).selector))


def reconcile(schema: Schema, sources: Sources, instance: str, running: list[Stream]) -> Changes:
    want, have = set(wanted(schema, sources, instance)), set(running)
    return Changes(tuple(sorted(want - have)), tuple(sorted(have - want)), tuple(sorted(want & have)))
