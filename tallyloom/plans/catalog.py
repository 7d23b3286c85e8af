"""The schema catalog: revisions of a schema under a folder, updated by compare-and-swap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from tallyloom.plans import files
from tallyloom.schema import Extractors, Schema, validate_transition
from tallyloom.types import SchemaSpec, ValidationError, dump, load


class RevisionMismatch(RuntimeError):
    pass


@dataclass(frozen=True)
class Config:
    """root: where a deployment keeps its catalog and views; instance: its name, which updates must state."""

    root: str
    instance: str
    max_rows: int | None = None
    sketches: str = "sketch"

    def __post_init__(self):
        for name in ("root", "instance"):
            if not getattr(self, name):
                raise ValidationError(f"{name} is required", "Config")
        if self.max_rows is not None and self.max_rows < 1:
            raise ValidationError("max_rows must be >= 1", "Config")
        if self.sketches not in ("sketch", "exact"):
            raise ValidationError("sketches must be sketch or exact", "Config")


class Catalog:
    def __init__(self, spark: SparkSession, config: Config, extractors: Extractors | None = None):
        self.config, self.extractors = config, extractors
        self._versions = files.Versions(spark, f"{config.root.rstrip('/')}/catalog")

    def get(self) -> tuple[int, SchemaSpec]:
        """(revision, specification); revision 0 and an empty one if nothing was ever put."""
        revision, found = self._versions.read()
        return revision, load(SchemaSpec, found)

    def schema(self) -> Schema:
        return Schema(self.get()[1], self.extractors)

    def update(self, spec: SchemaSpec, instance: str, revision: int) -> int:
        """Puts spec in place of the given revision and returns the new one."""
        if self.extractors is None:
            raise ValidationError("a schema is updated where its extractors are registered")
        if instance != self.config.instance:
            raise ValidationError(f"instance mismatch ({instance}; expected {self.config.instance})")
        new = Schema(spec, self.extractors)
        current, old = self.get()
        if current != revision:
            raise RevisionMismatch(f"revision is {current}, not {revision}")
        validate_transition(Schema(old), new)
        try:
            return self._versions.commit(revision, dump(spec))
        except files.AlreadyThere:
            raise RevisionMismatch(f"revision is no longer {revision}") from None
