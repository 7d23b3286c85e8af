"""Sources by name, with labels by which relations select them, each readable as a table and as a stream."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.plans.files import listing
from tallyloom.types import Selector, ValidationError

FORMATS = ("parquet", "orc", "json", "csv", "text", "avro")


@dataclass(frozen=True)
class Source:
    """A folder or file of rows. schema is DDL; it is required for streams and for formats without a schema of their own.

    Lines of JSON or CSV that do not parse are dropped and do not stop a read; rejected() has them.
    """

    name: str
    path: str
    format: str = "parquet"
    schema: str | None = None
    labels: dict[str, str] = field(default_factory=dict)
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.format not in FORMATS:
            raise ValidationError(f"unknown format {self.format} (options are {FORMATS})")

    def _reader(self, reader):
        reader = reader.format(self.format).options(**({"mode": "DROPMALFORMED"} if self.format in ("json", "csv") else {}) | self.options)
        return reader.schema(self.schema) if self.schema else reader

    def read(self, spark: SparkSession, paths: list[str] | None = None) -> DataFrame:
        """All of it, or only some of its files."""
        return self._reader(spark.read).load(paths if paths is not None else self.path)

    def rejected(self, spark: SparkSession, paths: list[str] | None = None) -> DataFrame:
        """(path, line): the lines that read() drops."""
        at = paths if paths is not None else self.path
        if self.format not in ("json", "csv") or not self.schema:
            return spark.createDataFrame([], "path string, line string")
        parse = F.from_json if self.format == "json" else F.from_csv
        plain = {k: v for k, v in self.options.items() if k not in ("mode", "maxFilesPerTrigger")} | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
        lines = spark.read.text(at).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
        return lines.where(F.trim("line") != "").where(parse("line", f"{self.schema}, _bad string", plain)["_bad"].isNotNull())

    def stream(self, spark: SparkSession, **options: str) -> DataFrame:
        schema = self.schema or spark.read.format(self.format).load(self.path).schema
        return self._reader(spark.readStream).schema(schema).options(**options).load(self.path)

    def files(self, spark: SparkSession) -> list[tuple[str, float, int]]:
        """(path, modification time, bytes) of each file."""
        return listing(spark, self.path)


class Sources:
    def __init__(self, *sources: Source):
        self._by_name = {s.name: s for s in sources}
        if len(self._by_name) < len(sources):
            raise ValidationError("source names must be unique")

    def __getitem__(self, name: str) -> Source:
        return self._by_name[name]

    def __iter__(self):
        return iter(self._by_name.values())

    def select(self, selector: Selector) -> list[Source]:
        return [s for s in self if selector.matches({"name": s.name} | s.labels)]
