"""What the operators share: the shared folder, materialised steps, worker path and small column helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name: space and \t \n \v \f \r.
WS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all run on this machine (tests, local runs)."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: executors would not see each other's tables")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tallyloom-"))
    return f"file://{_own[0]}"


def fresh(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def save(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    path = fresh(spark := df.sparkSession, tag)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table that save() wrote, once nothing reads it any more."""
    remove(df.sparkSession, df._saved_at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ready(spark: SparkSession) -> SparkSession:
    """Lets local Python workers import this package from wherever the driver did, and bounds an Arrow batch to 1,000 rows: whole texts are long. The bound stays with the session, whose plans run after this returns."""
    home, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")) if x)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, nothing else; lower() does the same, only faster, where all code points are ASCII."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def digest(c: Column) -> tuple[Column, Column]:
    """128 bits of a string as two longs."""
    return F.xxhash64(c), F.xxhash64(F.lit("second"), c)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df, marked for broadcast if it is counted to have at most so many rows; a larger one is joined by a shuffle. For saved tables of a few numbers a row."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
