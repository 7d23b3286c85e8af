"""Tab-separated text: numbered author and quote lines in, query results out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_quotes(spark: SparkSession, path: str, begin: int = 0, end: int | None = None) -> DataFrame:
    """Lines author TAB text as (id, author, text); id is the line's number in its file, from 0, and [begin, end) are the ids wanted.

    Lines are numbered from the offsets that Spark's reader gives them, by counting lines per stretch of a file and summing stretches, so no
    file has to be read by one task. Lines without a tab are numbered but give no row.
    """
    lines = spark.read.option("wholetext", False).text(path).select("value", F.monotonically_increasing_id().alias("at"))
    # The upper bits of at are the partition, the lower ones count within it; partitions of one file follow its order.
    parts = lines.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).collect()  # one row a partition
    before, total = {}, 0
    for r in sorted(parts, key=lambda r: r["part"]):
        before[r["part"]] = total
        total += r["n"]
    starts = spark.createDataFrame(sorted(before.items()) or [(0, 0)], "part bigint, before bigint")
    numbered = lines.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(starts), "part")
    numbered = numbered.select((F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("id"), F.split("value", "\t", 2).alias("f"))
    wanted = (F.col("id") >= begin) & (F.col("id") < end) if end is not None else F.col("id") >= begin
    return numbered.where(wanted & (F.size("f") == 2)).select("id", F.col("f")[0].alias("author"), F.col("f")[1].alias("text"))


def cell(value: object) -> str:
    """How a value is printed: whole numbers plainly, floating-point ones in their shortest form, times in UTC."""
    if isinstance(value, float):
        text = repr(value)
        return text.removesuffix(".0") if "e" not in text else text
    if hasattr(value, "strftime"):
        return f"{value:%Y-%m-%d %H:%M:%S}{f'.{value.microsecond:06d}'.rstrip('0') if value.microsecond else ''} +0000 UTC"
    return "" if value is None else str(value)


def rows_as_tsv(result: DataFrame) -> Iterator[str]:
    """Lines without a header, partition by partition: the driver never holds the whole result."""
    for row in result.toLocalIterator():
        yield "\t".join(map(cell, row))


def write_tsv(result: DataFrame, path: str) -> None:
    """The result as part files of a folder; in order if the result is."""
    text = [F.col(f"`{f.name}`").cast("string") if not isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in result.schema.fields]
    result.select(F.concat_ws("\t", *(F.coalesce(c, F.lit("")) for c in text)).alias("value")).write.text(path)
