"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without [\\x20\\x09-\\x0D] at its ends, A-Z lower-cased. Keys are kept as 128-bit hashes with the number
of documents that hold them. The store is a log-structured merge tree: each batch of documents merge-anti-joins the keys that
the runs have already settled (found in min_docs documents), and adds what is left as a new sorted run at level 0; fanout runs
of one level are compacted into one run of the next.

Nulls: a null text is one empty line. Each row counts as a document, so repeated rows count as often as they occur; null ids
are ids like any other. Keys shorter than min_chars never count. Other columns pass through, whatever their names; the new
columns come after them and replace any of the same name.

Only DataFrame functions are used. A hot line is counted by partial sums. The frequent keys are counted: up to `bound` they are broadcast to the
documents' lines; more of them meet the lines in a shuffle join, each in SALTS places, so that the marks of one line are spread over as many
tasks. Both give the same. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import WS, ascii_lower, digest, drop, fresh, let, remove, save, small

KEY = ["h1", "h2"]
SALTS = 32


def lines(text):
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line):
    return ascii_lower(F.btrim(line, F.lit(WS)))


def line_keys(docs: DataFrame, text_col: str = "text", min_chars: int = 1, batches: int = 1) -> DataFrame:
    """(batch, h1, h2, n): in how many documents of a batch each key is found."""
    keys = F.array_distinct(F.transform(lines(F.col(text_col)), line_key))
    each = docs.select(F.pmod(F.xxhash64(F.col(text_col)), F.lit(batches)).cast("int").alias("batch"), F.explode(keys).alias("key")).where(F.length("key") >= min_chars)
    h1, h2 = digest(F.col("key"))
    return each.select("batch", h1.alias("h1"), h2.alias("h2")).groupBy("batch", *KEY).agg(F.count("*").alias("n"))


class LineRuns:
    """Levelled sorted runs (h1, h2, n) in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4):
        self.spark, self.min_docs, self.fanout, self.levels = spark, min_docs, fanout, []

    def read(self) -> DataFrame | None:
        runs = [x for level in self.levels for x in level]
        return self.spark.read.schema("h1 long, h2 long, n long").parquet(*runs) if runs else None

    def totals(self, runs: DataFrame) -> DataFrame:
        return runs.groupBy(*KEY).agg(F.sum("n").alias("n"))

    def settled(self) -> DataFrame | None:
        """Keys found in min_docs documents or more so far."""
        return None if (runs := self.read()) is None else self.totals(runs).where(F.col("n") >= self.min_docs).select(*KEY)

    def _write(self, level: int, run: DataFrame) -> None:
        path = fresh(self.spark, f"lines-l{level}")
        run.select(*KEY, "n").sortWithinPartitions(*KEY).write.parquet(path)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(level + 1, self.totals(self.spark.read.schema("h1 long, h2 long, n long").parquet(*old)))
            for x in old:
                remove(self.spark, x)

    def add(self, batch: DataFrame) -> None:
        """batch(h1, h2, n): adds what the runs have not settled, as a sorted run."""
        if (known := self.settled()) is not None:
            batch = batch.hint("merge").join(known.hint("merge"), KEY, "left_anti")
        self._write(0, batch)


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 3, fanout: int = 3, text_col: str = "text") -> DataFrame:
    """(h1, h2) of each key found in min_docs documents or more. The texts are read once; batches are read from their keys."""
    keys = save(line_keys(docs, text_col, min_chars, batches), "line-keys", "batch")
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    for i in range(batches):
        runs.add(keys.where(F.col("batch") == i).select(*KEY, "n"))
    drop(keys)
    return runs.settled()


def _frequent_only(found: DataFrame, frequent: DataFrame, bound: int) -> DataFrame:
    """found(t1, ..., h1, h2): the rows whose key is frequent."""
    known = small(frequent, bound)
    if known is not frequent:
        return found.join(known, KEY, "left_semi")
    salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.withColumn("salt", F.pmod(F.xxhash64("t1", "t2"), F.lit(SALTS)).cast("int")).join(salted, [*KEY, "salt"], "left_semi")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 3, fanout: int = 3, text_col: str = "text", bound: int = 500_000) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text added as the last three columns: frequent lines lose all their occurrences."""
    frequent = save(frequent_lines(docs, min_docs, min_chars, batches, fanout, text_col), "frequent-lines")
    # Which lines go depends on the text alone: equal texts share a row of marks.
    t1, t2 = digest(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    found = docs.select(t1.alias("t1"), t2.alias("t2"), F.posexplode(lines(F.col(text_col))).alias("at", "line"))
    h1, h2 = digest(line_key(F.col("line")))
    marks = _frequent_only(found.where(F.length(line_key(F.col("line"))) >= min_chars).select("t1", "t2", F.col("at") + 1, h1, h2).toDF("t1", "t2", "at", *KEY), frequent, bound)
    marks = marks.groupBy("t1", "t2").agg(F.sort_array(F.collect_set("at")).alias("gone"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept_text"))).alias("row"), t1.alias("t1"), t2.alias("t2"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(marks, ["t1", "t2"], "left")
    gone = F.coalesce("gone", F.expr("array()").cast("array<int>"))

    def keep(parts):
        stretches = F.zip_with(F.concat(F.array(F.lit(0)), gone), F.concat(gone, F.array(F.size(parts) + 1)), lambda a, b: F.slice(parts, a + 1, b - a - 1))
        return F.struct(F.size(parts).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), F.concat_ws("\n", F.flatten(stretches)).alias("kept_text"))

    return rows.select("row", F.when(F.size(gone) == 0, F.struct(F.size(lines(F.col("text"))).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept_text"))).otherwise(let(lines(F.col("text")), keep)).alias("new")).select("row.*", "new.*")
