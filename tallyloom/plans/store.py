"""The view store: each view's states as sorted runs of Parquet files under a versioned manifest.

<root>/<view tag>/runs/<id>/part-*.parquet   states (d<tag>, m<tag>), sorted by dimensions within files
<root>/<view tag>/pending/<id>               an empty file for each run that is being written, or written and not yet committed
<root>/<view tag>/manifest/<number>.json     runs by level, and the last epoch applied of each writer

A merge appends what an epoch has added as a run of level 0; when a level has `fanout` runs they are merged into one of the next,
laid out by ranges of the dimensions, so that filters prune files and row groups. So a state row is rewritten about log(batches)
times and not with every batch. Readers re-aggregate across runs, which is the same sum a query takes anyway.

The manifest is the one commit point, for data and epochs at once: an epoch that is not after the writer's last one changes nothing, which makes
replays harmless. A failed or lost attempt leaves at most unreferenced runs, which vacuum() deletes; those of a writer that is still at work are
marked as pending, and vacuum() spares them for `grace`. Manifests are created without overwriting, so of two concurrent writers one fails and
tries again from what the other has committed.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import metrics
from tallyloom.operators import aggregate, query
from tallyloom.operators.aggregate import dim, met
from tallyloom.operators.extract import order_columns, partials
from tallyloom.operators.query import ResolvedQuery, resolve
from tallyloom.plans import files
from tallyloom.schema import Schema
from tallyloom.types import MaterializedViewSpec, QuerySpec

_RETRIES = 10
GRACE = dt.timedelta(days=1)


class RunLost(RuntimeError):
    """A run was deleted before it was committed: its writer took longer than vacuum() waits."""


class ViewStore:
    """mode: 'sketch' or 'exact', the kind of distinct sketches; it must stay the same for a store."""

    def __init__(self, spark: SparkSession, root: str, schema: Schema, mode: str = metrics.SKETCH, fanout: int = 4):
        self.spark, self.root, self.schema, self.mode, self.fanout = spark, root.rstrip("/"), schema, mode, fanout

    # Layout.

    def _folder(self, tag: int) -> str:
        return f"{self.root}/{tag}"

    def _versions(self, tag: int) -> files.Versions:
        return files.Versions(self.spark, f"{self._folder(tag)}/manifest")

    def manifest(self, tag: int) -> tuple[int, dict]:
        number, found = self._versions(tag).read()
        return number, found or {"levels": [], "applied": {}, "schema": None}

    def _view(self, tag: int) -> MaterializedViewSpec:
        return self.schema.views[tag]

    def keys(self, tag: int) -> list[str]:
        return [dim(self.schema.dimension(n).tag) for n in self._view(tag).view.dimensions]

    def items(self, tag: int) -> list[aggregate.Item]:
        specs = [self.schema.metric(n) for n in self._view(tag).view.metrics]
        return [(met(s.tag), s.type, met(s.tag)) for s in specs]

    # Reading.

    def _read(self, runs: list[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*runs)

    def state(self, tag: int, merged: bool = False) -> DataFrame:
        """Rows of states. Unless merged, several runs may hold rows of one key."""
        _, now = self.manifest(tag)
        runs = [r for level in now["levels"] for r in level]
        if not runs:
            return self.spark.createDataFrame([], self._blank(tag))
        df = self._read(runs, T.StructType.fromJson(now["schema"]))
        return aggregate.merge(df, self.keys(tag), self.items(tag), self.mode) if merged and len(runs) > 1 else df

    def _blank(self, tag: int) -> T.StructType:
        """The schema of a view's states before anything has been merged."""
        relation = self.schema.relation(self._view(tag).relation)
        order = len(order_columns(self.schema, relation)) if self.schema.extractors else 0
        gauge = f"struct<ord:struct<{','.join(f'o{i}:bigint' for i in range(max(1, order)))}>,value:bigint>"
        kinds = {"VARINT_SUM": "bigint", "FLOAT_SUM": "double", "VARINT_GAUGE": gauge, "STRING_HLL": "array<int>" if self.mode == metrics.EXACT else "binary"}
        view = self._view(tag).view
        columns = [f"{dim(d.tag)} {d.type.sql}" for d in map(self.schema.dimension, view.dimensions)]
        columns += [f"{met(m.tag)} {kinds[m.type.name]}" for m in map(self.schema.metric, view.metrics)]
        return T.StructType.fromDDL(", ".join(columns)) if columns else T.StructType([])

    def query(self, spec: QuerySpec, now: dt.datetime | None = None, max_rows: int | None = None) -> DataFrame:
        """The answer to a query by names; rows that are past retention but not yet vacuumed are still there."""
        return self.execute(resolve(self.schema, spec, now), max_rows)

    def execute(self, resolved: ResolvedQuery, max_rows: int | None = None) -> DataFrame:
        query.check_tags(self.schema, resolved)
        _, now = self.manifest(resolved.view)
        return query.execute(self.schema, resolved, self.state(resolved.view), self.mode, sum(map(len, now["levels"])) <= 1, max_rows)

    # Writing.

    def applied(self, tag: int) -> dict[str, int]:
        """The last epoch of each writer."""
        return self.manifest(tag)[1]["applied"]

    def merge(self, tag: int, states: DataFrame, writer: str, epoch: int) -> bool:
        """Adds the states of one epoch of a writer; False, and nothing done, if that epoch has been applied or the view is unknown."""
        if tag not in self.schema.views or epoch <= self.applied(tag).get(writer, -1):
            return False
        run, schema = self._write_pending(tag, states, spread=False)
        for attempt in range(_RETRIES):
            number, now = self.manifest(tag)
            if any(run in level for level in now["levels"]):
                break
            if epoch <= now["applied"].get(writer, -1):
                self._give_up(tag, run)
                return False
            self._still_there(tag, run)
            levels = now["levels"] or [[]]
            document = {"levels": [[*levels[0], run], *levels[1:]], "applied": now["applied"] | {writer: epoch}, "schema": now["schema"] or schema.jsonValue()}
            try:
                self._versions(tag).commit(number, document)
                break
            except files.AlreadyThere:
                if attempt + 1 == _RETRIES:
                    raise
        self._settle(tag, run)
        self.compact(tag)
        return True

    def ingest(self, tag: int, source: DataFrame, writer: str, epoch: int, is_mapped: bool = False) -> bool:
        """merge() of what source rows add to a view."""
        if tag not in self.schema.views:
            return False
        return self.merge(tag, partials(self.schema, self._view(tag), source, self.mode, is_mapped), writer, epoch)

    def _write(self, tag: int, states: DataFrame, spread: bool, name: str | None = None) -> tuple[str, T.StructType]:
        path, keys = f"{self._folder(tag)}/runs/{name or uuid.uuid4().hex}", self.keys(tag)
        columns = [*keys, *dict.fromkeys(i[0] for i in self.items(tag))]
        out = states.select(*columns) if columns else states
        if spread and keys:
            out = out.repartitionByRange(*keys)
        (out.sortWithinPartitions(*keys) if keys else out).write.parquet(path)
        return path, T.StructType([T.StructField(f.name, f.dataType) for f in out.schema.fields])

    # Runs that no manifest names yet.

    def _mark(self, tag: int, run: str) -> str:
        return f"{self._folder(tag)}/pending/{run.rpartition('/')[2]}"

    def _write_pending(self, tag: int, states: DataFrame, spread: bool) -> tuple[str, T.StructType]:
        """_write(), with a mark that spares the run from vacuum(), from before its first file until _settle() or _give_up()."""
        name = uuid.uuid4().hex
        files.touch(self.spark, self._mark(tag, name))
        return self._write(tag, states, spread, name)

    def _still_there(self, tag: int, run: str) -> None:
        if not files.exists(self.spark, self._mark(tag, run)):
            files.delete(self.spark, run)
            raise RunLost(run)

    def _settle(self, tag: int, run: str) -> None:
        files.delete(self.spark, self._mark(tag, run))

    def _give_up(self, tag: int, run: str) -> None:
        files.delete(self.spark, run)
        self._settle(tag, run)

    def compact(self, tag: int, whole: bool = False, keep: Column | None = None) -> None:
        """Merges the runs of every level that is full; whole: all runs into one, of which rows stay for which the Column keep is true."""
        while True:
            number, now = self.manifest(tag)
            levels = [list(x) for x in now["levels"]]
            if whole:
                old, at = [r for level in levels for r in level], max(0, len(levels) - 1)
            else:
                full = [i for i, level in enumerate(levels) if len(level) >= self.fanout]
                if not full:
                    return
                old, at = levels[full[0]], full[0] + 1
            if not old:
                return
            states = self._read(old, T.StructType.fromJson(now["schema"]))
            if keep is not None:
                states = states.where(keep)
            run, _ = self._write_pending(tag, aggregate.merge(states, self.keys(tag), self.items(tag), self.mode), spread=True)
            left = [[r for r in level if r not in old] for level in levels] + [[]] * (at + 1 - len(levels))
            left[at] = [*left[at], run]
            try:
                self._still_there(tag, run)
                self._versions(tag).commit(number, now | {"levels": left})
            except files.AlreadyThere:
                if not any(run in level for level in self.manifest(tag)[1]["levels"]):
                    self._give_up(tag, run)
                    continue
            self._settle(tag, run)
            # Queries that have already been planned may still read the old runs: vacuum() deletes them.
            if whole:
                return

    # Retention.

    def expired(self, tag: int, now: dt.datetime) -> Column | None:
        """A Column, true for rows that are past their view's retention; None if it keeps all. A row is due in the second after its time plus the retention."""
        keep = self._view(tag).retention
        if keep is None:
            return None
        due = F.unix_micros(F.col(dim(self.schema.dimension(keep.relative_to).tag))) + F.lit(keep.remove_after // dt.timedelta(microseconds=1))
        return F.coalesce(F.floor(due / 1_000_000) < int(now.timestamp()), F.lit(False))

    def vacuum(self, now: dt.datetime | None = None, grace: dt.timedelta = GRACE) -> None:
        """Drops rows past retention, views that the schema no longer has (if it has any view at all), and runs that no manifest names and no writer of the last `grace` has marked as pending."""
        now = now or dt.datetime.now(dt.timezone.utc)
        for tag in self.schema.views:
            if (late := self.expired(tag, now)) is not None and self.state(tag).where(late).limit(1).count():
                self.compact(tag, whole=True, keep=~late)
            # In this order: a writer marks, writes, commits, and only then removes its mark.
            runs = files.names(self.spark, f"{self._folder(tag)}/runs")
            marks = dict(files.modified(self.spark, f"{self._folder(tag)}/pending"))
            named = {r.rpartition("/")[2] for level in self.manifest(tag)[1]["levels"] for r in level}
            spared = {name for name, at in marks.items() if at >= time.time() - grace.total_seconds()}
            for name in marks.keys() - spared:
                files.delete(self.spark, self._mark(tag, name))
            for run in runs:
                if run not in named and run not in spared:
                    files.delete(self.spark, f"{self._folder(tag)}/runs/{run}")
        if self.schema.views:
            for name in files.names(self.spark, self.root):
                if name.isdigit() and int(name) not in self.schema.views:
                    files.delete(self.spark, f"{self.root}/{name}")
