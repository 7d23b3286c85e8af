"""Back-fill: history is folded in batch, all views of a relation together, and merged once under the job's own writer name.

specify() lists the files of a view's sources that lie before its stream's cut-over; run() reads them and merges; a second run of the same
(name, number) is ignored. The same in steps, for jobs whose parts run apart or pass through other tools: map_tasks() writes partial aggregates as key and
value text, combine() merges such text, and load() merges it into the views.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

from tallyloom.functions import metrics
from tallyloom.operators import aggregate
from tallyloom.operators.aggregate import dim, met
from tallyloom.operators.extract import mapped, partials
from tallyloom.plans import files
from tallyloom.plans.store import ViewStore
from tallyloom.schema import Schema
from tallyloom.sources import keyvalue, rows
from tallyloom.sources.registry import Sources


@dataclass(frozen=True)
class Task:
    """Files of one source, and the views that they fill."""

    source: str
    relation: str
    views: tuple[int, ...]
    paths: tuple[str, ...]


def cut_over(spark: SparkSession, sources: Sources, name: str, now: dt.datetime, within: dt.timedelta = dt.timedelta(hours=24)) -> float:
    """Where a new stream of a source may start: after the last file of the past day, or at the beginning (0) if there is none."""
    since = (now - within).timestamp()
    recent = [at for _, at, _ in sources[name].files(spark) if since <= at <= now.timestamp()]
    return max(recent, default=0.0)


def specify(spark: SparkSession, schema: Schema, sources: Sources, starts: dict[tuple[int, str], float], now: dt.datetime | None = None, max_age: dt.timedelta | None = None) -> list[Task]:
    """starts: for each (view, source), the modification time after which its stream reads. Files up to then are due, unless older than max_age."""
    oldest = (now or dt.datetime.now(dt.timezone.utc)).timestamp() - max_age.total_seconds() if max_age else float("-inf")
    tasks: dict[tuple[str, str, tuple[int, ...]], list[str]] = {}
    for source in sources:
        due = {(tag, schema.views[tag].relation): at for (tag, name), at in starts.items() if name == source.name and tag in schema.views}
        for path, modified, _ in source.files(spark):
            for relation in sorted({r for _, r in due}):
                views = tuple(sorted(t for (t, r), at in due.items() if r == relation and oldest <= modified <= at))
                if views:
                    tasks.setdefault((source.name, relation, views), []).append(path)
    return [Task(s, r, v, tuple(p)) for (s, r, v), p in sorted(tasks.items())]


def run(store: ViewStore, sources: Sources, tasks: list[Task], name: str, number: int = 0, stage: str | None = None) -> dict[int, bool]:
    """Merges the tasks; for each view, whether anything was merged (False: that job had been loaded before).

    stage: a shared folder to which mapped rows are written once, for sources that are dear to decode; otherwise each view scans the
    source itself, for its own columns only.
    """
    spark, writer = store.spark, f"backfill:{name}-{number}"
    done: dict[int, bool] = {}
    for view in sorted({v for t in tasks for v in t.views}):
        done[view] = False
    for i, task in enumerate(tasks):
        due = [v for v in task.views if i > store.applied(v).get(writer, -1)]
        if not due:
            continue
        source = mapped(store.schema, store.schema.relation(task.relation), sources[task.source].read(spark, list(task.paths)))
        if stage and len(due) > 1:
            at = f"{stage.rstrip('/')}/{name}-{number}-{i}"
            source.write.mode("overwrite").parquet(at)
            source = spark.read.schema(source.schema).parquet(at)
        for view in due:
            done[view] |= store.ingest(view, source, writer, i, is_mapped=True)
        if stage and len(due) > 1:
            files.delete(spark, at)
    return done


def map_tasks(spark: SparkSession, schema: Schema, sources: Sources, tasks: list[Task], out: str) -> None:
    """Partial aggregates of all tasks as key and value text under out, one row for each key that a task's view has."""
    for i, task in enumerate(tasks):
        source = mapped(schema, schema.relation(task.relation), sources[task.source].read(spark, list(task.paths)))
        for view in task.views:
            states = partials(schema, schema.views[view], source, metrics.EXACT, is_mapped=True)
            keyvalue.write_hex(rows.encode(schema, view, states), f"{out.rstrip('/')}/{i}-{view}")


def _states(spark: SparkSession, schema: Schema, view: int, paths: list[str]):
    """The merged states that text holds of a view. A gauge that several rows give a value takes the one of the greatest: its order is not in the text."""
    keys = [dim(schema.dimension(n).tag) for n in schema.views[view].view.dimensions]
    items = [(met(m.tag), m.type, met(m.tag)) for m in map(schema.metric, schema.views[view].view.metrics)]
    return aggregate.merge(rows.decode(schema, view, keyvalue.read_hex(spark, paths)), keys, items, metrics.EXACT)


def combine(spark: SparkSession, schema: Schema, paths: list[str], out: str) -> None:
    """Text with one row for each key, sorted by key: views one after the other, in folders by their tags."""
    for view in sorted(schema.views):
        keyvalue.write_hex(rows.encode(schema, view, _states(spark, schema, view, paths)), f"{out.rstrip('/')}/{view}")


def load(store: ViewStore, paths: list[str], name: str, number: int = 0) -> dict[int, bool]:
    """Merges text into the views of a store with exact sketches; for each view, whether it was merged (False: that job had been loaded before)."""
    if store.mode != metrics.EXACT:
        raise ValueError("key and value text has exact sketches; the store keeps others")
    return {view: store.merge(view, _states(store.spark, store.schema, view, paths), f"backfill:{name}-{number}", 0) for view in sorted(store.schema.views)}


def dumps(tasks: list[Task]) -> str:
    """One line of JSON a task."""
    return "".join(json.dumps(asdict(t)) + "\n" for t in tasks)


def loads(text: str) -> list[Task]:
    return [Task(x["source"], x["relation"], tuple(x["views"]), tuple(x["paths"])) for x in map(json.loads, text.splitlines())]
