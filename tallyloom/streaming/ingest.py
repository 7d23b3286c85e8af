"""Keeping views current from a stream: each micro-batch is mapped once, folded to partial states and merged as one epoch.

The writer of an epoch is the streaming query's id, which its checkpoint keeps, so a replayed batch is recognised and skipped. A new
checkpoint is a new writer that would read everything again: it is refused on a view that already has data, unless the caller says that
the stream starts after that data (`continues`). Late rows merge into their state rows like any other; there is no watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.operators.extract import mapped
from tallyloom.plans.store import ViewStore
from tallyloom.schema import Schema
from tallyloom.streaming.deltas import committed


class UnknownWriter(RuntimeError):
    pass


def writer_of(query_id: str) -> str:
    return f"stream:{query_id}"


def maintain(stream: DataFrame, store: ViewStore, views: list[int], checkpoint: str, trigger: dict | None = None, continues: bool = False, schema: Callable[[], Schema] | None = None) -> StreamingQuery:
    """Starts the maintenance of views that share a relation. schema, if given, is asked before every batch, so a new revision is used from the next batch on."""
    spark = stream.sparkSession

    def apply(batch: DataFrame, epoch: int) -> None:
        if schema is not None:
            store.schema = schema()
        writer = writer_of(spark.sparkContext.getLocalProperty("sql.streaming.queryId"))
        due = [t for t in views if t in store.schema.views and epoch > store.applied(t).get(writer, -1)]
        for tag in due:
            others = [w for w in store.applied(tag) if w != writer]
            if writer not in store.applied(tag) and others and not continues:
                raise UnknownWriter(f"view {tag} already has data of {others}; start over with an empty view, or state that this stream continues after it")
        if not due:
            return
        rows = mapped(store.schema, store.schema.relation(store.schema.views[due[0]].relation), batch)
        rows = rows.persist() if len(due) > 1 else rows
        try:
            for tag in due:
                store.ingest(tag, rows, writer, epoch, is_mapped=True)
        finally:
            rows.unpersist()

    relations = {store.schema.views[t].relation for t in views}
    if len(relations) != 1:
        raise ValueError(f"views of one relation are maintained together, not of {sorted(relations)}")
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def maintain_deltas(events: DataFrame, store: ViewStore, view: int, row_schema: str, checkpoint: str, refused: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Keeps a view from a stream of delta events (writer, seq_no, row, position) whose rows are source rows as JSON of row_schema (DDL).

    Rows that an acknowledgement commits within a micro-batch are one epoch of the view, so data, epochs and held rows advance together: a batch
    that is replayed gives the same committed rows from the same state, and the view takes an epoch once. refused gets (writer, seq_no, error) of bad events.
    """
    spark = events.sparkSession

    def apply(batch: DataFrame, epoch: int) -> None:
        writer = writer_of(spark.sparkContext.getLocalProperty("sql.streaming.queryId"))
        if refused is not None:
            refused(batch.where("error IS NOT NULL").select("writer", "seq_no", "error"), epoch)
        rows = batch.where("error IS NULL").select(F.from_json("row", row_schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
        store.ingest(view, rows, writer, epoch)

    return committed(events).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
