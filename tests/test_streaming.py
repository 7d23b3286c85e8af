"""Streams into views, two-phase commit, back-fill, reconciliation."""

import datetime as dt
import json
import os
import random
import tracemalloc

import pandas as pd
import pytest

from quotes import QUOTE_STATS, QUOTES, SCHEMA, WORD_STATS, frame, schema, tuples
from tallyloom.plans import backfill
from tallyloom.plans.reconcile import Stream, reconcile, stream_id, wanted
from tallyloom.plans.store import ViewStore
from tallyloom.sources.registry import Source, Sources
from tallyloom.streaming.deltas import committed
from tallyloom.streaming.ingest import UnknownWriter, maintain
from tallyloom.streaming.transactions import DeltaEvent, SequenceError, Transactions
from tallyloom.types import QuerySpec, ValidationError, ViewSpec


def words(store):
    return tuples(store.query(QuerySpec("word_stats", ViewSpec(["word", "author"], ["sum_word_quotes", "last_quote", "sum_words"]))))


def stats(store):
    return tuples(store.query(QuerySpec("quote_stats", ViewSpec(["author", "quote_id"], ["sum_quotes", "sum_word_quotes", "sum_words", "unique_words"]))))


def put(folder, name, quotes):
    folder.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps({"id": i, "author": a, "text": t, "time": "2024-01-01T00:00:00Z"}) for i, a, t in quotes]
    (folder / name).write_text("\n".join([*lines, "{broken"]) + "\n")


def source(folder, name="quotes"):
    return Source(name, f"file://{folder}", "json", SCHEMA, {"kind": "quote"})


def test_stream_with_a_restart(spark, tmp_path):
    store, folder = ViewStore(spark, f"file://{tmp_path}/views", schema()), tmp_path / "in"
    start = lambda: maintain(source(folder).stream(spark, maxFilesPerTrigger="1"), store, [1, 2], f"{tmp_path}/check")
    put(folder, "a.json", QUOTES[:1])
    put(folder, "b.json", QUOTES[1:2])
    start().awaitTermination()
    assert stats(store) == [QUOTE_STATS[0], QUOTE_STATS[2]]
    put(folder, "c.json", QUOTES[2:])
    start().awaitTermination()
    start().awaitTermination()  # nothing new
    assert words(store) == WORD_STATS and stats(store) == QUOTE_STATS
    (writer, epoch), = store.applied(1).items()
    assert writer.startswith("stream:") and epoch == 2


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    store, folder = ViewStore(spark, f"file://{tmp_path}/views", schema()), tmp_path / "in"
    put(folder, "a.json", QUOTES)
    q = maintain(source(folder).stream(spark), store, [1, 2], f"{tmp_path}/check")
    q.awaitTermination()
    for commit in (tmp_path / "check/commits").glob("*0"):
        commit.unlink()  # as if the query had died before it noted the batch
    for crc in (tmp_path / "check/commits").glob(".*"):
        crc.unlink()
    maintain(source(folder).stream(spark), store, [1, 2], f"{tmp_path}/check").awaitTermination()
    assert words(store) == WORD_STATS and stats(store) == QUOTE_STATS


def test_a_new_checkpoint_does_not_count_twice(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    store, folder = ViewStore(spark, f"file://{tmp_path}/views", schema()), tmp_path / "in"
    put(folder, "a.json", QUOTES)
    maintain(source(folder).stream(spark), store, [1], f"{tmp_path}/one").awaitTermination()
    with pytest.raises(StreamingQueryException, match=UnknownWriter.__name__):
        maintain(source(folder).stream(spark), store, [1], f"{tmp_path}/two").awaitTermination()
    assert words(store) == WORD_STATS
    other = tmp_path / "later"
    put(other, "d.json", [(999, "New One", "one")])
    maintain(source(other).stream(spark), store, [1], f"{tmp_path}/three", continues=True).awaitTermination()
    assert ("one", "New One", 1, 999, 1) in words(store)


def test_a_schema_is_asked_for_before_each_batch(spark, tmp_path):
    store, folder = ViewStore(spark, f"file://{tmp_path}/views", schema()), tmp_path / "in"
    put(folder, "a.json", QUOTES)

    def without_views():
        s = schema()
        del s.views[1]
        return s

    maintain(source(folder).stream(spark), store, [1], f"{tmp_path}/check", schema=without_views).awaitTermination()
    assert 1 not in store.schema.views and not (tmp_path / "views/1").exists()


R, A = "row", None
STEPS = [(R, 1, 0), (R, 2, 0), (A, 2, 2), (R, 3, 0), (R, 5, 0), (A, 6, 2), (R, 9, 0), (R, 10, 0), (A, 6, 0), (R, 7, 0), (A, 7, 1), (A, 7, 0), (R, 8, 0), (R, 9, 0), (R, 10, 0)]
ERRORS = [
    (R, 8, r"repeat SeqNo (extractor a, seqNo 8)"),
    (A, 9, r"unexpected commit SeqNo (seqNo: 9, last event: 10, last commit: 7)"),
    (A, 6, r"unexpected commit SeqNo (seqNo: 6, last event: 10, last commit: 7)"),
]


def test_transitions():
    txn = Transactions()
    for row, n, done in STEPS:
        assert len(txn.apply(DeltaEvent("a", n, row))) == done
        txn = Transactions.restore(json.loads(json.dumps(txn.snapshot())))
    for row, n, message in ERRORS:
        with pytest.raises(SequenceError) as e:
            txn.apply(DeltaEvent("a", n, row))
        assert str(e.value) == message
    assert [e.seq_no for e in txn.apply(DeltaEvent("a", 10))] == [8, 9, 10]
    assert txn.apply(DeltaEvent("b", 1, R)) == [] and len(txn.apply(DeltaEvent("b", 4))) == 1


def test_transitions_in_a_stream(spark, tmp_path):
    events, at = [*((row, n) for row, n, _ in STEPS), *((row, n) for row, n, _ in ERRORS), (A, 10)], tmp_path / "events"
    at.mkdir()
    for k, (lo, hi) in enumerate(((0, 7), (7, 14), (14, len(events)))):
        rows = [{"writer": "a", "seq_no": n, "row": f"r{n}" if row else None, "position": i} for i, (row, n) in enumerate(events) if lo <= i < hi]
        (at / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(at / f"{k}.json", (1000 + k, 1000 + k))  # files are read in the order of their times
    stream = spark.readStream.schema("writer string, seq_no long, row string, position long").option("maxFilesPerTrigger", "1").json(str(at))
    q = committed(stream).writeStream.format("memory").queryName("done").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("done").collect()
    assert [r["row"] for r in got if r["error"] is None] == ["r1", "r2", "r3", "r5", "r7", "r8", "r9", "r10"]
    assert [r["error"] for r in got if r["error"]] == [m for _, _, m in ERRORS]


def test_events_out_of_order_are_refused_and_change_nothing(spark, tmp_path):
    at = tmp_path / "events"
    at.mkdir()
    for k, rows in enumerate(([("r1", 1, 10), ("r2", 2, 11)], [("late", 3, 5), ("r2", 2, 11), (None, 2, 12)], [(None, 7, None), ("r4", 4, 20), (None, 4, 21)])):
        (at / f"{k}.json").write_text("".join(json.dumps({"writer": "a", "seq_no": n, "row": row, "position": p}) + "\n" for row, n, p in rows))
        os.utime(at / f"{k}.json", (1000 + k, 1000 + k))
    stream = spark.readStream.schema("writer string, seq_no long, row string, position long").option("maxFilesPerTrigger", "1").json(str(at))
    committed(stream).writeStream.format("memory").queryName("ordered").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.table("ordered").collect()
    assert [r["row"] for r in got if r["error"] is None] == ["r1", "r2", "r4"]
    assert sorted(r["error"] for r in got if r["error"]) == ["event out of order (position 11, last position 11)", "event out of order (position 5, last position 11)", "event without a position"]


class Calls:
    """As much of a stream and of a state as committed() asks for, so that its step can be called here."""

    exists = False

    def groupBy(self, key):
        return self

    def applyInPandasWithState(self, step, *_):
        return step

    def update(self, value):
        self.kept = json.loads(value[0])


def frames(events, n):
    for i in range(0, len(events), n):
        yield pd.DataFrame(events[i : i + n], columns=["seq_no", "row", "position"])


def test_a_writers_events_are_not_held_at_once():
    def most(n):
        places = random.Random(1).sample(range(1, n + 1), n)
        batches = (pd.DataFrame({"writer": "a", "seq_no": part, "row": [None if p % 5 == 0 else f"{p:08d}" * 500 for p in part], "position": part}) for part in (places[i : i + 500] for i in range(0, n, 500)))
        got = []
        tracemalloc.start()
        try:
            for out in committed(Calls())(("a",), batches, Calls()):
                assert [int(row[:8]) for row in out["row"].tolist()] == out["seq_no"].tolist()
                got += out["seq_no"].tolist()
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert got == [p for p in range(1, n + 1) if p % 5]
        return peak

    small, large = most(15_000), most(60_000)
    assert large < 1.3 * small and large < 100e6


def test_runs_on_disk_change_nothing(monkeypatch):
    """Repeats, gaps, missing positions and bad acknowledgements, sorted in runs of few events over several levels, against a plain sort."""
    from tallyloom.streaming import runs

    pick = random.Random(2)
    events = [(p // 3, None if p % 3 == 0 else f"r{p}", None if pick.random() < 0.01 else p // pick.choice((1, 1, 1, 2))) for p in pick.sample(range(3, 6000), 4000)]
    txn, last, done, bad = Transactions(), None, [], []
    for n, row, p in sorted(events, key=lambda e: (e[2] is None, e[2] or 0)):
        if p is None or last is not None and p <= last:
            bad.append(n)
            continue
        last = p
        try:
            done += [(e.seq_no, e.row) for e in txn.apply(DeltaEvent("a", n, row))]
        except SequenceError:
            bad.append(n)
    assert len(done) > 100 and len(bad) > 100
    monkeypatch.setattr(runs, "RUN", 4000)
    monkeypatch.setattr(runs, "BLOCK", 1000)
    monkeypatch.setattr(runs, "FAN", 3)
    written, write = [], runs._write
    monkeypatch.setattr(runs, "_write", lambda found: written.append(1) or write(found))
    state = Calls()
    out = pd.concat(list(committed(Calls())(("a",), frames(events, 37), state)))
    assert len(written) > 200
    good, refused = out[out["error"].isna()], out[out["error"].notna()]
    assert list(zip(good["seq_no"], good["row"])) == done and list(refused["seq_no"]) == bad
    assert state.kept == json.loads(json.dumps({"txn": txn.snapshot(), "last": last}))


def test_events_by_position():
    from tallyloom.streaming.runs import by_position

    assert list(by_position([])) == []
    events = [(1, "a", 2**60 + 1), (2, None, 5), (3, "c", 2**60), (4, "d", 5)]
    assert list(by_position(frames(events, 3))) == [events[1], events[3], events[2], events[0]]
    assert [e[0] for e in by_position(frames([(1, "a", None), (2, "b", 3), (3, "c", None)], 2))] == [2, 1, 3]


def test_backfill_then_live(spark, tmp_path):
    store, folder = ViewStore(spark, f"file://{tmp_path}/views", schema()), tmp_path / "in"
    put(folder, "a.json", QUOTES[:2])
    sources = Sources(source(folder), Source("other", f"file://{tmp_path}/none", "json", SCHEMA, {"kind": "x"}))
    now = dt.datetime.now(dt.timezone.utc) + dt.timedelta(seconds=5)
    cut = backfill.cut_over(spark, sources, "quotes", now)
    assert cut > 0 and backfill.cut_over(spark, sources, "quotes", now + dt.timedelta(days=2)) == 0
    tasks = backfill.specify(spark, store.schema, sources, {(1, "quotes"): cut, (2, "quotes"): cut})
    assert [(t.source, t.relation, t.views, len(t.paths)) for t in tasks] == [("quotes", "quote_rows", (1, 2), 1)]
    assert backfill.loads(backfill.dumps(tasks)) == tasks
    assert backfill.specify(spark, store.schema, sources, {(1, "quotes"): cut}, now + dt.timedelta(days=2), dt.timedelta(hours=6)) == []
    assert backfill.specify(spark, store.schema, sources, {(1, "quotes"): 0.0}) == []
    stage = f"file://{tmp_path}/stage"
    assert backfill.run(store, sources, tasks, "pony", stage=stage) == {1: True, 2: True}
    assert backfill.run(store, sources, tasks, "pony", stage=stage) == {1: False, 2: False}
    assert stats(store) == [QUOTE_STATS[0], QUOTE_STATS[2]]
    store.ingest(1, frame(spark, QUOTES[2:]), "live", 0)
    store.ingest(2, frame(spark, QUOTES[2:]), "live", 0)
    assert words(store) == WORD_STATS and stats(store) == QUOTE_STATS


def test_backfill_of_old_rows_keeps_a_newer_gauge(spark, tmp_path):
    store, folder = ViewStore(spark, f"file://{tmp_path}/views", schema()), tmp_path / "in"
    put(folder, "a.json", [(1, "Doe Jane", "one")])
    store.ingest(1, frame(spark), "live", 0)
    sources = Sources(source(folder))
    backfill.run(store, sources, backfill.specify(spark, store.schema, sources, {(1, "quotes"): float("inf")}), "old")
    assert ("one", "Doe Jane", 3, 789, 4) in words(store)


def test_reconcile(tmp_path):
    s = schema()
    sources = Sources(Source("q1", "x", labels={"kind": "quote"}), Source("q2", "x", labels={"kind": "quote"}), Source("no", "x", labels={"kind": "other"}))
    want = wanted(s, sources, "prod")
    assert len(want) == 6 and {x.source for x in want} == {"q1", "q2"}
    assert stream_id("prod", 1, "q1") == stream_id("prod", 1, "q1") != stream_id("test", 1, "q1") and len(want[0].id) == 24
    stale = Stream("0" * 24, 9, "gone")
    changes = reconcile(s, sources, "prod", [*want[1:], stale])
    assert (changes.start, changes.stop, set(changes.keep)) == ((want[0],), (stale,), set(want[1:]))
    assert f"+ {want[0].id}" in str(changes)
    with pytest.raises(ValidationError, match="unique"):
        Sources(Source("a", "x"), Source("a", "y"))
    with pytest.raises(ValidationError, match="unknown format"):
        Source("a", "x", "xml")
