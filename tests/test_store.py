"""Stored views: merging, replays, compaction, retention, catalogs and concurrent writers."""

import datetime as dt
import random

import pytest

from quotes import QUOTE_STATS, QUOTES, SPEC, WORD_STATS, extractors, frame, schema, tuples
from tallyloom.plans import files
from tallyloom.plans.catalog import Catalog, Config, RevisionMismatch
from tallyloom.plans.store import RunLost, ViewStore
from tallyloom.types import Filter, QuerySpec, SchemaSpec, StringRange, ValidationError, ViewSpec, dumps, loads

WORDS, STATS, RECENT = 1, 2, 3
NOW = dt.datetime.fromtimestamp(10_000, dt.timezone.utc)


def store_at(spark, tmp_path, mode="sketch", fanout=4):
    return ViewStore(spark, f"file://{tmp_path}/views", schema(), mode, fanout)


def words(store):
    return tuples(store.query(QuerySpec("word_stats", ViewSpec(["word", "author"], ["sum_word_quotes", "last_quote", "sum_words"]))))


def stats(store):
    return tuples(store.query(QuerySpec("quote_stats", ViewSpec(["author", "quote_id"], ["sum_quotes", "sum_word_quotes", "sum_words", "unique_words"]))))


def states(spark, *rows):
    """States of word_stats: a word, its author, and the three metrics; the gauge's order is its place among the arguments."""
    return spark.createDataFrame([(w, a, s1, ((i,), g), s3) for i, (w, a, s1, g, s3) in enumerate(rows)], "d5 string, d4 string, m2 long, m5 struct<ord:struct<o0:long>,value:long>, m3 long")


@pytest.mark.parametrize("mode", ["sketch", "exact"])
def test_quotes(spark, tmp_path, mode):
    store = store_at(spark, tmp_path, mode)
    assert stats(store) == [] and words(store) == []
    for i, quote in enumerate(QUOTES):
        for tag in (WORDS, STATS):
            assert store.ingest(tag, frame(spark, [quote]), "w", i)
    assert words(store) == WORD_STATS and stats(store) == QUOTE_STATS


def test_accumulation(spark, tmp_path):
    store = store_at(spark, tmp_path)
    at = lambda n, s: s.withColumn("m5", __import__("pyspark").sql.functions.expr(f"named_struct('ord', named_struct('o0', {n}L), 'value', m5.value)"))
    store.merge(WORDS, at(0, states(spark, ("present", "record", 100, 200, 300))), "w", 0)
    store.merge(WORDS, at(1, states(spark, ("missing", "record", 1, 2, 3), ("present", "record", 4, 5, 6))), "w", 1)
    assert words(store) == [("missing", "record", 1, 2, 3), ("present", "record", 104, 5, 306)]
    store.merge(WORDS, at(2, states(spark, ("missing", "record", 7, 8, 9), ("present", "record", 10, 11, 12))), "w", 2)
    assert words(store) == [("missing", "record", 8, 8, 12), ("present", "record", 114, 11, 318)]


def test_two_writers_and_replays(spark, tmp_path):
    store = store_at(spark, tmp_path)
    one = states(spark, ("a", "b", 1, 2, 3))
    assert store.merge(WORDS, one, "A", 0) and store.merge(WORDS, one, "B", 0) and store.merge(WORDS, one, "A", 1)
    assert not store.merge(WORDS, one, "A", 1) and not store.merge(WORDS, one, "A", 0) and not store.merge(WORDS, one, "B", 0)
    assert words(store) == [("a", "b", 3, 2, 9)] and store.applied(WORDS) == {"A": 1, "B": 0}
    again = store_at(spark, tmp_path)  # after a restart
    assert not again.merge(WORDS, one, "A", 1) and again.merge(WORDS, one, "B", 1)
    assert words(again) == [("a", "b", 4, 2, 12)]


def test_unknown_views_are_skipped(spark, tmp_path):
    store = store_at(spark, tmp_path)
    assert not store.merge(77, states(spark, ("a", "b", 1, 2, 3)), "A", 0) and not store.ingest(77, frame(spark), "A", 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_gives_the_same_state(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("xyz"), " ".join(rng.choices("one two three four five six".split(), k=4))) for i in range(40)]
    whole, split = store_at(spark, tmp_path / "a", "exact"), store_at(spark, tmp_path / "b", "exact", fanout=2)
    cuts = [0, *sorted(rng.sample(range(1, 40), 5)), 40]
    for tag in (WORDS, STATS):
        whole.ingest(tag, frame(spark, rows), "w", 0)
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            split.ingest(tag, frame(spark, rows[a:b]), "w", i)
    assert sum(map(len, split.manifest(WORDS)[1]["levels"])) < 6
    assert words(whole) == words(split) and stats(whole) == stats(split)


def test_a_lost_attempt_leaves_nothing(spark, tmp_path):
    store = store_at(spark, tmp_path)
    store.merge(WORDS, states(spark, ("a", "b", 1, 2, 3)), "A", 0)
    store._write(WORDS, states(spark, ("lost", "b", 1, 2, 3)), spread=False)
    assert words(store) == [("a", "b", 1, 2, 3)]
    folder = f"{store.root}/{WORDS}/runs"
    assert len(files.names(spark, folder)) == 2
    store.vacuum(NOW)
    assert len(files.names(spark, folder)) == 1 and words(store) == [("a", "b", 1, 2, 3)]


def test_vacuum_spares_what_a_writer_has_not_yet_committed(spark, tmp_path):
    store = store_at(spark, tmp_path)
    commit = store._versions

    class Vacuumed:
        """Someone vacuums between a writer's last file and its commit."""

        def __init__(self, tag):
            self.inner = commit(tag)

        def read(self):
            return self.inner.read()

        def commit(self, after, document):
            store_at(spark, tmp_path).vacuum(NOW)
            return self.inner.commit(after, document)

    store._versions = Vacuumed
    assert store.merge(WORDS, states(spark, ("a", "b", 1, 2, 3)), "A", 0) and words(store) == [("a", "b", 1, 2, 3)]
    assert files.names(spark, f"{store.root}/{WORDS}/pending") == []
    run, _ = store._write_pending(WORDS, states(spark, ("x", "b", 1, 2, 3)), spread=False)
    store_at(spark, tmp_path).vacuum(NOW, grace=dt.timedelta(seconds=-60))  # as if the writer had died long ago
    assert not files.exists(spark, run) and files.names(spark, f"{store.root}/{WORDS}/pending") == []
    with pytest.raises(RunLost):
        store._still_there(WORDS, run)


def test_a_stale_commit_is_refused_after_its_version_was_pruned(spark, tmp_path):
    v = files.Versions(spark, f"file://{tmp_path}/v", keep=3)
    for i in range(6):
        v.commit(i, {"i": i})
    for after in (0, 1, 2, 3, 5):
        with pytest.raises(files.AlreadyThere):
            v.commit(after, {"i": "stale"})
    assert v.read() == (6, {"i": 5}) and v.commit(6, {"i": 6}) == 7
    # One that looked before the others committed: it finds out afterwards, and takes its file back.
    read, numbers = files.Versions(spark, v.folder, keep=3), v._numbers
    for after, first in ((0, []), (2, [2])):
        answers = iter([first])
        read._numbers = lambda: next(answers, None) or numbers()
        with pytest.raises(files.AlreadyThere):
            read.commit(after, {"i": "stale"})
        assert numbers() == [5, 6, 7]


def test_of_two_writers_of_one_version_one_tries_again(spark, tmp_path):
    store = store_at(spark, tmp_path)
    versions = store._versions(WORDS)
    number, _ = versions.read()
    read = store.manifest
    calls = []

    def racing(tag):
        out = read(tag)
        if len(calls) == 1:  # another writer commits between this one's read and its commit
            versions.commit(out[0], {"levels": [], "applied": {"other": 5}, "schema": None})
        calls.append(tag)
        return out

    store.manifest = racing
    assert number == 0 and store.merge(WORDS, states(spark, ("a", "b", 1, 2, 3)), "A", 0)
    store.manifest = read
    assert store.applied(WORDS) == {"other": 5, "A": 0} and words(store) == [("a", "b", 1, 2, 3)]


def test_versions(spark, tmp_path):
    v = files.Versions(spark, f"file://{tmp_path}/v", keep=3)
    assert v.read() == (0, None)
    assert [v.commit(i, {"i": i}) for i in range(5)] == [1, 2, 3, 4, 5]
    with pytest.raises(files.AlreadyThere):
        v.commit(4, {"i": "other"})
    assert v.read() == (5, {"i": 4}) and files.names(spark, v.folder) == [f"{i:012d}.json" for i in (3, 4, 5)]


def _recent(store):
    return tuples(store.query(QuerySpec("recent", ViewSpec(["quote_id"], []))))


def test_retention(spark, tmp_path):
    store = store_at(spark, tmp_path)
    ago = lambda s: [frame(spark, [(s, "a", "word")], dt.datetime.fromtimestamp(10_000 - s))]
    for epoch, s in enumerate((59, 60, 61, 3600)):
        store.ingest(RECENT, ago(s)[0], "w", epoch)
        store.ingest(STATS, ago(s)[0], "w", epoch)
    assert _recent(store) == [(59,), (60,), (61,), (3600,)]  # rows past retention stay until the next vacuum
    store.vacuum(NOW)
    assert _recent(store) == [(59,), (60,)] and len(stats(store)) == 4
    store.vacuum(NOW + dt.timedelta(seconds=0.9))
    assert _recent(store) == [(59,), (60,)]  # in whole seconds
    store.vacuum(NOW + dt.timedelta(seconds=1))
    assert _recent(store) == [(59,)]
    store.ingest(RECENT, ago(61)[0], "w", 9)  # late rows come back
    assert _recent(store) == [(59,), (61,)]


def test_dropped_views(spark, tmp_path):
    store = store_at(spark, tmp_path)
    for tag in (WORDS, STATS):
        store.ingest(tag, frame(spark), "w", 0)
    spec = loads(SchemaSpec, SPEC)
    spec.views = []
    store.schema = type(store.schema)(spec, extractors())
    store.vacuum(NOW)  # a schema without any view removes nothing
    assert files.names(spark, store.root) == ["1", "2"]
    spec = loads(SchemaSpec, SPEC)
    spec.views = spec.views[:1]
    store.schema = type(store.schema)(spec, extractors())
    store.vacuum(NOW)
    assert files.names(spark, store.root) == ["1"]


def test_metrics_that_a_state_lacks_are_the_identity(spark, tmp_path):
    from tallyloom.operators.query import execute, resolve

    s = schema()
    r = resolve(s, QuerySpec("word_stats", ViewSpec(["word"], ["sum_words", "last_quote"])))
    rows = spark.createDataFrame([("a", "x", 2, None, None)], "d5 string, d4 string, m2 long, m5 struct<ord:struct<o0:long>,value:long>, m3 long")
    assert tuples(execute(s, r, rows)) == [("a", 0, 0)]


@pytest.fixture(scope="module")
def thirty(spark, tmp_path_factory):
    """Rows of even i below 30, in one run and in three: (i % 5, i) with 1, 10, 100 and a word of its own."""
    out = []
    for name, parts in (("one", 1), ("three", 3)):
        store = store_at(spark, tmp_path_factory.mktemp(name), "exact")
        for p in range(parts):
            rows = [(f"{i % 5:02d}", i, 1, 10, 100, f"{i:04d}") for i in range(0, 30, 2) if i // 2 % parts == p]
            df = spark.createDataFrame(rows, "d4 string, d3 long, m1 long, m2 long, m3 long, w string")
            from tallyloom.functions.hll import exact_partial

            store.merge(STATS, df.drop("w").join(exact_partial(df, ["d4", "d3"], "w").withColumnRenamed("w", "m4"), ["d4", "d3"]), "w", p)
            store.merge(WORDS, states(spark, *((w, a, 1, 10, 100) for a, _, _, _, _, w in rows)), "w", p)
        out.append(store)
    return out


@pytest.mark.parametrize("at", [0, 1])
def test_query_cases(thirty, at):
    store = thirty[at]
    ask = lambda view, dims, mets, *f: tuples(store.query(QuerySpec(view, ViewSpec(dims, mets), list(f))))
    assert ask("quote_stats", ["author"], ["sum_word_quotes", "unique_words"]) == [(f"{i:02d}", 30, 3) for i in range(5)]
    assert ask("quote_stats", ["quote_id"], ["sum_quotes"], Filter("author", strings=[StringRange("00", "01")])) == [(i, 1) for i in (0, 6, 10, 16, 20, 26)]
    assert ask("word_stats", ["author"], ["sum_word_quotes"]) == [(f"{i:02d}", 3) for i in range(5)]


def test_catalog(spark, tmp_path):
    config = Config(f"file://{tmp_path}", "prod")
    catalog = Catalog(spark, config, extractors())
    assert catalog.get() == (0, SchemaSpec())
    spec = loads(SchemaSpec, SPEC)
    assert catalog.update(spec, "prod", 0) == 1 and catalog.get() == (1, spec)
    with pytest.raises(RevisionMismatch):
        catalog.update(spec, "prod", 0)
    with pytest.raises(ValidationError, match="instance mismatch"):
        catalog.update(spec, "test", 1)
    with pytest.raises(ValidationError, match="extractors are registered"):
        Catalog(spark, config).update(spec, "prod", 1)
    changed = loads(SchemaSpec, SPEC.replace("{name: unique_words, dimension: word,", "{name: unique_words, dimension: author,"))
    with pytest.raises(ValidationError, match="cannot alter immutable DimTag"):
        catalog.update(changed, "prod", 1)
    renamed = loads(SchemaSpec, dumps(spec).replace("word_stats", "stats_of_words"))
    assert catalog.update(renamed, "prod", 1) == 2 and catalog.schema().view("stats_of_words").tag == 1
    with pytest.raises(ValidationError, match="root is required"):
        Config("", "x")
    with pytest.raises(ValidationError, match="max_rows"):
        Config("x", "x", 0)
