"""The registered queries, one for each operator of the engine over the driver's tables, with DuckDB SQL for those that SQL can express.

Values are made comparable here and only here: floating-point sums are rounded, times become dates as text.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import metrics
from tallyloom.operators import query
from tallyloom.operators.extract import partials
from tallyloom.operators.query import resolve
from tallyloom.plans import backfill, driver
from tallyloom.plans.store import ViewStore
from tallyloom.sources.registry import Source, Sources
from tallyloom.streaming.ingest import maintain
from tallyloom.types import Filter, FloatRange, IntRange, QuerySpec, StringRange, TimeRange, ViewSpec

UTC = dt.timezone.utc
NOW = dt.datetime(2024, 1, 8, tzinfo=UTC)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _spec(view: str, dimensions: list[str], measures: list[str], *filters: Filter) -> QuerySpec:
    return QuerySpec(view, ViewSpec(dimensions, measures), list(filters))


def _shown(df: DataFrame) -> DataFrame:
    """Sums to cents, times to dates."""
    show = {"double": lambda c: F.round(c, 2), "timestamp": lambda c: F.date_format(c, "yyyy-MM-dd")}
    return df.select(*(show.get(f.dataType.simpleString(), lambda c: c)(F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields))


def _ask(spark: SparkSession, sf_dir: str, spec: QuerySpec, now: dt.datetime = NOW) -> DataFrame:
    """A query straight over its relation's table."""
    schema = driver.schema()
    return _shown(query.over_rows(schema, resolve(schema, spec, now), driver.source_of(spark, sf_dir, spec.materialized_view, schema)))


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='views-')}"
    return f"{base.rstrip('/')}/views-{uuid.uuid4().hex}"


def _store(spark: SparkSession, mode: str = metrics.SKETCH) -> ViewStore:
    return ViewStore(spark, _folder(spark), driver.schema(), mode)


def _tag(store: ViewStore, view: str) -> int:
    return store.schema.view(view).tag


# Sums, roll-ups, distinct rows.


@_register("SELECT l_returnflag AS return_flag, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS row_count FROM lineitem GROUP BY 1")
def sum_float_prefix(spark, sf_dir):
    return _ask(spark, sf_dir, _spec("line_stats", ["return_flag"], ["sum_price", "revenue", "row_count"]))


@_register("SELECT l_linestatus AS line_status, round(sum(l_extendedprice), 2) AS sum_price FROM lineitem GROUP BY 1")
def sum_float_nonprefix(spark, sf_dir):
    return _ask(spark, sf_dir, _spec("line_stats", ["line_status"], ["sum_price"]))


@_register("SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS ship_month, l_returnflag AS return_flag, round(sum(l_quantity), 2) AS sum_quantity, count(*) AS row_count FROM lineitem GROUP BY 1, 2")
def roll_up_reordered(spark, sf_dir):
    """Query dimensions in another order than the view's."""
    return _ask(spark, sf_dir, _spec("line_stats", ["ship_month", "return_flag"], ["sum_quantity", "row_count"]))


@_register("SELECT o_orderpriority AS order_priority, o_orderstatus AS order_status, count(*) AS row_count FROM orders GROUP BY 1, 2")
def count_const_one(spark, sf_dir):
    return _ask(spark, sf_dir, _spec("order_stats", ["order_priority", "order_status"], ["row_count"]))


@_register("SELECT count(*) AS row_count, round(sum(l_quantity), 2) AS sum_quantity FROM lineitem HAVING count(*) > 0")
def global_rollup(spark, sf_dir):
    return _ask(spark, sf_dir, _spec("line_stats", [], ["row_count", "sum_quantity"]))


@_register("SELECT count(*) AS row_count FROM lineitem WHERE l_returnflag >= '~' HAVING count(*) > 0")
def global_empty(spark, sf_dir):
    """No row matches, so there is no row at all."""
    return _ask(spark, sf_dir, _spec("line_stats", [], ["row_count"], Filter("return_flag", strings=[StringRange("~")])))


@_register("SELECT DISTINCT c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS cust_nation FROM customer")
def distinct_dims(spark, sf_dir):
    return _ask(spark, sf_dir, _spec("customer_dims", ["segment", "cust_nation"], []))


@_register("SELECT s_nationkey::BIGINT AS supp_nation, count(*) AS row_count, round(sum(s_acctbal), 2) AS sum_supp_balance FROM supplier GROUP BY 1")
def supplier_balances(spark, sf_dir):
    return _ask(spark, sf_dir, _spec("supplier_stats", ["supp_nation"], ["row_count", "sum_supp_balance"]))


# Filters.


@_register("SELECT p_size::BIGINT AS part_size, count(*) AS row_count FROM part WHERE p_size BETWEEN 5 AND 10 OR p_size BETWEEN 40 AND 45 GROUP BY 1")
def filter_int_ranges(spark, sf_dir):
    return _ask(spark, sf_dir, _spec("part_stats", ["part_size"], ["row_count"], Filter("part_size", ints=[IntRange(5, 10), IntRange(40, 45)])))


@_register("SELECT l_quantity AS quantity, count(*) AS row_count, round(sum(l_extendedprice), 2) AS sum_price FROM lineitem WHERE l_quantity BETWEEN 10.5 AND 20 GROUP BY 1")
def filter_float_range(spark, sf_dir):
    return _ask(spark, sf_dir, _spec("line_quantities", ["quantity"], ["row_count", "sum_price"], Filter("quantity", floats=[FloatRange(10.5, 20.0)])))


@_register("SELECT o_orderpriority AS order_priority, count(*) AS row_count FROM orders WHERE o_orderpriority <= '2-HIGH' OR o_orderpriority >= '4-NOT SPECIFIED' GROUP BY 1")
def filter_string_open(spark, sf_dir):
    return _ask(spark, sf_dir, _spec("order_stats", ["order_priority"], ["row_count"], Filter("order_priority", strings=[StringRange(end="2-HIGH"), StringRange("4-NOT SPECIFIED")])))


@_register("SELECT strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') AS order_day, round(sum(o_totalprice), 2) AS sum_total FROM orders WHERE date_trunc('day', o_orderdate) BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-05-31' GROUP BY 1")
def filter_time_abs(spark, sf_dir):
    bounds = TimeRange(dt.datetime(1995, 3, 1, tzinfo=UTC), dt.datetime(1995, 5, 31, tzinfo=UTC))
    return _ask(spark, sf_dir, _spec("order_stats", ["order_day"], ["sum_total"], Filter("order_day", times=[bounds])))


@_register("SELECT event_type, count(*) AS row_count FROM events WHERE date_trunc('day', ts) BETWEEN TIMESTAMP '2024-01-08' - INTERVAL 3 DAY AND TIMESTAMP '2024-01-08' - INTERVAL 1 DAY GROUP BY 1")
def filter_time_relative(spark, sf_dir):
    """Relative to a clock that is fixed for the query."""
    bounds = TimeRange(relative_begin=dt.timedelta(days=-3), relative_end=dt.timedelta(days=-1))
    return _ask(spark, sf_dir, _spec("event_stats", ["event_type"], ["row_count"], Filter("event_day", times=[bounds])))


@_register("SELECT l_linestatus AS line_status, count(*) AS row_count FROM lineitem WHERE l_returnflag BETWEEN 'N' AND 'R' GROUP BY 1")
def filter_not_in_output(spark, sf_dir):
    return _ask(spark, sf_dir, _spec("line_stats", ["line_status"], ["row_count"], Filter("return_flag", strings=[StringRange("N", "R")])))


@_register("SELECT n_nationkey::BIGINT AS nation_key, n_name AS nation_name, count(*) AS row_count FROM nation WHERE n_nationkey <= 7 GROUP BY 1, 2")
def filter_zero_sentinel(spark, sf_dir):
    """A bound of 0 is an open side."""
    return _ask(spark, sf_dir, _spec("nation_list", ["nation_key", "nation_name"], ["row_count"], Filter("nation_key", ints=[IntRange(0, 7)])))


@_register("SELECT l_returnflag AS return_flag, count(*) AS row_count FROM lineitem WHERE (l_quantity <= 10 OR l_quantity BETWEEN 20 AND 30) AND (l_linenumber BETWEEN 1 AND 2 OR l_linenumber >= 5) AND l_returnflag >= 'B' GROUP BY 1")
def filter_multi_dim(spark, sf_dir):
    return _ask(
        spark,
        sf_dir,
        _spec(
            "line_quantities",
            ["return_flag"],
            ["row_count"],
            Filter("quantity", floats=[FloatRange(end=10.0), FloatRange(20.0, 30.0)]),
            Filter("line_number", ints=[IntRange(1, 2), IntRange(5)]),
            Filter("return_flag", strings=[StringRange("B")]),
        ),
    )


# Gauges and distinct counts.


@_register("SELECT event_type, user_id AS event_user, arg_max(event_id, {'a': ts, 'b': event_id}) AS last_event FROM events GROUP BY 1, 2")
def gauge_last_value(spark, sf_dir):
    return _ask(spark, sf_dir, _spec("event_last", ["event_type", "event_user"], ["last_event"]))


@_register("SELECT event_type, arg_max(last_event, event_user) AS last_event FROM (SELECT event_type, user_id AS event_user, arg_max(event_id, {'a': ts, 'b': event_id}) AS last_event FROM events GROUP BY 1, 2) GROUP BY 1")
def gauge_rollup_key_order(spark, sf_dir):
    """Rolled up, a gauge has the value of the row with the greatest view key."""
    return _ask(spark, sf_dir, _spec("event_last", ["event_type"], ["last_event"]))


def _close(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """Whether estimates are within 3 % of the truth, by group, in the engine's two kinds of sketches."""
    schema = driver.schema()
    spec = _spec("line_parts", ["return_flag", "line_status"], ["unique_parts"])
    found = query.over_rows(schema, resolve(schema, spec, NOW), driver.source_of(spark, sf_dir, "line_parts", schema), mode)
    true = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("return_flag"), F.col("l_linestatus").alias("line_status")).agg(F.countDistinct("l_partkey").alias("parts"))
    return found.join(true, ["return_flag", "line_status"]).select("return_flag", "line_status", "parts", (F.abs(F.col("unique_parts") - F.col("parts")) <= F.lit(0.03) * F.col("parts")).alias("close"))


_CLOSE = "SELECT l_returnflag AS return_flag, l_linestatus AS line_status, count(DISTINCT l_partkey) AS parts, TRUE AS close FROM lineitem GROUP BY 1, 2"


@_register(_CLOSE)
def hll_accuracy(spark, sf_dir):
    return _close(spark, sf_dir, metrics.SKETCH)


@_register(_CLOSE)
def hll_exact_accuracy(spark, sf_dir):
    """By registers of MurmurHash3, as the data model's estimates are defined."""
    return _close(spark, sf_dir, metrics.EXACT)


@_register()
def hll_exact_estimates(spark, sf_dir):
    """The estimates themselves; SQL lacks the hash."""
    schema = driver.schema()
    spec = _spec("event_users", ["event_type"], ["unique_users"])
    return query.over_rows(schema, resolve(schema, spec, NOW), driver.source_of(spark, sf_dir, "event_users", schema), metrics.EXACT)


# Mappings.

_WORDS = """WITH a AS (SELECT {keys}, unnest(string_split_regex(lower(coalesce(text, '')), '[ ,.?;"()!]+')) AS word FROM {table}), w AS (SELECT * FROM a WHERE word <> '') """


@_register(_WORDS.format(keys="lang, doc_id", table="documents") + "SELECT word, lang, count(DISTINCT doc_id) AS row_count, count(*) AS total_words FROM w GROUP BY 1, 2")
def map_words(spark, sf_dir):
    return _ask(spark, sf_dir, _spec("word_stats", ["word", "lang"], ["row_count", "total_words"]))


_DOC_STATS = _WORDS.format(keys="lang, doc_id", table="documents") + "SELECT lang, doc_id AS doc, 1::BIGINT AS doc_count, count(DISTINCT word) AS row_count, count(*) AS total_words FROM w GROUP BY 1, 2"


@_register(_DOC_STATS)
def doc_stats(spark, sf_dir):
    return _ask(spark, sf_dir, _spec("doc_stats", ["lang", "doc"], ["doc_count", "row_count", "total_words"]))


@_register(_WORDS.format(keys="lang, doc_id", table="documents") + "SELECT lang, count(DISTINCT doc_id) AS doc_count, count(*) AS total_words FROM w GROUP BY 1")
def lang_totals(spark, sf_dir):
    return _ask(spark, sf_dir, _spec("doc_stats", ["lang"], ["doc_count", "total_words"]))


@_register(_WORDS.format(keys="role, turn", table="(SELECT row_number() OVER () AS turn, conv_id, role, text FROM conversations)") + "SELECT role, count(DISTINCT turn) AS doc_count, count(*) AS total_words FROM w GROUP BY 1")
def conv_turn_stats(spark, sf_dir):
    return _ask(spark, sf_dir, _spec("turn_stats", ["role"], ["doc_count", "total_words"]))


# Stored state.

_LINES = "SELECT l_returnflag AS return_flag, l_linestatus AS line_status, strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS ship_month, count(*) AS row_count, round(sum(l_extendedprice), 2) AS sum_price FROM lineitem GROUP BY 1, 2, 3"


def _line_query() -> QuerySpec:
    return _spec("line_stats", ["return_flag", "line_status", "ship_month"], ["row_count", "sum_price"])


@_register(_LINES)
def two_level_merge(spark, sf_dir):
    """A view stored from three splits of its source, with a compaction between, equals a single pass."""
    store = _store(spark)
    store.fanout = 2
    tag, rows = _tag(store, "line_stats"), driver.source_of(spark, sf_dir, "line_stats")
    for i in range(3):
        store.ingest(tag, rows.where(F.pmod("l_orderkey", F.lit(3)) == i), "batch", i)
    return _shown(store.query(_line_query(), NOW))


@_register(_LINES)
def replayed_epoch(spark, sf_dir):
    """An epoch that comes twice counts once."""
    store = _store(spark)
    tag, rows = _tag(store, "line_stats"), driver.source_of(spark, sf_dir, "line_stats")
    for epoch in (0, 0):
        store.ingest(tag, rows, "batch", epoch)
    return _shown(store.query(_line_query(), NOW))


@_register("SELECT event_type, user_id AS event_user, arg_max(event_id, {'a': ts, 'b': event_id}) AS last_event FROM events GROUP BY 1, 2")
def stored_gauge(spark, sf_dir):
    """Splits merged in the reverse of their order: the last value is by the declared order all the same."""
    store = _store(spark)
    tag, rows = _tag(store, "event_last"), driver.source_of(spark, sf_dir, "event_last")
    for epoch, i in enumerate((2, 1, 0)):
        store.ingest(tag, rows.where(F.pmod("event_id", F.lit(3)) == i), "batch", epoch)
    return store.query(_spec("event_last", ["event_type", "event_user"], ["last_event"]), NOW)


@_register("SELECT o_orderpriority AS order_priority, o_orderstatus AS order_status, count(*) AS row_count, round(sum(o_totalprice), 2) AS sum_total FROM orders GROUP BY 1, 2")
def backfill_plus_live(spark, sf_dir):
    """Rows before a cut-over by back-fill (loaded twice, counted once), the rest as live batches."""
    store, cut = _store(spark), F.lit("1998-01-01").cast("timestamp_ntz")
    tag, folder = _tag(store, "order_stats"), _folder(spark)
    rows = driver.source_of(spark, sf_dir, "order_stats")
    rows.where(F.col("o_orderdate") < cut).write.parquet(f"{folder}/old")
    store.ingest(tag, rows.where((F.col("o_orderdate") >= cut) | F.col("o_orderdate").isNull()), "live", 0)
    history = Sources(Source("history", f"{folder}/old", labels={"table": "orders"}))
    tasks = backfill.specify(spark, store.schema, history, {(tag, "history"): float("inf")})
    for _ in range(2):
        backfill.run(store, history, tasks, "history")
    return _shown(store.query(_spec("order_stats", ["order_priority", "order_status"], ["row_count", "sum_total"]), NOW))


@_register("SELECT event_type, count(*) AS row_count FROM events WHERE floor(epoch(ts)) + 7 * 86400 >= epoch(TIMESTAMP '2024-01-08 12:00:00') GROUP BY 1")
def retention_vacuum(spark, sf_dir):
    """Rows are gone once their time plus a week is past, in whole seconds."""
    store = _store(spark)
    tag = _tag(store, "recent_events")
    store.ingest(tag, driver.source_of(spark, sf_dir, "recent_events"), "batch", 0)
    store.vacuum(dt.datetime(2024, 1, 8, 12, tzinfo=UTC))
    return store.query(_spec("recent_events", ["event_type"], ["row_count"]), NOW)


@_register("SELECT event_type, user_id AS event_user, count(*) AS row_count, round(sum(value), 2) AS sum_value FROM events GROUP BY 1, 2")
def stream_ingest(spark, sf_dir):
    """Structured Streaming keeps the view, each micro-batch an epoch."""
    store = _store(spark)
    rows = driver.source_of(spark, sf_dir, "event_stats")
    source = Source("events", f"{sf_dir}/events.parquet", labels={"table": "events"})
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    stream = spark.readStream.schema(schema).parquet(*_stream_path(source.path))
    q = maintain(stream, store, [_tag(store, "event_stats")], f"{_folder(spark)}/checkpoint")
    q.awaitTermination()
    return _shown(store.query(_spec("event_stats", ["event_type", "event_user"], ["row_count", "sum_value"]), NOW))


def _stream_path(path: str) -> list[str]:
    """Streams read folders or patterns; a pattern also stands for the one file."""
    return [f"{path[:-1]}[{path[-1]}]"]


@_register("SELECT l_returnflag AS return_flag, l_linestatus AS line_status, count(*) AS row_count FROM lineitem WHERE l_returnflag <= 'N' GROUP BY 1, 2")
def stored_filter(spark, sf_dir):
    """A filter over stored state, which is laid out by the view's dimensions."""
    store = _store(spark)
    tag = _tag(store, "line_stats")
    store.merge(tag, partials(store.schema, store.schema.views[tag], driver.source_of(spark, sf_dir, "line_stats")), "batch", 0)
    return store.query(_spec("line_stats", ["return_flag", "line_status"], ["row_count"], Filter("return_flag", strings=[StringRange(end="N")])), NOW)


def entry(spark: SparkSession) -> DataFrame:
    return doc_stats(spark, "/root/testdata/sf0.001")


from tallyloom.plans import outcomes  # noqa: E402, F401  (it registers the rest)
