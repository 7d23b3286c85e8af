"""Further registered queries: exchange formats, sketches' layouts, streams with two-phase commit, back-fill in steps, and what the engine refuses.

Where an outcome is not a table of the driver's (an error, a conflict), the query does the thing and has a row for what came of it; its SQL states what must.
"""

from __future__ import annotations

import copy
import datetime as dt
import io
import json
import sys
import tempfile
import types as pytypes
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import hll, hllbytes, hllforeign, metrics
from tallyloom.operators import query
from tallyloom.operators.extract import partials
from tallyloom.operators.query import ResultTooLarge, resolve
from tallyloom.plans import backfill, driver, files
from tallyloom.plans.catalog import Catalog, Config
from tallyloom.plans.reconcile import Stream, reconcile, stream_id
from tallyloom.plans.registry import _LINES, NOW, _ask, _folder, _line_query, _register, _shown, _spec, _store, _tag
from tallyloom.plans.store import ViewStore
from tallyloom.schema import Schema
from tallyloom.sources import keyvalue, rows, tsv
from tallyloom.sources.registry import Source, Sources
from tallyloom.streaming.ingest import maintain, maintain_deltas
from tallyloom.types import DimensionType, Filter, IntRange, MetricType, QuerySpec, StringRange, TimeRange, ValidationError, dumps, load, loads


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cases(spark: SparkSession, found: Iterable[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(list(found), "step string, outcome string")


def _said(what: Callable) -> str:
    """What a call says: its result, or its error."""
    try:
        return str(what())
    except (ValidationError, ValueError, RuntimeError) as e:
        return str(e)


def _values(*cases: tuple[str, str]) -> str:
    quoted = ", ".join("({})".format(", ".join("'{}'".format(x.replace("'", "''")) for x in c)) for c in cases)
    return f"SELECT * FROM (VALUES {quoted}) AS t(step, outcome)"


# Order and size of results.


@_register("SELECT row_number() OVER (ORDER BY ship_month, return_flag) - 1 AS place, * FROM (SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS ship_month, l_returnflag AS return_flag, count(*) AS row_count FROM lineitem GROUP BY 1, 2)")
def ordered_result(spark, sf_dir):
    """Results are in the order of the query's dimensions: each row with the place at which it comes out."""
    out = _ask(spark, sf_dir, _spec("line_stats", ["ship_month", "return_flag"], ["row_count"]))
    # One row for each line of a printed result.
    return out.withColumn("place", (F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1).cast("long"))


@_register("SELECT most, CASE WHEN n > most THEN 'result set is too large for buffering' ELSE CAST(n AS VARCHAR) END AS outcome FROM (SELECT count(DISTINCT c_mktsegment) AS n FROM customer), (VALUES (1), (4), (5), (1000)) AS t(most)")
def result_guard(spark, sf_dir):
    """A result of more rows than asked for is refused; one of as many is not."""
    schema = driver.schema()
    source = driver.source_of(spark, sf_dir, "customer_dims", schema)
    resolved = resolve(schema, _spec("customer_dims", ["segment"], []), NOW)
    state = partials(schema, schema.view("customer_dims"), source)

    def ask(most: int) -> str:
        try:
            return str(query.execute(schema, resolved, state, max_rows=most).count())
        except ResultTooLarge as e:
            return str(e)

    return spark.createDataFrame([(most, ask(most)) for most in (1, 4, 5, 1000)], "most int, outcome string")


# Exchange formats.


@_register(_LINES)
def key_value_text(spark, sf_dir):
    """States packed to keys and values, written as sorted hex text, read back, unpacked and merged: the same answers."""
    store = _store(spark, metrics.EXACT)
    tag, folder = _tag(store, "line_stats"), _folder(spark)
    states = partials(store.schema, store.schema.views[tag], driver.source_of(spark, sf_dir, "line_stats"), metrics.EXACT)
    keyvalue.write_hex(rows.encode(store.schema, tag, states), f"{folder}/pairs")
    store.merge(tag, rows.decode(store.schema, tag, keyvalue.read_hex(spark, f"{folder}/pairs")), "text", 0)
    return _shown(store.query(_line_query(), NOW))


@_register("SELECT l_returnflag || '|' || l_linestatus AS groups, count(*) AS keys, TRUE AS ascending FROM (SELECT DISTINCT l_returnflag, l_linestatus, date_trunc('month', l_shipdate) AS m FROM lineitem) GROUP BY 1")
def key_order(spark, sf_dir):
    """Packed keys order as the dimensions they hold: within a group of the first two dimensions, months ascend with their keys."""
    schema = driver.schema()
    tag = schema.view("line_stats").tag
    states = partials(schema, schema.views[tag], driver.source_of(spark, sf_dir, "line_stats"), metrics.EXACT)
    back = rows.decode(schema, tag, rows.encode(schema, tag, states).orderBy("key")).select("d10", "d11", "d12", F.monotonically_increasing_id().alias("place"))
    place = lambda c: F.row_number().over(Window.partitionBy("d10", "d11").orderBy(c))
    same = back.withColumn("same", place("place") == place("d12"))
    return same.groupBy(F.concat_ws("|", "d10", "d11").alias("groups")).agg(F.count("*").alias("keys"), F.min("same").alias("ascending"))


@_register("SELECT s_nationkey::BIGINT AS supp_nation, count(*) AS row_count, round(sum(s_acctbal), 2) AS sum_supp_balance FROM supplier GROUP BY 1")
def framed_pairs(spark, sf_dir):
    """The same through length-prefixed frames; a torn frame is an error."""
    store = _store(spark, metrics.EXACT)
    tag = _tag(store, "supplier_stats")
    pairs = rows.encode(store.schema, tag, partials(store.schema, store.schema.views[tag], driver.source_of(spark, sf_dir, "supplier_stats"), metrics.EXACT))
    out = io.BytesIO()
    keyvalue.write_frames(((bytes(r["key"]), bytes(r["value"])) for r in pairs.toLocalIterator()), out)
    if not _said(lambda: list(keyvalue.read_frames(io.BytesIO(out.getvalue()[:-1])))).startswith("unexpected end of frame"):
        raise AssertionError("a torn frame went unnoticed")
    back = spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in keyvalue.read_frames(io.BytesIO(out.getvalue()))], "key binary, value binary")
    store.merge(tag, rows.decode(store.schema, tag, back), "frames", 0)
    return _shown(store.query(_spec("supplier_stats", ["supp_nation"], ["row_count", "sum_supp_balance"]), NOW))


@_register("SELECT o_orderpriority || chr(9) || o_orderstatus || chr(9) || count(*) AS line FROM orders GROUP BY o_orderpriority, o_orderstatus")
def tsv_output(spark, sf_dir):
    """A result written as tab-separated text, and read as lines."""
    at = f"{_folder(spark)}/result"
    tsv.write_tsv(_ask(spark, sf_dir, _spec("order_stats", ["order_priority", "order_status"], ["row_count"])), at)
    return spark.read.text(at).select(F.col("value").alias("line"))


@_register("SELECT n_nationkey::BIGINT AS id, n_name AS author, 'of region ' || n_regionkey AS text FROM nation WHERE n_nationkey BETWEEN 5 AND 19")
def quotes_file(spark, sf_dir):
    """Author and text lines of one file, numbered, of which a range is read."""
    at = f"{_folder(spark)}/quotes"
    lines = _table(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.concat("n_name", F.lit("\tof region "), F.col("n_regionkey").cast("string")))
    lines.coalesce(1).write.text(at)
    return tsv.read_quotes(spark, at, 5, 20)


@_register("SELECT n_nationkey::BIGINT AS nation_key, n_name AS nation_name, count(*) AS row_count FROM nation GROUP BY 1, 2")
def in_memory_source(spark, sf_dir):
    """Rows that are in the driver's memory are a source like any other."""
    schema = driver.schema()
    held = [(r["n_nationkey"], r["n_name"], r["n_regionkey"]) for r in _table(spark, sf_dir, "nation").toLocalIterator()]
    source = spark.createDataFrame(held, "n_nationkey int, n_name string, n_regionkey int")
    return query.over_rows(schema, resolve(schema, _spec("nation_list", ["nation_key", "nation_name"], ["row_count"]), NOW), source)


@_register("SELECT event_type, count(*) FILTER (WHERE event_id % 10 <> 0) AS row_count, count(*) FILTER (WHERE event_id % 10 = 0) AS refused FROM events GROUP BY 1")
def malformed_lines(spark, sf_dir):
    """Every tenth line of a JSON source is broken: it stops nothing, is not counted, and can be looked at."""
    schema, at = driver.schema(), f"{_folder(spark)}/lines"
    events = _table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "ts", "value")
    whole = F.to_json(F.struct("event_id", "event_type", "user_id", "ts", "value"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    events.select(F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), "event_type")).otherwise(whole)).write.text(at)
    source = Source("events", at, "json", "event_id long, event_type string, user_id long, ts timestamp_ntz, value double", {"table": "events"}, {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    good = query.over_rows(schema, resolve(schema, _spec("event_stats", ["event_type"], ["row_count"]), NOW), source.read(spark))
    bad = source.rejected(spark).groupBy(F.expr("substring(line, 2)").alias("event_type")).agg(F.count("*").alias("refused"))
    return good.join(bad, "event_type").select("event_type", "row_count", "refused")


@_register("SELECT c_mktsegment AS segment, count(*) * 2 AS row_count FROM customer GROUP BY 1")
def several_sources(spark, sf_dir):
    """A relation whose selector matches two sources has the rows of both; a third one that is left out by its labels has none."""
    path = f"{sf_dir}/customer.parquet"
    every = Sources(Source("a", path, labels={"table": "customer"}), Source("b", path, labels={"table": "customer"}), Source("c", path, labels={"table": "other"}))
    store = _store(spark)
    relation = store.schema.relation("customers")
    for i, source in enumerate(every.select(relation.selector)):
        store.ingest(_tag(store, "customer_dims"), source.read(spark), source.name, i)
    spec = copy.deepcopy(driver.spec())
    next(v for v in spec.views if v.name == "customer_dims").view.metrics.append("row_count")
    again = ViewStore(spark, _folder(spark), Schema(spec, driver.extractors()))
    for i, source in enumerate(every.select(relation.selector)):
        again.ingest(_tag(again, "customer_dims"), source.read(spark), source.name, i)
    return again.query(_spec("customer_dims", ["segment"], ["row_count"]), NOW)


# Sketches.


def _part_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(f, at, state): exact states of parts by return flag, in three pieces each."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), F.pmod("l_orderkey", F.lit(3)).alias("at"), F.col("l_partkey").cast("string").alias("state"))
    return hll.exact_partial(lines, ["f", "at"], "state")


_SAME = "SELECT l_returnflag AS f, TRUE AS same, count(DISTINCT l_orderkey % 3) AS pieces FROM lineitem GROUP BY 1"


def _same(direct: DataFrame, other: DataFrame) -> DataFrame:
    """Whether states of the same pieces, merged, are equal to the last register."""
    joined = hll.exact_merge(direct, ["f"], "state").join(hll.exact_merge(other, ["f"], "state").withColumnRenamed("state", "other"), "f")
    return joined.join(direct.groupBy("f").agg(F.count("*").alias("pieces")), "f").select("f", (F.col("state") == F.col("other")).alias("same"), "pieces")


@_register(_SAME)
def sketch_bytes_merge(spark, sf_dir):
    """States as Redis bytes, sparse or dense, and back, merged register by register."""
    states = _part_states(spark, sf_dir)
    return _same(states, states.select("f", "at", hllbytes.sketch_state(hllbytes.sketch_bytes("state")).alias("state")))


@_register(_SAME)
def sketch_foreign_merge(spark, sf_dir):
    """One piece in three comes in the HLL++ layout, the others as Redis bytes: merged all the same."""
    states = _part_states(spark, sf_dir)
    data = F.when(F.col("at") == 1, hllforeign.foreign_bytes("state")).otherwise(hllbytes.sketch_bytes("state"))
    return _same(states, states.select("f", "at", hllforeign.foreign_state(data).alias("state")))


@_register("SELECT l_returnflag AS f, count(DISTINCT l_partkey) AS parts, TRUE AS close, TRUE AS header FROM lineitem GROUP BY 1")
def sketch_low_registers(spark, sf_dir):
    """Registers dealt by the low bits, as Redis does: estimates within 3 %; and the streaming database's header has the same estimate."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_partkey").cast("string").alias("v"))
    low = hll._collected(lines.select("f", hllforeign.low_register_of("v").alias("_at")), ["f"], "state")
    true = lines.groupBy("f").agg(F.countDistinct("v").alias("parts"))
    out = low.join(true, "f").withColumn("n", hll.exact_estimate(F.col("state"))).withColumn("x", hllforeign.streaming_bytes(hllbytes.sketch_bytes("state")))
    # Eight bytes, least significant first, from the fifth on.
    number = F.conv(F.concat(*(F.substring(F.hex("x"), 2 * (11 - i) + 1, 2) for i in range(8))), 16, 10).cast("long")
    return out.select("f", "parts", (F.abs(F.col("n") - F.col("parts")) <= 0.03 * F.col("parts")).alias("close"), (number == F.col("n")).alias("header"))


@_register(_values(("0", "XZERO(13046) [0, 13046)"), ("1", "VALUE(3 over 1) [13046, 13047)"), ("2", "XZERO(3337) [13047, 16384)")).replace("step", "place").replace("outcome", "run").replace("SELECT *", "SELECT place::INT AS place, run"))
def sketch_opcodes(spark, sf_dir):
    """What the sparse sketch of one word is made of."""
    state = hll.exact_partial(spark.sql("SELECT 1 AS k, 'hello' AS state"), ["k"], "state")
    return state.select(F.posexplode(hllforeign.opcode_names(hllbytes.sketch_bytes("state"))).alias("place", "run"))


@_register("SELECT 'no rows' AS word, 0::BIGINT AS total, 0::BIGINT AS last, 0::DOUBLE AS price")
def empty_metrics(spark, sf_dir):
    """Metrics that a state lacks are the identity: zero."""
    state = spark.sql("SELECT 'no rows' AS word, CAST(NULL AS BIGINT) AS s, CAST(NULL AS STRUCT<ord: STRUCT<o0: BIGINT>, value: BIGINT>) AS g, CAST(NULL AS DOUBLE) AS f")
    value = lambda kind, c: metrics.flatten(kind, F.col(c))
    return state.select("word", value(MetricType.VARINT_SUM, "s").alias("total"), value(MetricType.VARINT_GAUGE, "g").alias("last"), value(MetricType.FLOAT_SUM, "f").alias("price"))


# Streams with two-phase commit.


@_register("""WITH e AS (SELECT event_id, event_type, user_id, value, user_id % 8 AS w, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS n FROM events)
SELECT event_type, user_id AS event_user, count(*) AS row_count, round(sum(value), 2) AS sum_value FROM e WHERE n <= 5 * ((SELECT max(n) FROM e AS x WHERE x.w = e.w) // 5) GROUP BY 1, 2""")
def two_phase_commit(spark, sf_dir):
    """Delta events of eight writers, an acknowledgement after every fifth row, kept in a view by a stream: what no acknowledgement follows does not count."""
    store, folder = _store(spark), _folder(spark)
    columns = ["event_id", "event_type", "user_id", "ts", "value"]
    events = _table(spark, sf_dir, "events").select(*columns)
    n = F.row_number().over(Window.partitionBy("writer").orderBy("event_id")).cast("long")
    numbered = events.withColumn("writer", F.pmod("user_id", F.lit(8)).cast("string")).withColumn("seq_no", n)
    format_ = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    said = numbered.select("writer", "seq_no", F.to_json(F.struct(*columns), format_).alias("row"), (F.col("seq_no") * 2).alias("position"))
    acks = numbered.where(F.col("seq_no") % 5 == 0).select("writer", "seq_no", F.lit(None).cast("string").alias("row"), (F.col("seq_no") * 2 + 1).alias("position"))
    said.unionByName(acks).coalesce(1).write.parquet(f"{folder}/events")
    stream = spark.readStream.schema("writer string, seq_no long, row string, position long").parquet(f"{folder}/events")
    q = maintain_deltas(stream, store, _tag(store, "event_stats"), "event_id long, event_type string, user_id long, ts timestamp_ntz, value double", f"{folder}/checkpoint")
    q.awaitTermination()
    return _shown(store.query(_spec("event_stats", ["event_type", "event_user"], ["row_count", "sum_value"]), NOW))


@_register("SELECT o_orderpriority AS order_priority, count(*) AS row_count FROM orders GROUP BY 1")
def recovered_stream(spark, sf_dir):
    """A stream that is stopped and started again goes on from its checkpoint, under a schema that is asked for before each batch."""
    store, folder = _store(spark), _folder(spark)
    table = _table(spark, sf_dir, "orders")
    schema = table.schema
    for i in range(2):
        table.where(F.pmod("o_orderkey", F.lit(2)) == i).write.mode("append").parquet(f"{folder}/in")
        again = ViewStore(spark, store.root, store.schema)
        maintain(spark.readStream.schema(schema).parquet(f"{folder}/in"), again, [_tag(store, "order_stats")], f"{folder}/checkpoint", schema=driver.schema).awaitTermination()
    return ViewStore(spark, store.root, store.schema).query(_spec("order_stats", ["order_priority"], ["row_count"]), NOW)


# The store under several writers.


@_register(_values(("commit of a version that has a successor", "refused"), ("epoch again, after a restart", "False"), ("first epoch", "True"), ("run that was vacuumed while it was written", "kept"), ("stale commit, its version pruned", "refused"), ("unknown view", "False")))
def store_conflicts(spark, sf_dir):
    """What writers that race, repeat themselves or come late are told."""
    store = _store(spark)
    tag, source = _tag(store, "supplier_stats"), driver.source_of(spark, sf_dir, "supplier_stats")
    out = [("first epoch", str(store.ingest(tag, source, "a", 0)))]
    again = ViewStore(spark, store.root, store.schema)
    out.append(("epoch again, after a restart", str(again.ingest(tag, source, "a", 0))))
    out.append(("unknown view", str(store.ingest(77, source, "a", 1))))
    versions = files.Versions(spark, f"{_folder(spark)}/v", keep=3)
    for i in range(6):
        versions.commit(i, i)

    def refused(after: int) -> str:
        try:
            return str(versions.commit(after, "late"))
        except files.AlreadyThere:
            return "refused"

    out.append(("commit of a version that has a successor", refused(5)))
    out.append(("stale commit, its version pruned", refused(0)))
    run, schema = again._write_pending(tag, store.state(tag), spread=False)
    store.vacuum(NOW)
    out.append(("run that was vacuumed while it was written", "kept" if files.exists(spark, run) else "lost"))
    return _cases(spark, out)


@_register("SELECT '8' AS view, 1::BIGINT AS rows")
def dropped_views(spark, sf_dir):
    """A view that the schema no longer has is purged by the next vacuum, and so are its files."""
    store = _store(spark)
    for view in ("line_stats", "supplier_stats"):
        store.ingest(_tag(store, view), driver.source_of(spark, sf_dir, view).limit(1), "batch", 0)
    spec = copy.deepcopy(driver.spec())
    spec.views = [v for v in spec.views if v.name != "line_stats"]
    store.schema = Schema(spec, driver.extractors())
    store.vacuum(NOW)
    return spark.createDataFrame([(name, store.state(int(name)).count()) for name in files.names(spark, store.root)], "view string, rows long")


# What is refused.


@_register(
    _values(
        ("dimension of another view", "View.Dimensions[0]: not part of MaterializedView (segment)"),
        ("filter without ranges", "Filters[0]: expected Ints"),
        ("filter twice", "Filters[1]: duplicated Dimension (part_size)"),
        ("no such dimension", "View.Dimensions[0]: no such Dimension (nope)"),
        ("no such view", "no such MaterializedView (nope)"),
        ("ranges out of order", "Filters[0]: invalid range order"),
        ("tag of another view", "DimTag not part of MaterializedView (30)"),
        ("unknown metric tag", "MetTag not part of MaterializedView (999)"),
        ("unknown view tag", "MvTag not found (999)"),
    )
)
def query_errors(spark, sf_dir):
    schema = driver.schema()
    sizes = lambda *r: Filter("part_size", ints=list(r))
    specs = {
        "no such view": _spec("nope", [], []),
        "no such dimension": _spec("part_stats", ["nope"], []),
        "dimension of another view": _spec("part_stats", ["segment"], []),
        "filter without ranges": _spec("part_stats", ["brand"], [], sizes()),
        "filter twice": _spec("part_stats", ["brand"], [], sizes(IntRange(1, 2)), sizes(IntRange(1, 2))),
        "ranges out of order": _spec("part_stats", ["brand"], [], sizes(IntRange(5, 9), IntRange(7, 12))),
    }
    out = [(k, _said(lambda s=s: resolve(schema, s, NOW))) for k, s in specs.items()]
    tag = schema.view("part_stats").tag
    tags = {"unknown view tag": (999, (), ()), "tag of another view": (tag, (30,), ()), "unknown metric tag": (tag, (), (999,))}
    out += [(k, _said(lambda x=x: query.check_tags(schema, query.ResolvedQuery(*x)))) for k, x in tags.items()]
    return _cases(spark, out)


@_register(
    _values(
        ("DimensionType", "INVALID_DIM_TYPE=0 VARINT=1 FLOAT=3 STRING=4 TIMESTAMP=5"),
        ("MetricType", "INVALID_METRIC_TYPE=0 VARINT_SUM=1 VARINT_GAUGE=2 STRING_HLL=3 FLOAT_SUM=4"),
        ("query as text and back", "True"),
        ("schema as text and back", "True"),
        ("unknown name", "type: 'NOPE' is not a valid DimensionType (options are ['INVALID_DIM_TYPE', 'VARINT', 'FLOAT', 'STRING', 'TIMESTAMP'])"),
    )
)
def enum_codecs(spark, sf_dir):
    """Names and numbers of types, and specifications through their text."""
    from tallyloom.types import DimensionSpec, SchemaSpec

    spec = _spec("event_stats", ["event_type"], ["row_count"], Filter("event_day", times=[TimeRange(NOW, relative_end=dt.timedelta(days=-1))]), Filter("event_type", strings=[StringRange("a")]))
    out = [(k.__name__, " ".join(f"{x.name}={x.value}" for x in k)) for k in (DimensionType, MetricType)]
    out.append(("query as text and back", str(loads(QuerySpec, dumps(spec)) == spec)))
    out.append(("schema as text and back", str(loads(SchemaSpec, dumps(driver.spec())) == driver.spec())))
    out.append(("unknown name", _said(lambda: load(DimensionSpec, {"name": "x", "type": "NOPE"}))))
    return _cases(spark, out)


@_register(
    _values(
        ("another instance", "instance mismatch (test; expected prod)"),
        ("first revision", "1"),
        ("metric over another dimension", "refused"),
        ("old revision", "revision is 1, not 0"),
        ("renamed view", "2"),
        ("what it is called then", "part_figures"),
    )
)
def schema_transitions(spark, sf_dir):
    """The catalog's revisions: compare-and-swap, the rules of transition, and what a later reader sees."""
    catalog = Catalog(spark, Config(_folder(spark), "prod"), driver.extractors())
    spec = driver.spec()
    out = [("first revision", str(catalog.update(spec, "prod", 0)))]
    out.append(("old revision", _said(lambda: catalog.update(spec, "prod", 0))))
    out.append(("another instance", _said(lambda: catalog.update(spec, "test", 1))))
    bad = copy.deepcopy(spec)
    next(m for m in bad.metrics if m.name == "sum_price").dimension = "quantity"
    out.append(("metric over another dimension", "refused" if "immutable" in _said(lambda: catalog.update(bad, "prod", 1)) else "taken"))
    new = copy.deepcopy(spec)
    next(v for v in new.views if v.name == "part_stats").name = "part_figures"
    out.append(("renamed view", str(catalog.update(new, "prod", 1))))
    out.append(("what it is called then", catalog.schema().views[spec.views[5].tag].name))
    return _cases(spark, out)


@_register("SELECT CASE WHEN view = 1 THEN '=' ELSE '+' END AS sign, view, source FROM (VALUES (1, 'lineitem'), (2, 'lineitem'), (3, 'lineitem'), (4, 'orders'), (5, 'customer'), (6, 'part'), (7, 'nation'), (8, 'supplier'), (9, 'events'), (10, 'events'), (11, 'events'), (12, 'events'), (13, 'documents'), (14, 'documents'), (15, 'conversations')) AS t(view, source) UNION ALL SELECT '-', 99, 'gone'")
def reconciled_streams(spark, sf_dir):
    """Which streams to start, stop and keep: one runs as it should, one of a view that is gone."""
    running = [Stream(stream_id("prod", 1, "lineitem"), 1, "lineitem"), Stream(stream_id("prod", 99, "gone"), 99, "gone")]
    plan = reconcile(driver.schema(), driver.sources(sf_dir), "prod", running)
    found = [(sign, s.view, s.source) for sign, items in (("+", plan.start), ("-", plan.stop), ("=", plan.keep)) for s in items]
    return spark.createDataFrame(found, "sign string, view int, source string")


@_register("SELECT o_orderpriority AS order_priority, o_orderstatus AS order_status, count(*) AS row_count, round(sum(o_totalprice), 2) AS sum_total FROM orders GROUP BY 1, 2")
def backfill_steps(spark, sf_dir):
    """Back-fill in steps: tasks of two halves are mapped to text apart, combined to a row a key, and merged; a second merge changes nothing."""
    store, folder = _store(spark, metrics.EXACT), _folder(spark)
    spec = copy.deepcopy(driver.spec())
    spec.views = [v for v in spec.views if v.name == "order_stats"]
    store.schema = Schema(spec, driver.extractors())
    tag = _tag(store, "order_stats")
    table = driver.source_of(spark, sf_dir, "order_stats")
    for i in range(2):
        table.where(F.pmod("o_orderkey", F.lit(2)) == i).write.parquet(f"{folder}/in/{i}")
        history = Sources(Source("history", f"{folder}/in/{i}", labels={"table": "orders"}))
        tasks = backfill.loads(backfill.dumps(backfill.specify(spark, store.schema, history, {(tag, "history"): float("inf")})))
        backfill.map_tasks(spark, store.schema, history, tasks, f"{folder}/mapped-{i}")
    backfill.combine(spark, store.schema, [f"{folder}/mapped-{i}/*" for i in range(2)], f"{folder}/combined")
    if [backfill.load(store, [f"{folder}/combined/*"], "job")[tag] for _ in range(2)] != [True, False]:
        raise AssertionError("a job was merged twice, or not at all")
    return _shown(store.query(_spec("order_stats", ["order_priority", "order_status"], ["row_count", "sum_total"]), NOW))


@_register("SELECT 'schema update' AS step, '1' AS outcome UNION ALL SELECT 'backfill load', 'view=8 loaded' UNION ALL SELECT 'backfill load again', 'view=8 ignored' UNION ALL SELECT 'query', s_nationkey || chr(9) || count(*) FROM supplier GROUP BY s_nationkey")
def command_line(spark, sf_dir):
    """The commands, from a schema's first revision to the lines of an answer."""
    from tallyloom.cli import main

    app = pytypes.ModuleType("tallyloom_command_line_app")
    app.extractors, app.sources = driver.extractors, lambda: driver.sources(sf_dir)
    sys.modules[app.__name__] = app
    # Specifications are local files of whoever calls the command.
    with tempfile.TemporaryDirectory() as local:
        put = lambda name, text: (open(f"{local}/{name}", "w").write(text), f"{local}/{name}")[1]  # noqa: E731, SIM115
        root = _folder(spark)

        def run(*args: str) -> list[str]:
            out = io.StringIO()
            main(["--root", root, "--instance", "prod", "--app", app.__name__, *args], spark, out)
            return out.getvalue().splitlines()

        found = [("schema update", x) for x in run("schema", "update", "--path", put("schema.yaml", dumps(driver.spec())), "--revision", "0")]
        starts = put("starts.json", json.dumps([{"view": "supplier_stats", "source": "supplier", "until": 9e12}]))
        tasks = put("tasks", "\n".join(run("backfill", "specify", "--name", "job", "--starts", starts)))
        for step in ("backfill load", "backfill load again"):
            found += [(step, x) for x in run("backfill", "load", "--name", "job", "--path", tasks)]
        ask = put("query.yaml", dumps(_spec("supplier_stats", ["supp_nation"], ["row_count"])))
        found += [("query", x) for x in run("query", "--path", ask)]
    return _cases(spark, found)

