"""The driver's tables as relations: the schema of driver_schema.yaml with its extractors."""

from __future__ import annotations

from functools import cache, reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tallyloom.functions.words import word_rows
from tallyloom.schema import Extractors, Schema
from tallyloom.sources.registry import Source, Sources
from tallyloom.types import SchemaSpec, loads

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def extractors() -> Extractors:
    """Tags as in driver_schema.yaml. Columns are SQL, so they can be made without a session."""
    return Extractors(
        new_source=lambda df: df,
        mappings={1: lambda df: df, 2: lambda df: df, 3: lambda df: word_rows(df, "text"), 4: lambda df: word_rows(df, "text")},
        ints={1: "1", 17: "l_linenumber", 31: "c_nationkey", 40: "p_size", 50: "n_nationkey", 52: "n_regionkey", 53: "s_nationkey", 61: "user_id", 63: "event_id", 70: "doc_id", 73: "word_count", 74: "first_count"},
        floats={13: "l_extendedprice", 14: "l_quantity", 15: "l_extendedprice * (1 - l_discount)", 23: "o_totalprice", 32: "c_acctbal", 42: "p_retailprice", 54: "s_acctbal", 64: "value"},
        strings={10: "l_returnflag", 11: "l_linestatus", 16: "CAST(l_partkey AS STRING)", 20: "o_orderpriority", 21: "o_orderstatus", 30: "c_mktsegment", 41: "p_brand", 51: "n_name", 60: "event_type", 66: "CAST(user_id AS STRING)", 71: "lang", 72: "word", 80: "role", 81: "CAST(conv_id AS STRING)"},
        times={12: "date_trunc('month', l_shipdate)", 22: "date_trunc('day', o_orderdate)", 62: "ts", 65: "date_trunc('day', ts)"},
        order_by={2: ["unix_micros(CAST(ts AS TIMESTAMP))", "event_id"]},
    )


@cache
def spec() -> SchemaSpec:
    return loads(SchemaSpec, Path(__file__).with_name("driver_schema.yaml").read_text(encoding="utf-8"))


def schema() -> Schema:
    return Schema(spec(), extractors())


def sources(sf_dir: str) -> Sources:
    return Sources(*(Source(t, f"{sf_dir}/{t}.parquet", labels={"table": t}) for t in TABLES))


def source_of(spark: SparkSession, sf_dir: str, view: str, of: Schema | None = None) -> DataFrame:
    """The rows that a view's relation selects, of all its sources."""
    of = of or schema()
    found = sources(sf_dir).select(of.relation(of.view(view).relation).selector)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (s.read(spark) for s in found))
