"""python bench.py: times the engine's headline queries and prints one line of JSON.

Tables come from $BENCH_SF_DIR (default /root/testdata/sf0.1), the session is local[$BENCH_CPUS]. A query's time is the median of three warm
runs that write every row to Spark's no-op sink; `raw` is the same question asked of the raw table by plain DataFrame code, for comparison.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = 3


def timed(make) -> float:
    def once() -> float:
        began = time.perf_counter()
        out = make()
        if isinstance(out, DataFrame):
            out.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    once()
    return round(statistics.median(once() for _ in range(RUNS)), 3)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='bench-')}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tallyloom.operators.query import resolve
    from tallyloom.plans import driver, registry
    from tallyloom.plans.store import ViewStore
    from tallyloom.types import Filter, QuerySpec, StringRange, ViewSpec

    names = ("sum_float_prefix", "sum_float_nonprefix", "filter_multi_dim", "gauge_last_value", "hll_accuracy", "hll_exact_accuracy", "map_words", "doc_stats", "two_level_merge", "stream_ingest")
    seconds = {n: timed(lambda n=n: registry.QUERIES[n](spark, sf_dir)) for n in names}

    root = f"{spark.conf.get('spark.checkpoint.dir')}/view"
    store = ViewStore(spark, root, driver.schema())
    tag, lines = store.schema.view("line_stats").tag, driver.source_of(spark, sf_dir, "line_stats")
    epochs = iter(range(RUNS + 2))
    seconds["view_build"] = timed(lambda: store.ingest(tag, lines, "bench", next(epochs)))
    store.compact(tag, whole=True)

    def ask(dims, *filters):
        return lambda: store.execute(resolve(store.schema, QuerySpec("line_stats", ViewSpec(dims, ["row_count", "sum_price"]), list(filters))))

    seconds["stored_prefix"] = timed(ask(["return_flag"]))
    seconds["stored_nonprefix"] = timed(ask(["line_status"]))
    seconds["stored_filtered"] = timed(ask(["line_status"], Filter("return_flag", strings=[StringRange("N", "R")])))
    seconds["raw_table"] = timed(lambda: lines.groupBy("l_returnflag").agg(F.count("*"), F.sum("l_extendedprice")).orderBy("l_returnflag"))
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
