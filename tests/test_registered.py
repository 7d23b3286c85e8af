"""Every registered query of the engine against its SQL in DuckDB."""

import math

import duckdb
import pytest

from tallyloom.plans import driver, registry


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for table in driver.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def plain(rows):
    return sorted((tuple(round(x, 2) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLE])
def test_query_equals_sql(spark, db, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE[name]})")
    assert plain(got.select(*columns).collect()) == plain(want.fetchall())


def test_estimates_by_registers(spark, db, sf_dir):
    true = dict(db.sql("SELECT event_type, count(DISTINCT user_id) FROM events GROUP BY 1").fetchall())
    got = {r[0]: r[1] for r in registry.hll_exact_estimates(spark, sf_dir).collect()}
    assert got.keys() == true.keys() and all(math.isclose(got[k], true[k], rel_tol=0.03) for k in true)


def test_flagship(spark):
    df = registry.entry(spark)
    assert df.columns == ["lang", "doc", "doc_count", "row_count", "total_words"] and df.count() > 0


def test_the_library_does_not_need_the_language_model_part():
    import pathlib
    import re

    root = pathlib.Path(registry.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"tallyloom\.llm|corpus_pipeline", path.read_text()), path
