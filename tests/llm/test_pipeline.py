"""The pipeline against a brute-force version, stage by stage, and the registered queries that have SQL."""

import random

import duckdb
import pytest

import cases
import corpus_pipeline
from tallyloom.llm import queries
from test_lines import brute as brute_lines
from test_packing import expected_pieces
from test_pairs import ITEM, OTHER, changed, jaccard, shingles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("sf"), random.Random(12)
    rows = [(i, cases.prose(rng, rng.choice([20, 90, 300])), "en", f"src{i % 3}", 0) for i in range(120)]
    rows += [(1000 + i, changed(rng, rows[i % 5][1], i % 2), "en", "src0", 0) for i in range(20)]
    rows += [(2000 + i, f"{cases.prose(rng, 40)}\n{[ITEM, OTHER][i % 2]}\n{cases.prose(rng, 40)}", "en", "src1", 0) for i in range(6)]
    rows += [(3000 + i, f"{cases.prose(rng, 40)}\nSubscribe now!\n{cases.prose(rng, 40)}", "en", "src1", 0) for i in range(11)]
    rows += [r for r in cases.rows() if r[0] is None or r[0] in (0, 200, 201, 202, 203, 400, 401, 402)]
    spark.createDataFrame(rows, cases.SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, OTHER)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        seen[name] = [tuple(r) for r in out.collect()]
        if name != "packing":
            assert out.columns == columns
            docs = spark.createDataFrame(seen[name], cases.SCHEMA)
    key = lambda r: (r[0], r[1])
    spoken = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert sorted(map(key, seen["language_id"]), key=repr) == sorted(map(key, spoken), key=repr)
    lines = brute_lines(spoken, 10)
    assert sorted(map(key, seen["line_dedup"]), key=repr) == sorted(((d, t) for d, _, _, t in lines), key=repr)
    assert all(r[4] == len(r[1]) for r in seen["line_dedup"]) and not any("Subscribe" in r[1] for r in seen["line_dedup"])
    before, kept = [key(r) for r in seen["line_dedup"]], [key(r) for r in seen["near_dedup"]]
    sets = {t: shingles(t) for _, t in before}
    assert all(max(jaccard(sets[t], sets[u]) for _, u in kept) >= 0.65 for _, t in before)  # each has one like it that stays
    texts = [t for _, t in kept]
    assert max(jaccard(sets[t], sets[u]) for i, t in enumerate(texts) for u in texts[:i]) < 0.85
    dropped = set(before) - set(kept)
    assert all(max(jaccard(sets[t], sets[u]) for e, u in before if (e, u) != (d, t)) >= 0.65 for d, t in dropped)
    assert sorted(map(key, seen["decontamination"]), key=repr) == sorted((k for k in kept if ITEM not in k[1] and OTHER not in k[1]), key=repr)
    assert sorted((r[:5] for r in seen["packing"]), key=repr) == expected_pieces(seen["decontamination"], 4096)


def test_run(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        docs = spark.createDataFrame(out.collect(), out.schema)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert cases.tuples(corpus_pipeline.run(spark, path).select(*columns)) == cases.tuples(docs.select(*columns))


def test_empty_input(spark, folder):
    path, _ = folder
    docs = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert docs.count() == 0


def test_clashing_columns(spark, folder):
    path, _ = folder
    docs = cases.frame(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and {r.score for r in out.collect()} == {"score"}, name
        docs = spark.createDataFrame(out.collect(), docs.schema)


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert cases.tuples(got.select(*columns)) == sorted(want, key=repr)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE])
def test_query_without_sql_has_its_columns(spark, sf_dir, name):
    columns = {
        "op3": {"doc_id", "perplexity", "kept"},
        "op4": {"doc_id", "held_out", "lang_pred", "score"},
        "op5": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
        "op6": {"doc_id", "item_id"},
        "op7": {"doc_id", "start", "n_tokens", "ids_crc32"},
        "op9": {"doc_id", "fingerprint", "component_id"},
        "op10": {"vec_id", "n_links", "component_id", "kept"},
    }
    got = queries.QUERIES[name](spark, sf_dir)
    assert columns[name.partition("_")[0]] <= set(got.columns) and got.count() > 0
