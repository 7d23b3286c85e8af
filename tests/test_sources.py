"""Text, frames and the command line."""

import io
import json
import sys
import types as pytypes

import pytest

from quotes import QUOTES, SCHEMA, SPEC, extractors, tuples
from tallyloom.cli import main
from tallyloom.sources import keyvalue, tsv
from tallyloom.sources.registry import Source, Sources


def test_quotes_file(spark, tmp_path):
    lines = [f"author {i % 3}\ttext {i}" if i != 5 else "no tab" for i in range(300)]
    (tmp_path / "q.txt").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        got = tuples(tsv.read_quotes(spark, str(tmp_path / "q.txt")).orderBy("id"))
        assert got == [(i, f"author {i % 3}", f"text {i}") for i in range(300) if i != 5]
        assert [r[0] for r in tuples(tsv.read_quotes(spark, str(tmp_path / "q.txt"), 4, 8).orderBy("id"))] == [4, 6, 7]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_tsv_out(spark, tmp_path):
    df = spark.sql("SELECT 'a' AS x, 1L AS y, 2.0D AS z, 0.1D AS w, timestamp'2024-01-01 00:00:01.5' AS t, CAST(NULL AS STRING) AS n")
    assert list(tsv.rows_as_tsv(df)) == ["a\t1\t2\t0.1\t2024-01-01 00:00:01.5 +0000 UTC\t"]
    tsv.write_tsv(df.select("x", "y"), str(tmp_path / "o"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "o")).collect()] == ["a\t1"]


def test_hex(spark, tmp_path):
    pairs = [(b"\x00\xff", b"v"), (b"", b""), (b"k" * 5000, b"\t\n")]
    keyvalue.write_hex(spark.createDataFrame(pairs, "key binary, value binary"), str(tmp_path / "h"))
    assert [r[0].split("\t")[0] for r in spark.read.text(str(tmp_path / "h")).collect()] == sorted(k.hex() for k, _ in pairs)
    assert sorted((bytes(k), bytes(v)) for k, v in tuples(keyvalue.read_hex(spark, str(tmp_path / "h")))) == sorted(pairs)
    (tmp_path / "torn").write_text("00ff\t76\n00f")
    with pytest.raises(Exception, match="unexpected end of record: 00f"):
        keyvalue.read_hex(spark, str(tmp_path / "torn")).collect()


def test_frames():
    pairs = [(b"key", b"value"), (b"", b""), (b"k", b"v" * 1000)]
    out = io.BytesIO()
    keyvalue.write_frames(pairs, out)
    assert out.getvalue()[:8] == b"\0\0\0\x03\0\0\0\x05"
    assert list(keyvalue.read_frames(io.BytesIO(out.getvalue()))) == pairs
    with pytest.raises(keyvalue.TornRecord):
        list(keyvalue.read_frames(io.BytesIO(out.getvalue()[:-1])))
    with pytest.raises(keyvalue.TornRecord):
        list(keyvalue.read_frames(io.BytesIO(out.getvalue()[:4])))
    with pytest.raises(ValueError, match="beyond 10"):
        list(keyvalue.read_frames(io.BytesIO(out.getvalue()), cap=10))
    with pytest.raises(ValueError, match="beyond 10"):
        keyvalue.frame(b"x" * 11, b"", cap=10)


def test_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("".join(json.dumps({"id": i, "author": a, "text": t, "time": "2024-01-01T00:00:00Z"}) + "\n" for i, a, t in QUOTES))
    app = pytypes.ModuleType("quotes_app")
    app.extractors = extractors
    app.sources = lambda: Sources(Source("quotes", f"file://{folder}", "json", SCHEMA, {"kind": "quote"}))
    sys.modules["quotes_app"] = app
    (tmp_path / "schema.yaml").write_text(SPEC)
    (tmp_path / "query.yaml").write_text("{materialized_view: quote_stats, view: {dimensions: [author], metrics: [sum_words, unique_words]}}")

    def run(*args):
        out = io.StringIO()
        assert main(["--root", f"file://{tmp_path}/root", "--instance", "prod", "--app", "quotes_app", *args], spark, out) == 0
        return out.getvalue()

    assert run("schema", "update", "--path", f"{tmp_path}/schema.yaml", "--revision", "0") == "1\n"
    assert "word_stats" in run("schema", "get")
    plan = run("sync", "--apply", f"{tmp_path}/running.json")
    assert plan.count("+ ") == 3 and run("sync", "--running", f"{tmp_path}/running.json").count("= ") == 3
    (tmp_path / "starts.json").write_text(json.dumps([{"view": "quote_stats", "source": "quotes", "until": 9e12}]))
    (tmp_path / "tasks").write_text(run("backfill", "specify", "--name", "pony", "--starts", f"{tmp_path}/starts.json", "--max-age", "6h"))
    assert run("backfill", "load", "--name", "pony", "--path", f"{tmp_path}/tasks") == "view=2 loaded\n"
    assert run("backfill", "load", "--name", "pony", "--path", f"{tmp_path}/tasks") == "view=2 ignored\n"
    assert run("query", "--path", f"{tmp_path}/query.yaml") == "Doe Jane\t5\t2\nJohn Doe\t4\t3\n"
    run("ingest", "--view", "word_stats", "--source", "quotes", "--checkpoint", f"{tmp_path}/check")
    (tmp_path / "query.yaml").write_text("{materialized_view: word_stats, view: {dimensions: [word], metrics: [sum_words]}}")
    run("vacuum")
    assert run("query", "--path", f"{tmp_path}/query.yaml") == "four\t1\none\t5\ntwo\t3\n"
