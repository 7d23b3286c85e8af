"""Line dedup against a few lines of Python."""

from collections import Counter

import pytest

import cases
from tallyloom.llm import line_dedup
from tallyloom.llm.common import WS

_UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs):
    split = [(r[0], (r[1] or "").split("\n")) for r in rows]
    key = lambda line: line.strip(WS).translate(_UP)
    held = Counter(k for _, lines in split for k in {key(x) for x in lines} if k)
    out = []
    for doc, lines in split:
        kept = [x for x in lines if held[key(x)] < min_docs]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs, batches, fanout", [(10, 3, 3), (4, 1, 2), (2, 7, 2), (5, 5, 3)])
def test_against_brute_force(spark, min_docs, batches, fanout):
    got = line_dedup.dedup_lines(cases.frame(spark), min_docs=min_docs, batches=batches, fanout=fanout)
    assert got.columns[-3:] == ["n_lines", "n_dropped", "kept_text"] and "Line" in got.columns
    assert cases.tuples(got.select("doc_id", "n_lines", "n_dropped", "kept_text")) == brute(cases.rows(), min_docs)


def test_a_salted_join_gives_the_same(spark):
    docs = spark.createDataFrame([(i, f"hot\nonly {i}\n  HOT\t") for i in range(300)] + [(None, "hot"), (300, None)], "doc_id long, text string")
    got = line_dedup.dedup_lines(docs, bound=0)
    assert cases.tuples(got.select("doc_id", "n_lines", "n_dropped", "kept_text")) == brute([tuple(r) for r in docs.collect()], 10)


def test_batches_added_one_by_one(spark):
    """What later batches bring counts with what is there, and runs are compacted on the way."""
    docs = spark.createDataFrame([(i, f"common\nonly {i}\n" + ("rare" if i % 4 == 0 else "")) for i in range(16)], "doc_id long, text string")
    runs = line_dedup.LineRuns(spark, min_docs=4, fanout=2)
    for i in range(5):
        runs.add(line_dedup.line_keys(docs.where(f"doc_id % 5 = {i}")).select("h1", "h2", "n"))
    assert runs.settled().count() == 2 and max(len(x) for x in runs.levels) < 2


def test_long_minimum(spark):
    docs = spark.createDataFrame([(i, "ab\nabc") for i in range(4)], "doc_id long, text string")
    assert {r.kept_text for r in line_dedup.dedup_lines(docs, min_docs=2, min_chars=3).collect()} == {"ab"}


def test_empty_table(spark):
    assert line_dedup.dedup_lines(cases.empty(spark)).count() == 0
