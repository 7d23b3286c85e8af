"""Embedding near-duplicates by cross-polytope hashing with multiprobe buckets.

Each table turns a unit vector by fast Hadamard rotations (three rounds of random signs and a Walsh-Hadamard transform) and names
the nearest corner of the cross-polytope, `depth` times over; besides the nearest bucket a vector joins the next nearest ones
(the corners that lose least). Depth follows the number of classes, so that buckets stay small. Members of a bucket are compared in
full, in double precision, in blocks: a bucket of many members is split into blocks of about `block` and each pair of
blocks is a unit of work, so a bucket of any size is compared whole and no task holds more than two blocks. A pair that meets
in several buckets counts only in the first that both share.

Equal vectors are one class, compared once. Vectors that are null, empty, zero or hold null or non-finite components link with
nothing, not even with their equals; vectors of different lengths never link. Repeated vec_ids are rows like others; a component's id is its least
non-null vec_id. Labels and other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import ready, save
from tallyloom.llm.components import components, unite

FOUND = "kind int, node long, n long, root long"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate((y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]), axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def memberships(x: np.ndarray, tables: int, probes: int, depth: int, seed: int = 11) -> np.ndarray:
    """Unit rows -> (rows, tables, probes) bucket numbers, the nearest bucket first."""
    n, dim = x.shape
    d = max(2, 1 << (dim - 1).bit_length())
    padded = np.zeros((n, d))
    padded[:, :dim] = x
    r = np.random.default_rng([seed, dim])
    width = min(d, probes)
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        code, loss = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for _ in range(depth):
            y = padded
            for _ in range(3):
                y = hadamard(y * r.choice((-1.0, 1.0), d))
            near = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :width]
            v = np.take_along_axis(y, near, 1)
            corner, lost = near * 2 + (v < 0), (np.abs(v[:, :1]) - np.abs(v)) ** 2
            code = (code[:, :, None] * (2 * d) + corner[:, None, :]).reshape(n, -1)
            loss = (loss[:, :, None] + lost[:, None, :]).reshape(n, -1)
            best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
            code, loss = np.take_along_axis(code, best, 1), np.take_along_axis(loss, best, 1)
        if code.shape[1] < probes:
            code = np.pad(code, ((0, 0), (0, probes - code.shape[1])), mode="edge")
        out[:, t] = code
    return out


def _matrix(column: pa.Array) -> list[np.ndarray | None]:
    return [np.asarray(v, np.float64) for v in column.to_pylist()]


def depth_for(classes: int, dim: int, bucket: int = 8) -> int:
    """So many hashes a table that buckets hold about `bucket` vectors if they are spread evenly."""
    return max(1, math.ceil(math.log(max(2, classes / bucket)) / math.log(2 * max(2, dim))))


def probes_for(depth: int) -> int:
    """Buckets that a vector joins in each table: 2, and twice as many with each hash beyond the second, so that recall holds as the corpus
    grows (for pairs of cosine 0.9 in 64 dimensions, by simulation with eight tables: 1.000, 0.996 and 0.993 at depths 1 to 3)."""
    return 2 ** max(1, depth - 1)


def links(classes: DataFrame, threshold: float = 0.9, tables: int = 8, probes: int | None = None, block: int = 1000) -> DataFrame:
    """classes(rep long, copies long, vec array<double>), distinct usable vectors: FOUND rows.

    kind 0: node links with n vectors of other classes, in part; kind 1: node is linked with root.
    """
    ready(spark := classes.sparkSession)
    size = classes.groupBy(F.size("vec").alias("dim")).count().collect()  # one row for each vector length
    depth = {r["dim"]: depth_for(r["count"], r["dim"]) for r in size}
    probes = probes or probes_for(max(depth.values(), default=1))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def buckets(batches):
        for b in batches:
            vecs = _matrix(b.column(2))
            for dim in sorted({len(v) for v in vecs}):
                rows = [i for i, v in enumerate(vecs) if len(v) == dim]
                x = np.array([vecs[i] for i in rows])
                x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares of any double finite
                m = memberships(x / np.linalg.norm(x, axis=1, keepdims=True), tables, probes, depth[dim])
                codes = pa.array(m.reshape(len(rows), -1).tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(rows), pa.int32()), *(b.column(k).take(pa.array(rows)) for k in (0, 1, 2)), codes], ["dim", "rep", "copies", "vec", "codes"])

    coded = save(classes.select("rep", "copies", "vec").mapInArrow(buckets, "dim int, rep long, copies long, vec array<double>, codes array<long>"), "coded")
    member = coded.select("dim", "rep", F.posexplode("codes").alias("at", "code")).select("dim", F.expr(f"at div {probes}").cast("int").alias("t"), "code", "rep").distinct()
    sizes = member.groupBy("dim", "t", "code").agg(F.count("*").alias("n")).where("n > 1")
    own = member.join(sizes, ["dim", "t", "code"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    work = own.select("rep", "dim", "t", "code", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    work = work.select("rep", "dim", "t", "code", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own")
    rows = work.join(coded.select("rep", "copies", "vec", "codes"), "rep")
    dealt = rows.repartition(parts, "dim", "t", "code", "a", "b").sortWithinPartitions("dim", "t", "code", "a", "b", "own", "rep")

    def compare(batches):
        key, held = None, []
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)).to_numpy() for c in ("dim", "t", "code", "a", "b")]
            keys = np.stack([c.astype(np.int64) for c in cols], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if (now := tuple(keys[lo].tolist())) != key:
                    if held:
                        yield from _compared(key, held, threshold, tables, probes)
                    key, held = now, []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from _compared(key, held, threshold, tables, probes)

    return dealt.select("dim", "t", "code", "a", "b", "own", "rep", "copies", "vec", "codes").mapInArrow(compare, FOUND)


def _compared(key, held, threshold, tables, probes):
    """The links of one bucket, or of one pair of its blocks."""
    _, t, code, first, second = key
    get = lambda c: np.concatenate([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for b in held])
    flat = lambda c: np.concatenate([b.column(b.schema.get_field_index(c)).flatten().to_numpy() for b in held])
    own, rep, copies = get("own"), get("rep"), get("copies")
    n = len(rep)
    if n < 2:
        return
    x, codes = flat("vec").reshape(n, -1), flat("codes").reshape(n, tables, probes)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    left, right = (np.flatnonzero(own == first), np.flatnonzero(own == second))
    counts, parent = np.zeros(n, np.int64), np.arange(n)
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        i, j = np.nonzero(x[rows] @ x[right].T >= threshold - 1e-12)
        i, j = rows[i], right[j]
        if first == second:
            keep = i < j
            i, j = i[keep], j[keep]
        for k in range(0, len(i), 100_000):
            p, q = i[k : k + 100_000], j[k : k + 100_000]
            keep = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
            p, q = p[keep], q[keep]
            unite(parent, p, q)
            for e in range(t):  # met before
                new = ~(codes[p, e][:, :, None] == codes[q, e][:, None, :]).any((1, 2))
                p, q = p[new], q[new]
            both = np.where((codes[p, t][:, :, None] == codes[q, t][:, None, :]).any(2), codes[p, t], np.iinfo(np.int64).max).min(1)
            p, q = p[both == code], q[both == code]
            counts += np.bincount(p, copies[q], n).astype(np.int64) + np.bincount(q, copies[p], n).astype(np.int64)
    some, child = np.flatnonzero(counts), np.flatnonzero(parent != np.arange(n))
    if len(some) + len(child):
        kind = np.repeat([0, 1], [len(some), len(child)])
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(rep[np.concatenate((some, child))]), pa.array(np.concatenate((counts[some], np.zeros(len(child), np.int64)))), pa.array(np.concatenate((rep[some], rep[parent[child]])))], ["kind", "node", "n", "root"])


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, tables: int = 8, probes: int | None = None, block: int = 1000) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    fine = F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    key = [F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit("second"), "vec").alias("k2")]
    good = rows.where("fine").select("vec_id", "vec", *key)
    # rep: a class's number, which need not be one of its ids.
    groups = good.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    classes = save(groups.withColumn("rep", F.col("k1")), "classes")
    found = save(links(classes, threshold, tables, probes, block), "found")
    others = found.where("kind = 0").groupBy("node").agg(F.sum("n").alias("others"))
    comp = components(found.where("kind = 1").select(F.col("node").alias("a"), F.col("root").alias("b")))
    of = classes.select("k1", "k2", "rep", "least", "copies").join(others, F.col("rep") == F.col("node"), "left").drop("node").join(comp, F.col("rep") == F.col("node"), "left").drop("node").withColumn("component", F.coalesce("component", "rep"))
    named = of.join(of.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    named = named.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    linked = good.select("vec_id", "k1", "k2").join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
