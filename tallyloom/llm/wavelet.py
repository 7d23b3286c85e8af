"""Token ids in wavelet matrices, one compressed file per shard.

A shard holds the ids of some documents in ascending order of doc_id. Level l of its matrix has bit (levels - 1 - l) of every
id, in an order where each level's zeros precede its ones. Bits are kept in compressed blocks, under a directory in two steps: the ones
before each block, and in each block the ones before each of its stretches. Rank counts the bits of one stretch, select searches both
steps, so access, rank, count and select read the directory once and then a block a level: with WaveletMatrix.open() only these ranges
of the file are read. ids(), ranks() and positions() answer for many places at once, from whole bit-planes.

File: 8 bytes of magic, 8 bytes of header length, header (JSON: n, levels, type, ones of each level, place and size of the parts),
doc ids and lengths, directory (per level and block: ones before, place, size; then the counts of stretches), blocks.

Null texts count as empty: only the end id. Null ids come first in the order; rows that share an id are kept, in the order of a hash of their texts, so that
one id with many texts spans shards. Other columns are ignored. An empty table makes no shard, and no row comes back.

Shards are written and read in Python workers by pyarrow's file systems: the shared folder must be one that they know (a local or mounted folder, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import fresh, ready
from tallyloom.llm.tokens import END_ID, TextEncoder

MAGIC = b"TLWMTX02"
BLOCK, STRETCH = 1 << 16, 1 << 11  # bits
PIECE = 1 << 15  # ids that are dealt to the next level at a time: they fit a core's cache
KEPT = 600_000  # pieces of text whose ids a worker keeps
NULL_ID = -(1 << 63)
MANIFEST = "part int, shard int, path string, n_docs long, n_tokens long"


class WaveletMatrix:
    """Access, rank and select over a sequence of ids, from the bytes of one file or from a function read(at, size)."""

    def __init__(self, data: bytes | Callable[[int, int], bytes]):
        self.read = data if callable(data) else lambda at, size, held=memoryview(data): held[at : at + size]
        first = bytes(self.read(0, 16))
        if first[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size = int.from_bytes(first[8:16], "little")
        head = json.loads(bytes(self.read(16, size)))
        self.base, self.n, self.levels, self.type, self.docs = 16 + size, head["n"], head["levels"], np.dtype(head["type"]), head["docs"]
        self.zeros = [self.n - x for x in head["ones"]]
        blocks, stretches = -(-self.n // BLOCK), BLOCK // STRETCH
        raw = self._raw(head["directory"])
        cut = 3 * 8 * self.levels * blocks
        self.before, self.at, self.size = np.frombuffer(raw[:cut], "<i8").reshape(3, self.levels, blocks)
        self.inside = np.frombuffer(raw[cut:], "<u2").reshape(self.levels, blocks, stretches)
        self.kept: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    @contextmanager
    def open(path: str):
        """The matrix of a file, of which only the ranges that a question needs are read."""
        store, at = _open(path)
        with store.open_input_file(at) as f:
            yield WaveletMatrix(lambda at, size: f.read_at(size, at))

    @staticmethod
    def build(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], levels: int = 16) -> bytes:
        x, y, body, at = ids.copy(), np.empty_like(ids), [], 0
        pack = zstandard.ZstdCompressor(level=1)
        blocks = -(-len(ids) // BLOCK)
        entry = np.zeros((3, levels, blocks), "<i8")
        inside = np.zeros((levels, blocks, BLOCK // STRETCH), "<u2")

        def put(raw: bytes) -> list[int]:
            nonlocal at
            body.append(pack.compress(raw))
            at += len(body[-1])
            return [at - len(body[-1]), len(body[-1])]

        docs = [put(np.array([NULL_ID if d is None else d for d in doc_ids], "<i8").tobytes()), put(np.array(lengths, "<i8").tobytes())]
        ones = []
        for level in range(levels):
            bit = (x & x.dtype.type(1 << (levels - 1 - level))) != 0
            raw = np.packbits(bit, bitorder="little")
            each = np.zeros(blocks * (BLOCK // STRETCH), np.int64)
            each[: -(-len(raw) // (STRETCH // 8))] = np.add.reduceat(np.bitwise_count(raw), np.arange(0, len(raw), STRETCH // 8), dtype=np.int64) if len(raw) else 0
            each = each.reshape(blocks, BLOCK // STRETCH)
            inside[level] = np.cumsum(each, axis=1) - each
            entry[0, level] = np.cumsum(each.sum(1)) - each.sum(1)
            for k in range(blocks):
                entry[1:, level, k] = put(raw[k * (BLOCK // 8) : (k + 1) * (BLOCK // 8)].tobytes())
            ones.append(int(each.sum()))
            zero, one = 0, len(x) - ones[-1]
            for i in range(0, len(x), PIECE):
                part, bits = x[i : i + PIECE], bit[i : i + PIECE]
                high, low = np.flatnonzero(bits), np.flatnonzero(~bits)
                part.take(low, out=y[zero : zero + len(low)], mode="clip")
                part.take(high, out=y[one : one + len(high)], mode="clip")
                zero, one = zero + len(low), one + len(high)
            x, y = y, x
        directory = put(entry.tobytes() + inside.tobytes())
        head = json.dumps({"n": len(ids), "levels": levels, "type": ids.dtype.str, "docs": docs, "directory": directory, "ones": ones}).encode()
        return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *body])

    def _raw(self, place) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.read(self.base + int(place[0]), int(place[1])))

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        ids, lengths = (np.frombuffer(self._raw(x), "<i8") for x in self.docs)
        return [None if d == NULL_ID else d for d in ids.tolist()], lengths

    # One place at a time, by blocks.

    def _block(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self.kept:
            self.kept[level, k] = np.frombuffer(self._raw((self.at[level, k], self.size[level, k])), np.uint8)
        return self.kept[level, k]

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a level."""
        if i >= self.n:
            return self.n - self.zeros[level]
        k, r = divmod(i, BLOCK)
        s, byte = r // STRETCH, r // 8
        raw = self._block(level, k)
        last = int(raw[byte]) & ((1 << r % 8) - 1) if r % 8 else 0
        return int(self.before[level, k]) + int(self.inside[level, k, s]) + int(np.bitwise_count(raw[s * (STRETCH // 8) : byte]).sum(dtype=np.int64)) + last.bit_count()

    def _bit(self, level: int, i: int) -> int:
        return int(self._block(level, i // BLOCK)[i % BLOCK // 8]) >> i % 8 & 1

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._ones(level, i)
            out = out << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return out

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        """Of the last level: where symbol starts, and where its occurrences among the first i end."""
        lo = 0
        for level in range(self.levels):
            a, b, zeros = self._ones(level, lo), self._ones(level, i), self.zeros[level]
            lo, i = (zeros + a, zeros + b) if symbol >> (self.levels - 1 - level) & 1 else (lo - a, i - b)
        return lo, i

    def rank(self, symbol: int, i: int) -> int:
        """How often symbol occurs among the first i ids."""
        if symbol >> self.levels:
            return 0
        lo, hi = self._range(symbol, min(i, self.n))
        return hi - lo

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """The place of occurrence k (from 0) of symbol."""
        if symbol >> self.levels:
            raise IndexError(k)
        lo, hi = self._range(symbol, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in reversed(range(self.levels)):
            bit = symbol >> (self.levels - 1 - level) & 1
            at = self._nth(level, bit, at - self.zeros[level] if bit else at)
        return at

    def _nth(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th one or zero of a level: its block, its stretch, then its bit."""
        starts = self.before[level] if bit else np.arange(len(self.before[level])) * BLOCK - self.before[level]
        b = int(np.searchsorted(starts, k, side="right")) - 1
        k -= int(starts[b])
        inside = self.inside[level, b].astype(np.int64)
        inside = inside if bit else np.arange(len(inside)) * STRETCH - inside
        s = int(np.searchsorted(inside, k, side="right")) - 1
        bits = np.unpackbits(self._block(level, b)[s * (STRETCH // 8) : (s + 1) * (STRETCH // 8)], bitorder="little")
        return b * BLOCK + s * STRETCH + int(np.flatnonzero(bits == bit)[k - int(inside[s])])

    # Many places at a time, by planes.

    def _plane(self, level: int) -> np.ndarray:
        return np.frombuffer(b"".join(self._raw(x) for x in zip(self.at[level], self.size[level])), np.uint8)

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self._plane(level), count=self.n, bitorder="little").view(bool)

    def ids(self) -> np.ndarray:
        """All ids, from the last level up."""
        x, y = np.zeros(self.n, self.type), np.empty(self.n, self.type)
        for level in reversed(range(self.levels)):
            bits, zero, one = self._bits(level), 0, self.zeros[level]
            x[one:] |= self.type.type(1 << (self.levels - 1 - level))
            for i in range(0, self.n, PIECE):
                part = y[i : i + PIECE]
                high, low = np.flatnonzero(bits[i : i + PIECE]), np.flatnonzero(~bits[i : i + PIECE])
                part[low], part[high] = x[zero : zero + len(low)], x[one : one + len(high)]
                zero, one = zero + len(low), one + len(high)
            x, y = y, x
        return x

    def ranks(self, symbol: int, places: np.ndarray) -> np.ndarray:
        """rank() at each of many places."""
        at = np.concatenate(([0], np.minimum(places, self.n))).astype(np.int64)
        if symbol >> self.levels:
            return np.zeros(len(places), np.int64)
        for level in range(self.levels):
            raw = self._plane(level)
            words = np.frombuffer(raw.tobytes() + bytes(16 - len(raw) % 8), "<u8")
            before = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
            ones = before[at >> 6] + np.bitwise_count(words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = self.zeros[level] + ones if symbol >> (self.levels - 1 - level) & 1 else at - ones
        return at[1:] - at[0]

    def positions(self, symbol: int) -> np.ndarray:
        """select() of every occurrence of symbol, ascending."""
        if symbol >> self.levels:
            return np.empty(0, np.int64)
        lo, hi = self._range(symbol, self.n)
        at = np.arange(lo, hi)
        for level in reversed(range(self.levels) if hi > lo else ()):
            bit = symbol >> (self.levels - 1 - level) & 1
            at = np.flatnonzero(self._bits(level) == bit)[at - self.zeros[level] if bit else at]
        return at


def _open(path: str):
    """(file system, path in it) of a URI that pyarrow knows, or of a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_shards(docs: DataFrame, tokenizer: str, out: str, shard_tokens: int = 1 << 21) -> DataFrame:
    """Writes docs(doc_id, text) as shards under out, and returns their manifest (MANIFEST), itself a table under out.

    Documents are dealt by ranges of doc_id and sorted in each. An attempt names its files afresh, and the manifest has only
    those of the attempt that Spark committed, so a task that is lost or runs twice leaves at most unread files.
    """
    ready(spark := docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        part, shard, encoder = TaskContext.get().partitionId(), 0, TextEncoder.of(tokenizer, KEPT)
        levels = max(1, max(END_ID, encoder.tokenizer.get_vocab_size() - 1).bit_length())
        store, root = _open(out)
        store.create_dir(root, recursive=True)
        doc_ids, ids, held = [], [], 0
        end = np.array([END_ID], encoder.type)

        def flush():
            nonlocal shard, doc_ids, ids, held
            path = f"{root}/{part:06d}-{shard:04d}-{uuid.uuid4().hex}.wm"
            with store.open_output_stream(path) as f:
                f.write(WaveletMatrix.build(np.concatenate(ids), doc_ids, [len(x) for x in ids], levels))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "path": [f"{out}/{path.rpartition('/')[2]}"], "n_docs": [len(doc_ids)], "n_tokens": [held]})
            shard, doc_ids, ids, held = shard + 1, [], [], 0
            return row

        for b in batches:
            for doc, got in zip(b.column(0).to_pylist(), encoder.encode(b.column(1))):
                doc_ids.append(doc)
                ids.append(np.concatenate((got, end)))
                held += len(got) + 1
                if held >= shard_tokens:
                    yield flush()
        if doc_ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{out}/manifest")
    return read_manifest(spark, out)


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


def starts(manifest: DataFrame) -> DataFrame:
    """manifest with start: the ids of all shards before it. The sums over partitions have one row for each; those over shards run in each partition."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = parts.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before"))
    inside = manifest.withColumn("inside", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens"))
    return inside.join(before, "part").select(*manifest.columns, (F.col("before") + F.col("inside")).alias("start"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32, and n_ends: how often the end id's number occurs among its ids, by rank."""

    def run(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                store, at = _open(path)
                with store.open_input_stream(at) as f:
                    matrix = WaveletMatrix(f.read())
                ids, (docs, lengths) = matrix.ids().astype("<u4"), matrix.documents()
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                found = matrix.ranks(END_ID, ends)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64()), pa.array(np.diff(found, prepend=0))], ["doc_id", "start", "n_tokens", "ids_crc32", "n_ends"])

    dealt = starts(manifest).select("path", "start")
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_ends long")


def occurrences(manifest: DataFrame, symbol: int) -> DataFrame:
    """Every place of an id, looked up in the shards: doc_id, at (from 0, in the document)."""

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                with WaveletMatrix.open(path) as matrix:
                    places, (docs, lengths) = matrix.positions(symbol), matrix.documents()
                ends = np.cumsum(lengths)
                of = np.searchsorted(ends, places, side="right")
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()).take(pa.array(of)), pa.array(places - (ends - lengths)[of])], ["doc_id", "at"])

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(parts).mapInArrow(run, "doc_id long, at long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    out = fresh(docs.sparkSession, "wavelet")
    return read_shards(write_shards(docs, tokenizer, out))
