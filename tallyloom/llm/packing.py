"""Best-fit packing with certified bounds.

Documents become token ids with an end id; a document longer than a sequence is cut into full pieces and a rest. Full pieces
are sequences of their own. The others are packed by best-fit decreasing, each partition on its own, and every partition's
count of sequences is certified against lower bounds by dual feasible functions: if the count meets the bound, no packing of
that partition is better, otherwise the difference is its gap. The sequences that hold the slack then exchange documents:
the emptiest sequence of every partition, and as many of the next emptiest of partitions with a gap, are opened, dealt to fewer
partitions, and packed again, until one round runs in a single partition or opens nothing. What a round opens is a
fixed number of sequences for each partition, so rounds shrink geometrically and no task holds more than `per_part` pieces of a
round on average.

A null text counts as an empty one: one piece that holds only the end id. Repeated rows are packed as often as they occur; null
ids are kept. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import drop, ready, save, union
from tallyloom.llm.tokens import END_ID, TextEncoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, seq string, offset long, used long, bound long, total long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096) -> DataFrame:
    """One row per piece of at most capacity ids: PIECES."""
    ready(docs.sparkSession)

    def run(batches):
        encoder = TextEncoder.of(tokenizer)
        for b in batches:
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1))):
                raw = np.append(ids.astype("<u4"), np.uint32(END_ID)).astype("<u4")
                rows += [(doc, k, at, len(cut := raw[at : at + capacity]), zlib.crc32(cut.tobytes())) for k, at in enumerate(range(0, len(raw), capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of the volume bound and of two families of dual feasible functions, over every threshold that can matter."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((n * size).sum()) // capacity)
    # u_e: over capacity - e counts whole, under e counts nothing, the rest as it is.
    count, volume = np.cumsum(n), np.cumsum(n * size)
    for e in np.flatnonzero(n[: capacity // 2 + 1]):
        whole = count[-1] - count[capacity - e]
        middle = volume[capacity - e] - (volume[e - 1] if e else 0)
        best = max(best, int(whole) - (-int(middle) // capacity))
    # f_k: floor((k + 1) x / capacity) / k, or x / capacity where (k + 1) x / capacity is whole.
    for k in range(1, 33):
        t, whole = (k + 1) * size // capacity, (k + 1) * size % capacity == 0
        f = np.where(whole, k * size, capacity * t)  # in 1 / (k * capacity)
        best = max(best, -(-int((n * f).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length and what each bin holds. Bins with the same room are interchangeable, so rooms are looked up, not bins."""
    where, offset, held = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    with_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        x = int(lengths[i])
        k = bisect.bisect_left(rooms, x)
        if k == len(rooms):
            b, room = len(held), capacity
            held.append(0)
        else:
            room = rooms[k]
            b = with_room[room].pop()
            if not with_room[room]:
                rooms.pop(k)
        where[i], offset[i] = b, held[b]
        held[b] += x
        if room := room - x:
            if not with_room.get(room):
                with_room[room] = []
                bisect.insort(rooms, room)
            with_room[room].append(b)
    return where, offset, np.array(held, np.int64)


def _pack(items: DataFrame, parts: int, tag: str, capacity: int) -> DataFrame:
    """PACKED rows of items, dealt evenly to parts partitions; used and bound are the partition's counts, total what the sequence holds."""

    def run(batches):
        from pyspark import TaskContext

        got = pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=_ARROW) for b in batches], schema=_ARROW)
        if not got.num_rows:
            return
        got = got.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = got.column("length").to_numpy()
        where, offset, held = best_fit_decreasing(lengths, capacity)
        bound, n = lower_bound(lengths, capacity), len(lengths)
        name = f"{tag}-{TaskContext.get().partitionId()}-"
        seq = pa.array([f"{name}{x}" for x in where])
        for x, c in (("seq", seq), ("offset", offset), ("used", np.full(n, len(held))), ("bound", np.full(n, bound)), ("total", held[where])):
            got = got.append_column(x, pa.array(c))
        yield from got.to_batches(max_chunksize=10_000)

    return items.select("doc_id", "piece", "start", "length", "ids_crc32").repartition(parts).mapInArrow(run, PACKED)


_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pack(items: DataFrame, capacity: int = 4096, per_part: int = 200_000, shrink: int = 8) -> DataFrame:
    """items: PIECES rows in the shared folder. Adds sequence_id long and offset long."""
    full = items.where(F.col("length") == capacity)
    rest = items.where(F.col("length") < capacity)
    parts = max(1, -(-rest.count() // per_part))
    done, level = [], 0
    while True:
        now = save(_pack(rest, parts, str(level), capacity), "packed")
        done.append((now, parts == 1))
        if parts == 1:
            break
        # Each partition opens its emptiest sequence, and of its next emptiest as many as it has sequences over its bound.
        bins = now.groupBy("seq").agg(F.first("total").alias("total"), F.first(F.col("used") - F.col("bound")).alias("gap"))
        part = F.substring_index("seq", "-", 2)
        slack = bins.where(F.col("total") < capacity).select("seq", "gap", F.row_number().over(_order(part)).alias("k")).where(F.col("k") <= F.lit(1) + F.col("gap") * 2)
        opened = save(slack.select("seq"), "opened")
        done[-1] = (now.join(opened, "seq", "left_anti"), False)
        rest = now.join(opened, "seq", "left_semi")
        parts, level = -(-parts // shrink), level + 1
    sizes = union([x.select("doc_id", "piece", "start", "length", "ids_crc32", "seq", "offset") for x, _ in done])
    # Two names of sequences never share an id: level, partition and number have bits of their own.
    field = lambda i: F.split("seq", "-")[i].cast("long")
    small = sizes.select("doc_id", "piece", "start", "length", "ids_crc32", (F.shiftleft(field(0) + 1, 58) + F.shiftleft(field(1), 34) + field(2)).alias("sequence_id"), "offset")
    whole = full.select("doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return small.unionByName(whole)


def _order(part):
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy("total", "seq")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, per_part: int = 200_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(save(pieces(docs, tokenizer, capacity), "pieces"), capacity, per_part)


def sequences(packed: DataFrame, docs: DataFrame, tokenizer: str, capacity: int = 4096) -> DataFrame:
    """The token ids themselves: (sequence_id, ids array<int>), pieces in the order of their offsets. Ids in docs must be unique."""
    ready(docs.sparkSession)

    def run(batches):
        encoder = TextEncoder.of(tokenizer)
        for b in batches:
            out = []
            for text, cuts in zip(encoder.encode(b.column(0)), b.column(1).to_pylist()):
                ids = np.append(text.astype("<i4"), np.int32(END_ID))
                out += [(x["sequence_id"], x["offset"], ids[x["start"] : x["start"] + x["length"]].tolist()) for x in cuts]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["sequence_id", "offset", "ids"])

    cuts = packed.groupBy("doc_id").agg(F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("cuts"))
    placed = docs.select("doc_id", "text").join(cuts, "doc_id").select("text", "cuts").mapInArrow(run, "sequence_id long, offset long, ids array<int>")
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
