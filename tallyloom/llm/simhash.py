"""SimHash near-duplicates by multi-index hashing.

A text is lower-cased (A-Z only) and cut into words at [\\x20\\x09-\\x0D]; its shingles of a few words, repeats included, each
vote with their XXH64 on every bit of the fingerprint. Equal fingerprints are one class; classes are compared, not documents.

Multi-index hashing: two fingerprints within r bits differ by at most r // m in one of m segments, so every segment value is
stored in a table, each class probes the Hamming ball of that radius around its own segment values, and whole distances are
verified on what the tables return. A pair whose segments differ is met from one side only (the one with the lowest differing
bit set). Ball sizes are fixed by (bits, segments, radius); nothing is capped.

near_duplicates() links documents by the distance of 64-bit fingerprints over three words. similar_groups() is for a given Jaccard similarity of
the distinct shingles of five words (as 64-bit hashes): a pair is linked if, and only if, it meets and its two whole sets are at least that similar.
Pairs meet by SimHash and multi-index hashing too, over wider fingerprints: sets of similarity 0.8 differ in 15 to 19 % of bits, so 64 bits and a radius of two
would miss them. In each of 27 segments of 28 bits, both sides have the Hamming ball of the changes that the votes make likeliest (none, one of the seven
least certain bits, two of the least six), and 128 bits more are compared whole. Sets of up to 14 shingles also meet by all that is left of them without one
or two shingles, which a pair of 0.8 always shares. Meeting is made for 0.8 and more; a lower similarity is met less often. Members of a bucket
are compared with its least one; a few segments go first, and a bucket within one group needs nothing more. Only those that the least one does
not link are compared with the others, in blocks bounded by rows and shingles: a group of close copies costs some comparisons each.

Null, empty and blank texts have fingerprint zero, linked like any other. Null ids take part; a group's id is its least
non-null id, null if it has none. Repeated rows come out as often as they came in. Other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import LOWER, UPPER, drop, ready, save, small
from tallyloom.llm.components import components, unite

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_ROWS = 1 << 16


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, in order, repeats included; of the whole sequence where there are fewer words."""
    w = (text or "").encode().translate(_FOLD).split()
    if not w:
        return np.empty(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    rows = zip(*(w[i:] for i in range(words))) if len(w) > words else [w]
    return np.array([digest(join(x), seed) for x in rows], np.uint64)


def fingerprint(h: np.ndarray) -> np.uint64:
    """Bit i is 1 if it is set in over half of h."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), _ROWS):
        votes += np.unpackbits(h[i : i + _ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(votes * 2 > len(h), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint's 64 bits as a long."""
    ready(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(shingle_hashes(x.as_py(), words)) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def masks(bits: int, radius: int) -> list[tuple[int, int]]:
    """(mask, its lowest bit) of each change of up to radius bits."""
    return [(m := sum(1 << i for i in c), m & -m) for n in range(radius + 1) for c in combinations(range(bits), n)]


def links(classes: DataFrame, radius: int = 2, segments: int = 2) -> DataFrame:
    """classes(fp): all pairs (a, b), a < b, of fingerprints at most radius bits apart.

    Spark estimates a ball by its class, not by its many probes, and would broadcast hundreds of MB of them: both sides are shuffled, whatever their size.
    """
    bits = 64 // segments
    long = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("long")
    ball = F.array(*(F.struct(long(m).alias("mask"), long(low).alias("low")) for m, low in masks(bits, radius // segments)))
    cut = lambda s: F.shiftrightunsigned("fp", s * bits).bitwiseAND(long((1 << bits) - 1))
    keyed = classes.select("fp", F.posexplode(F.array(*(cut(s) for s in range(segments)))).alias("seg", "key"))
    probes = keyed.select("fp", "seg", "key", F.explode(ball).alias("x")).where("x.mask = 0 OR key & x.low <> 0").select(F.col("fp").alias("p"), "seg", F.expr("key ^ x.mask").alias("key"), (F.col("x.mask") == 0).alias("same"))
    met = probes.hint("merge").join(keyed.hint("merge"), ["seg", "key"]).where("p <> fp AND (NOT same OR p < fp)").where(F.bit_count(F.col("p").bitwiseXOR(F.col("fp"))) <= radius)
    return met.select(F.least("p", "fp").alias("a"), F.greatest("p", "fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, segments: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, fp long, component_id: the least id reachable over links, its own included)."""
    fps = save(fingerprints(docs, words, id_col, text_col), "fps")
    classes = save(fps.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    comp = components(links(classes, radius, segments))
    of = classes.join(comp, F.col("node") == F.col("fp"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = save(of.join(of.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id"), "named")
    return fps.hint("merge").join(small(named, 100_000), "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)

def _mixed(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * by
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


#: A wide fingerprint has SEGMENTS segments of WIDTH bits, to meet by, and 128 bits to compare whole. A ball changes one of a segment's WEAK least certain bits, or two of its PAIRED least.
SEGMENTS, WIDTH, WEAK, PAIRED, APART = 27, 28, 7, 6, 45
#: Sets of at most so many shingles also meet by what is left of them without one or two.
SHORT = 14
_LONGS = -(-SEGMENTS * WIDTH // 64) + 2
_BALL = [(), *((i,) for i in range(WEAK)), *combinations(range(PAIRED), 2)]
_LANES = np.uint64(0x0101010101010101)


def ball(keys: np.ndarray, change: tuple[int, ...]) -> np.ndarray:
    """Segments, with the bits changed that are at these places of their order of certainty."""
    out = keys & ((1 << WIDTH) - 1)
    for i in change:
        out = out ^ (1 << (keys >> (WIDTH + 5 * i) & 31))
    return out


class WideHasher:
    """Shingle sets of texts and their wide fingerprints; hashes of words are kept, up to a bound."""

    def __init__(self, words: int, kept: int = 200_000):
        self.words, self.kept, self.known = words, kept, {}
        self.by = _mixed(np.arange(1, _LONGS + 1, dtype=np.uint64), _MIX[2]) | np.uint64(1)

    def shingles(self, text: str | None) -> tuple[int, np.ndarray]:
        """(hash of the word sequence, distinct shingle hashes, ascending)."""
        known, digest = self.known, xxhash.xxh64_intdigest
        if len(known) > self.kept:
            known.clear()
        h = []
        for w in (text or "").encode().translate(_FOLD).split():
            if (x := known.get(w)) is None:
                x = digest(w, 7)
                if len(w) <= 64:
                    known[w] = x
            h.append(x)
        h = np.array(h, np.uint64)
        k = min(self.words, max(1, len(h)))
        out = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for i in range(k):
            out = _mixed(out ^ h[i : i + len(out)], _MIX[0])
        return xxhash.xxh64_intdigest(h.tobytes(), 7), np.unique(out)

    def margins(self, s: np.ndarray) -> np.ndarray:
        """Votes for, less votes against, every bit. Eight bits a long are counted at once, a byte each, of 255 shingles at most."""
        votes = np.zeros((_LONGS, 8, 8), np.int64)
        for at in range(0, len(s), 4080):
            x = _mixed(s[None, at : at + 4080], self.by[:, None])
            cuts = np.arange(0, x.shape[1], 255)
            for k in range(8):
                votes[:, :, k] += np.add.reduceat(x >> np.uint64(k) & _LANES, cuts, axis=1).view(np.uint8).reshape(_LONGS, -1, 8).sum(1, dtype=np.int64)
        return votes.reshape(-1) * 2 - len(s)

    def keys(self, s: np.ndarray) -> np.ndarray:
        """SEGMENTS longs, each a segment and the places of its WEAK least certain bits, the least first; two longs of bits; of a short set, the keys of its remains. None of an empty set."""
        if not len(s):
            return np.empty(0, np.uint64)
        margin = self.margins(s)
        cut = margin[: SEGMENTS * WIDTH].reshape(SEGMENTS, WIDTH)
        out = ((cut > 0) * (1 << np.arange(WIDTH))).sum(1)
        weak = np.argsort(np.abs(cut), axis=1, kind="stable")[:, :WEAK]
        out = (out | (weak << (WIDTH + 5 * np.arange(WEAK))).sum(1)).astype(np.uint64)
        parts = [out, np.packbits(margin[-128:] > 0, bitorder="little").view(np.uint64)]
        if len(s) <= SHORT:
            x = _mixed(s, _MIX[3])
            i, j = np.triu_indices(len(s), 1)
            left = x.sum() - np.concatenate((np.zeros(1, np.uint64), x, x[i] + x[j]))
            parts.append(_mixed(left, _MIX[2]))
        return np.concatenate(parts)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """docs(id, tie, text): id, tie, at (a number of the row), rep (one of the text's word sequence), n, keys and s, the shingle set."""
    ready(docs.sparkSession)

    def lists(parts):
        cut = np.cumsum([0, *map(len, parts)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(cut), pa.array((np.concatenate(parts) if parts else np.empty(0, np.uint64)).view(np.int64)))

    def run(batches):
        hasher = WideHasher(words)
        for b in batches:
            found = [hasher.shingles(x.as_py()) for x in b.column(3)]
            sets = [x for _, x in found]
            reps = np.array([x for x, _ in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(reps), pa.array(list(map(len, sets)), pa.int32()), lists([hasher.keys(x) for x in sets]), lists(sets)], ["id", "tie", "at", "rep", "n", "keys", "s"])

    return docs.select("id", "tie", F.monotonically_increasing_id().alias("at"), "text").mapInArrow(run, "id long, tie long, at long, rep long, n int, keys array<long>, s array<long>")


def meetings(classes: DataFrame, rows: int | None = None, room: int = 1 << 20) -> DataFrame:
    """classes(rep, keys): (rep, band, key) of what meets another by a segment's ball or a short set's remains; who meets, directly or over others of a table, has one key.

    Every class goes to each segment's table once (of more than `room` classes: once for each start that segments of its ball have, as many bits of it as keep a table
    below that), and balls are made and met there, so that the shuffle carries few of them. Classes with an equal segment in their balls meet if their other 128 bits
    are at most APART from those of each other or of a third; of over 64 classes, all do. A large group of near copies has one key a table, not one for each changed bit.
    """
    spark = classes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(WIDTH, max(0, math.ceil(math.log2(max(1, (classes.count() if rows is None else rows) / room)))))

    def deal(batches):
        for b in batches:
            rep, cut = b.column(0).to_numpy(), np.cumsum([0, *b.column(1).value_lengths().to_numpy()])
            flat = b.column(1).flatten().to_numpy()
            has = np.flatnonzero(np.diff(cut))
            if not len(has):
                continue
            at = cut[:-1][has][:, None] + np.arange(SEGMENTS + 2)
            seg, one, two = flat[at[:, :SEGMENTS]], flat[at[:, -2]], flat[at[:, -1]]
            if bits:
                starts = np.sort(np.stack([ball(seg, c) >> (WIDTH - bits) for c in _BALL], axis=2), axis=2)
                fresh = np.concatenate((np.ones((*seg.shape, 1), bool), np.diff(starts, axis=2) != 0), axis=2)
                i, s, k = np.nonzero(fresh)
                part = (s << bits) + starts[i, s, k]
            else:
                i, s = (x.reshape(-1) for x in np.indices(seg.shape))
                part = s
            left = [flat[cut[j] + SEGMENTS + 2 : cut[j + 1]] for j in has]
            owner, left = np.repeat(np.arange(len(has)), list(map(len, left))), np.concatenate(left)
            part = np.concatenate((part, (SEGMENTS << bits) + (left & ((8 << bits) - 1))))
            who, key = np.concatenate((i, owner)), np.concatenate((seg[i, s], left))
            for lo in range(0, len(who), 10_000):
                w = who[lo : lo + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part[lo : lo + 10_000].astype(np.int32), rep[has][w], key[lo : lo + 10_000], one[w], two[w])], ["part", "rep", "key", "one", "two"])

    def met(key, who, fp):
        """Pairs of rows that join those of each key: fp None for keys that need no more than to be equal."""
        order = np.argsort(key, kind="stable")
        key, who = key[order], who[order]
        same = key[1:] == key[:-1]
        inside = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        key, who = key[inside], who[inside]
        if fp is not None and len(key):
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            near = np.repeat(np.diff([*begin, len(key)]) > 64, np.diff([*begin, len(key)]))
            for d in range(1, 64):
                i = np.flatnonzero((key[d:] == key[:-d]) & ~(near[d:] & near[:-d]))
                if not len(i):
                    break
                p, q = who[i], who[i + d]
                i = i[np.bitwise_count(fp[0][p] ^ fp[0][q]) + np.bitwise_count(fp[1][p] ^ fp[1][q]) <= APART]
                near[i] = near[i + d] = True
            key, who = key[near], who[near]
        i = np.flatnonzero(key[1:] == key[:-1])
        return who[i], who[i + 1]

    def run(batches):
        def table(part, held):
            rep, key, one, two = (np.concatenate(x) for x in zip(*held))
            label, seg = np.arange(len(rep)), part >> bits
            if seg >= SEGMENTS:
                unite(label, *met(key, label.copy(), None))
            else:
                # In turns, each of the segments with one remainder.
                turns = -(-len(key) * len(_BALL) // 1_500_000)
                for turn in range(turns):
                    keys, who = [], []
                    for c in _BALL:
                        x = ball(key, c)
                        own = (x >> (WIDTH - bits) == part & ((1 << bits) - 1)) if bits else np.ones(len(x), bool)
                        i = np.flatnonzero(own & (x % turns == turn))
                        keys.append(x[i])
                        who.append(i)
                    unite(label, *met(np.concatenate(keys), np.concatenate(who), (one.view(np.uint64), two.view(np.uint64))))
            rows = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
            rows = rows[np.lexsort((rep[rows], label[rows]))]
            rows = rows[np.concatenate(([True], (rep[rows[1:]] != rep[rows[:-1]]) | (label[rows[1:]] != label[rows[:-1]])))[: len(rows)]]
            for lo in range(0, len(rows), 10_000):
                i = rows[lo : lo + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(np.full(len(i), min(seg, SEGMENTS), np.int32)), pa.array(label[i] + (part << 32))], ["rep", "band", "key"])

        now, held = None, []
        for b in batches:
            part, cols = b.column(0).to_numpy(), [b.column(i).to_numpy() for i in range(1, 5)]
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if part[lo] != now:
                    if held:
                        yield from table(now, held)
                    now, held = int(part[lo]), []
                held.append(tuple(c[lo:hi] for c in cols))
        if held:
            yield from table(now, held)

    dealt = classes.select("rep", "keys").mapInArrow(deal, "part int, rep long, key long, one long, two long")
    return dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "rep long, band int, key long")


def _rows_of(batches, keys: int):
    """(key, columns of its rows as arrays, sets), piece by piece, of batches sorted by their first columns."""
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy() for i in range(keys)], axis=1)
        cols = [b.column(i).to_numpy() for i in range(keys, b.num_columns - 1)]
        last = b.column(b.num_columns - 1)
        flat, ends = last.flatten().to_numpy(), np.cumsum(np.array(last.value_lengths()))
        sets = np.split(flat, ends[:-1])
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts, cuts[1:]):
            yield tuple(k[lo].tolist()), [c[lo:hi] for c in cols], sets[lo:hi]


def _similar(inter, n, m, similarity: float):
    return inter >= similarity * (n + m - inter) - 1e-9


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """pairs (rep, leader), distinct: with linked, whether the Jaccard similarity of their sets is at least `similarity`. A leader of many goes to several tasks."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = pairs.groupBy("leader").agg(F.ceil(F.count("*") / block).alias("parts"))
    members = pairs.join(of, "leader").select("leader", F.pmod(F.xxhash64("rep"), "parts").alias("part"), F.lit(1).alias("side"), "rep").join(sets, "rep").select("leader", "part", "side", "rep", "s")
    leaders = of.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("leader").alias("rep")).join(sets, "rep").select("leader", "part", "side", "rep", "s")
    dealt = leaders.unionByName(members).repartition(parts, "leader", "part").sortWithinPartitions("leader", "part", "side")

    def run(batches):
        own = None
        for (leader, _), (side, rep), found in _rows_of(batches, 2):
            if side[0] == 0:
                own, rep, found = found[0], rep[1:], found[1:]
            if len(rep):
                linked = [bool(_similar(len(np.intersect1d(own, x, assume_unique=True)), len(own), len(x), similarity)) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array([leader] * len(rep), pa.int64()), pa.array(linked)], ["rep", "leader", "linked"])

    return dealt.mapInArrow(run, "rep long, leader long, linked boolean")


def _rest_links(rest: DataFrame, others: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """rest and others (key, rep) with nr and no, the blocks of each side of the bucket: links (a, b) that join what is similar across the two sides."""
    parts = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda df, side, own, other: (
        df.withColumn("mine", F.pmod(F.xxhash64("rep"), own))
        .withColumn("theirs", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        .select("key", F.col("mine" if side == 0 else "theirs").alias("x"), F.col("theirs" if side == 0 else "mine").alias("y"), F.lit(side).alias("side"), "rep")
    )
    dealt = deal(rest, 0, "nr", "no").unionByName(deal(others, 1, "no", "nr")).join(sets, "rep").select("key", "x", "y", "side", "rep", "s").repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y", "side", "rep")

    def compared(side, rep, found):
        p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(p) or not len(q):
            return
        label, size = np.arange(len(rep)), np.array([len(found[i]) for i in q])
        owner, flat = np.repeat(np.arange(len(q)), size), np.concatenate([found[i] for i in q])
        order = np.argsort(flat, kind="stable")
        owner, flat = owner[order], flat[order]
        for i in p:
            lo, hi = np.searchsorted(flat, found[i], "left"), np.searchsorted(flat, found[i], "right")
            many = hi - lo
            met = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            like = np.flatnonzero(_similar(np.bincount(owner[met], minlength=len(q)), len(found[i]), size, similarity))
            unite(label, np.full(len(like), i), q[like])
        child = np.flatnonzero(label != np.arange(len(rep)))
        if len(child):
            yield pa.RecordBatch.from_arrays([pa.array(rep[child]), pa.array(rep[label[child]])], ["a", "b"])

    def run(batches):
        key, held = None, []
        gathered = lambda: (np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [x for h in held for x in h[2]])
        for now, (side, rep), found in _rows_of(batches, 3):
            if now != key:
                if held:
                    yield from compared(*gathered())
                key, held = now, []
            held.append((side, rep, found))
        if held:
            yield from compared(*gathered())

    return dealt.mapInArrow(run, "a long, b long")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, first: int = 4, block: int = 2000) -> DataFrame:
    """docs(id, tie, text): (id, tie, grp) for every row; rows of one grp are similar, directly or over others."""
    table = save(shingle_sets(docs, words), "sets")
    classes = save(table.groupBy("rep").agg(F.min("at").alias("at"), F.first("n").alias("n"), F.first("keys").alias("keys")), "set-classes")
    found = save(meetings(classes), "set-met-keys")
    keys = save(found.join(classes.select("rep", "at", "n"), "rep"), "set-shared")
    drop(found)
    drop(classes)
    # Only sets that meet another are read again. Of the others, nothing but the names of their rows is kept.
    met = save(keys.select("at").distinct(), "set-met")
    sets = save(table.select("at", "rep", "s").join(small(met), "at", "left_semi").select("rep", "s"), "set-candidates")
    named = save(table.select("id", "tie", "rep"), "set-rows")
    drop(met)
    drop(table)

    def by_leader(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """keys(rep, n, grp, key): members (rep, n, key, leader, size, total, sign) of buckets, those of its least one's grp aside; (rep, leader, linked)."""
        buckets = keys.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("rep")).alias("sign"), F.min("rep").alias("leader"), F.min_by("grp", "rep").alias("with"), F.min("grp").alias("low"), F.max("grp").alias("high"))
        member = save(keys.join(buckets.where("low <> high"), "key").where("grp <> with").select("rep", "n", "key", "size", "total", "sign", "leader"), "set-members")
        return member, save(_verified(member.select("rep", "leader").distinct(), sets, similarity, block), "set-near")

    # First by a few bands, to find most of a large group in few comparisons. What is together then is not compared again.
    _, near = by_leader(keys.where(F.col("band") < first).withColumn("grp", F.col("rep")))
    linked = near.where("linked").select(F.col("rep").alias("a"), F.col("leader").alias("b"))
    so_far = keys.join(components(linked).select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("grp", F.coalesce("component", "rep"))
    member, near = by_leader(so_far)
    linked = linked.unionByName(near.where("linked").select(F.col("rep").alias("a"), F.col("leader").alias("b")))
    together = save(components(save(linked, "set-edges")), "set-together")
    # What the least one of a bucket does not link, not over third ones either, is compared with all others of the bucket; of buckets with the same members, one is.
    rest = member.where("size > 2").join(near.where("NOT linked").select("rep", "leader"), ["rep", "leader"], "left_semi")
    for end in ("rep", "leader"):
        rest = rest.join(together.select(F.col("node").alias(end), F.col("component").alias(f"{end}_grp")), end, "left").withColumn(f"{end}_grp", F.coalesce(f"{end}_grp", end))
    rest = save(rest.where("rep_grp <> leader_grp").select("key", "rep", "n", "leader", "size", "total", "sign"), "set-rest")
    blocks = lambda count, shingles: F.ceil(F.greatest(F.col(count) / block, F.col(shingles) / (block * 500)))
    left = rest.groupBy("key", "leader", "size", "total", "sign").agg(F.count("*").alias("own"), F.sum("n").alias("held"))
    left = left.groupBy("leader", "size", "sign").agg(F.min(F.struct("key", "total", "own", "held")).alias("b")).select("leader", "size", "b.*")
    left = save(left.select("key", "leader", blocks("own", "held").alias("nr"), blocks("size", "total").alias("no")), "set-left")
    others = keys.select("key", "rep").join(left, "key").where("rep <> leader").select("key", "rep", "no", "nr")
    rest = rest.select("key", "rep").join(left, "key").select("key", "rep", "no", "nr")
    edges = together.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(_rest_links(rest, others, sets, similarity))
    comp = components(edges)
    return named.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select("id", "tie", F.coalesce("component", "rep").alias("grp"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, less all but one row of each similar group: the one with the least id (null ids last), of those the least hash of the text."""
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = keyed.withColumn("tie", F.xxhash64("text"))
    groups = save(similar_groups(keyed.select("id", "tie", "text"), **options), "wide-groups")
    best = groups.groupBy("grp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie")).alias("best")).select("best.id", "best.tie")
    times = groups.groupBy("id", "tie").agg(F.count("*").alias("times"))
    best = save(best.join(times, best["id"].eqNullSafe(times["id"]) & (best["tie"] == times["tie"])).select(best["id"].alias("best_id"), best["tie"].alias("best_tie"), "times"), "wide-best")
    found = keyed.join(best, F.col("id").eqNullSafe(F.col("best_id")) & (F.col("tie") == F.col("best_tie")))
    out = found.where("times = 1").select("row")
    if best.where("times > 1").limit(1).count():
        out = out.unionByName(found.where("times > 1").dropDuplicates(["id", "tie"]).select("row"))
    return out.select("row.*")
