"""Tokens, packing and wavelet shards, as exact round trips."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import cases
from tallyloom.llm import packing, wavelet
from tallyloom.llm.queries import word_bpe
from tallyloom.llm.tokens import END_ID, TextEncoder


def plain_ids(text):
    from tokenizers import Tokenizer

    plain_ids.tokenizer = getattr(plain_ids, "tokenizer", None) or Tokenizer.from_file(word_bpe())
    return plain_ids.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aAéÉıİſßẞ'’s.,!?12 \n\t\x1c\x85\xa0␛<|endoftext|>-", max_size=60)))
def test_ids_equal_the_librarys(text):
    assert TextEncoder.of(word_bpe()).encode([text])[0].tolist() == plain_ids(text)


def test_ids_of_the_cases(spark):
    for r in cases.rows():
        assert TextEncoder.of(word_bpe()).encode([r[1]])[0].tolist() == plain_ids(r[1])


def expected_pieces(rows, capacity):
    out = []
    for r in rows:
        ids = [*plain_ids(r[1]), END_ID]
        for k, at in enumerate(range(0, len(ids), capacity)):
            cut = np.array(ids[at : at + capacity], "<u4")
            out.append((r[0], k, at, len(cut), zlib.crc32(cut.tobytes())))
    return sorted(out, key=repr)


@pytest.mark.parametrize("capacity, per_part", [(4096, 200_000), (256, 20), (300, 7), (64, 10)])
def test_packing_is_whole_and_gapless(spark, capacity, per_part):
    got = packing.pack_documents(cases.frame(spark), word_bpe(), capacity, per_part).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == expected_pieces(cases.rows(), capacity)
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_seq.values():
        ends = np.cumsum([0, *(n for _, n in sorted(places))]).tolist()
        assert [at for at, _ in sorted(places)] == ends[:-1] and ends[-1] <= capacity
    lengths = np.array([r.length for r in got])
    bound = packing.lower_bound(lengths, capacity)
    assert bound <= len(by_seq) <= 1.25 * bound + 2


def test_ids_of_sequences(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["one two", None, "three " * 50])], "doc_id long, text string")
    packed = packing.pack_documents(docs, word_bpe(), 16)
    got = {r.sequence_id: r.ids for r in packing.sequences(packed, docs, word_bpe(), 16).collect()}
    for r in packed.collect():
        ids = [*plain_ids(docs.where(f"doc_id = {r.doc_id}").first().text), END_ID]
        assert got[r.sequence_id][r.offset : r.offset + r.length] == ids[r.start : r.start + r.length]


def exact(lengths, capacity):
    """The least number of bins, by search."""
    items, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        seen = set()
        for b in range(len(bins)):
            if bins[b] >= items[i] and bins[b] not in seen:
                seen.add(bins[b])
                place(i + 1, [*bins[:b], bins[b] - items[i], *bins[b + 1 :]])
        place(i + 1, [*bins, capacity - items[i]])

    place(0, [])
    return best[0]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9), st.just(20))
def test_bounds_hold(lengths, capacity):
    x = np.array(lengths)
    _, _, held = packing.best_fit_decreasing(x, capacity)
    assert packing.lower_bound(x, capacity) <= exact(lengths, capacity) <= len(held) and held.max() <= capacity


def test_exchange_closes_gaps(spark):
    """Partitions packed on their own leave a rest each; after exchanges the whole is near its bound."""
    rng = random.Random(5)
    rows = [(i, 0, 0, rng.choice([30, 50, 70, 33, 34, 11, 64]), i) for i in range(3000)]
    items = spark.createDataFrame(rows, packing.PIECES)
    n = packing.pack(items, 100, per_part=200).select("sequence_id").distinct().count()
    bound = packing.lower_bound(np.array([r[3] for r in rows]), 100)
    assert bound <= n <= bound * 1.02 + 1


def test_empty_tables(spark):
    assert packing.pack_documents(cases.empty(spark), word_bpe()).count() == 0
    assert wavelet.round_trip(cases.empty(spark), word_bpe()).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=300))
def test_wavelet_matrix(ids):
    x = np.array(ids, "<u2")
    m = wavelet.WaveletMatrix(wavelet.WaveletMatrix.build(x, [5, None], [len(x), 0], levels=6))
    assert m.ids().tolist() == ids and m.documents()[0] == [5, None]
    assert [m.access(i) for i in range(len(ids))] == ids
    for s in (0, 1, 40, 41, 63, 64):
        places = [i for i, v in enumerate(ids) if v == s]
        assert m.count(s) == len(places) and [m.select(s, k) for k in range(len(places))] == places
        assert m.rank(s, len(ids) // 2) == sum(p < len(ids) // 2 for p in places)
        assert m.positions(s).tolist() == places
        assert m.ranks(s, np.arange(len(ids) + 1)).tolist() == [sum(p < i for p in places) for i in range(len(ids) + 1)]
        with pytest.raises(IndexError):
            m.select(s, len(places))


def test_wavelet_over_many_blocks():
    x = np.random.default_rng(1).integers(0, 49_000, 200_000).astype("<u2")
    m = wavelet.WaveletMatrix(wavelet.WaveletMatrix.build(x, [1], [len(x)]))
    for i in (0, 65_535, 65_536, 131_071, 199_999):
        s = int(x[i])
        assert m.access(i) == s and m.select(s, m.rank(s, i)) == i
    assert (m.ids() == x).all()
    assert (m.ranks(int(x[9]), np.arange(0, 200_001, 997)) == [np.count_nonzero(x[:i] == x[9]) for i in range(0, 200_001, 997)]).all()
    assert (m.positions(int(x[9])) == np.flatnonzero(x == x[9])).all()


def test_a_question_reads_ranges_of_the_file(tmp_path):
    x = (np.random.default_rng(2).zipf(1.3, 2_000_000) % 49_000).astype("<u2")
    data = wavelet.WaveletMatrix.build(x, [1], [len(x)])
    (tmp_path / "x.wm").write_bytes(data)
    with wavelet.WaveletMatrix.open(str(tmp_path / "x.wm")) as m:
        read, sizes = m.read, []
        m.read = lambda at, size: sizes.append(size) or read(at, size)
        assert m.access(1_234_567) == x[1_234_567]
        assert m.rank(7, 1_000_000) == np.count_nonzero(x[:1_000_000] == 7)
        assert m.select(7, 1000) == np.flatnonzero(x == 7)[1000]
    assert 0 < sum(sizes) < len(data) / 4


def test_occurrences(spark, tmp_path):
    manifest = wavelet.write_shards(cases.frame(spark), word_bpe(), f"file://{tmp_path}/shards", shard_tokens=500)
    got = wavelet.occurrences(manifest, END_ID).collect()
    want = sorted((r[0], at) for r in cases.rows() if r[0] is not None for at, x in enumerate([*plain_ids(r[1]), END_ID]) if x == END_ID)
    assert sorted((r.doc_id, r["at"]) for r in got if r.doc_id is not None) == want


def test_shards(spark):
    got = wavelet.round_trip(cases.frame(spark), word_bpe()).collect()
    rows = sorted(cases.rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = {}
    for r in rows:
        ids.setdefault(r[0], []).append([*plain_ids(r[1]), END_ID])
    assert len(got) == len(rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        raw = [np.array(x, "<u4").tobytes() for x in ids[r.doc_id]]
        assert (r.n_tokens, r.ids_crc32) in [(len(x) // 4, zlib.crc32(x)) for x in raw]
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [r[0] for r in rows]
