"""Hashes, registers and estimates."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import hll, hllbytes, hllforeign
from tallyloom.functions.murmur import murmur64

_M = (1 << 64) - 1


def one_by_one(data: bytes) -> int:
    """The published algorithm on Python's integers."""

    def turn(x, r):
        return (x << r | x >> 64 - r) & _M

    def mix(x):
        x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & _M
        x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 & _M
        return x ^ x >> 33

    c1, c2, a, b = 0x87C37B91114253D5, 0x4CF5AD432745937F, 0, 0
    whole = len(data) // 16 * 16
    for i in range(0, whole, 16):
        k, m = struct.unpack_from("<QQ", data, i)
        a = (turn(a ^ turn(k * c1 & _M, 31) * c2 & _M, 27) + b) * 5 + 0x52DCE729 & _M
        b = (turn(b ^ turn(m * c2 & _M, 33) * c1 & _M, 31) + a) * 5 + 0x38495AB5 & _M
    k, m = struct.unpack("<QQ", data[whole:].ljust(16, b"\0"))
    b ^= turn(m * c2 & _M, 33) * c1 & _M
    a ^= turn(k * c1 & _M, 31) * c2 & _M
    a, b = a ^ len(data), b ^ len(data)
    a = a + b & _M
    b = b + a & _M
    a, b = mix(a), mix(b)
    return a + b & _M


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=70), max_size=20))
def test_hash_of_every_length(values):
    assert murmur64(pa.array(values, pa.binary())).tolist() == [one_by_one(v) for v in values]


def test_hash_of_long_and_short_together():
    values = [b"", b"x" * 100_000, b"ab", b"y" * 33, None]
    assert murmur64(pa.array(values, pa.binary())).tolist() == [one_by_one(v or b"") for v in values]


def test_known_registers():
    """Fixed values: 'hello' is register 13046 with 3, 'world' register 7281 with 2."""
    assert hll.registers(pa.array(["hello", "world"])).tolist() == [13046 * 64 + 3, 7281 * 64 + 2]


def test_rho_has_an_end():
    """A hash whose low bits are all zero still stops at the bit that is always set."""
    assert (hll.registers(pa.array([f"{i}" for i in range(1000)])) % 64 <= 50).all()


def estimate(spark, states):
    return [r[0] for r in spark.createDataFrame([(s,) for s in states], "s array<int>").select(hll.exact_estimate(F.col("s"))).collect()]


def test_estimates(spark):
    """What the estimator gives for the decimal numbers below n, and for three words."""
    sets = [["foo", "bar", "baz"], ["%d" % i for i in range(100)], []]

    def state(words):
        best = {}
        for x in hll.registers(pa.array(words, pa.string())).tolist():
            best[x // 64] = max(best.get(x // 64, 0), x % 64)
        return sorted(k * 64 + v for k, v in best.items())

    got = estimate(spark, [*map(state, sets), None])
    assert got[0] == 3 and abs(got[1] - 100) <= 1 and got[2:] == [0, 0]


@pytest.mark.parametrize("mode", ["exact", "sketch"])
def test_merging_parts_equals_adding_at_once(spark, mode):
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.randrange(4), f"v{rng.randrange(3000)}") for _ in range(6000)] + [(0, 0, ""), (1, 1, None), (9, 0, "")]
    df = spark.createDataFrame(rows, "k long, part long, v string")
    if mode == "exact":
        whole = hll.exact_partial(df, ["k"], "v")
        merged = hll.exact_merge(hll.exact_partial(df, ["k", "part"], "v"), ["k"], "v")
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))
        got = {r[0]: r[1] for r in merged.select("k", hll.exact_estimate(F.col("v"))).collect()}
    else:
        parts = df.groupBy("k", "part").agg(hll.sketch_partial(F.col("v")).alias("v"))
        got = {r[0]: r[1] for r in parts.groupBy("k").agg(hll.sketch_merge(F.col("v")).alias("v")).select("k", hll.sketch_estimate(F.col("v"))).collect()}
        assert got.pop(9) == 0
    for k in range(3):
        true = len({v for a, _, v in rows if a == k and v})
        assert abs(got[k] - true) <= 0.03 * true


def test_accuracy_at_scale(spark):
    df = spark.range(100_000).select(F.lit(1).alias("k"), F.col("id").cast("string").alias("v"))
    n = hll.exact_partial(df, ["k"], "v").select(hll.exact_estimate(F.col("v"))).first()[0]
    assert abs(n - 100_000) <= 2000 and isinstance(n, int)
    assert np.isfinite(n)


def _state(words):
    at = hll.registers(pa.array(words, pa.string()))
    return hllforeign.packed(at >> 6, at & 63)


def test_foreign_layouts():
    for words in ([], ["one"], [str(i) for i in range(300)], [str(i) for i in range(60_000)]):
        state = _state(words)
        for bits in (5, 6):
            if len(state) and (state & 63).max() >= 1 << bits:
                continue
            assert hllforeign.from_foreign(hllforeign.to_foreign(state, bits)).tolist() == state.tolist()
        assert hllforeign.estimate(state) == pytest.approx(len(words), rel=0.03, abs=1)
    one, two = _state(["a", "b"]), _state(["b", "c"])
    both = _state(["a", "b", "c"])
    assert hllforeign.merged(hllbytes.to_bytes(one), hllforeign.to_foreign(two)) == hllbytes.to_bytes(both)
    assert hllforeign.merged(hllbytes.dense(one), hllbytes.dense(two)) == hllbytes.to_bytes(both)


def _sparse(*sums):
    """The sparse foreign layout of running sums."""
    body = b""
    for n in np.diff([0, *sums]).tolist():
        while n >= 0x80:
            body += bytes([n & 0x7F | 0x80])
            n >>= 7
        body += bytes([n])
    return b"\0\1" + (15 + len(body)).to_bytes(4, "big") + b"\0\1" + bytes([14, 20]) + bytes(5) + body


def test_foreign_sparse_entries():
    # Even: a hash's top 20 bits; here register 123, and its sixth bit after the register is the first one. Odd: register 456, rho 34; register 789, rho 25.
    even, odd = ((123 << 6 | 1) << 1), lambda register, rho: register << 13 | (rho - 6) << 1 | 1
    got = hllforeign.from_foreign(_sparse(even, odd(456, 34), odd(789, 25)))
    assert got.tolist() == [123 * 64 + 6, 456 * 64 + 34, 789 * 64 + 25]
    assert hllforeign.from_foreign(_sparse()).tolist() == []


@pytest.mark.parametrize(
    "at, value, message",
    [(1, 2, "HLL\\+\\+ layout"), (5, 99, "length mismatch"), (7, 2, "unknown flags"), (8, 15, "unsupported precision"), (9, 25, "unsupported precision"), (14, 4, "unsupported bits")],
)
def test_foreign_headers_are_checked(at, value, message):
    data = bytearray(hllforeign.to_foreign(_state(["a"])))
    data[at] = value
    with pytest.raises(ValueError, match=message):
        hllforeign.from_foreign(bytes(data))


def test_streaming_header():
    """One register, sparse and dense."""
    state = np.array([1234 * 64 + 5])
    assert hllforeign.to_streaming(hllbytes.to_bytes(state)) == b"S\0\0\0\1" + bytes(7) + b"\x0e\0\0\0\5\0\0\0" + bytes.fromhex("44d1907b2c")
    out = hllforeign.to_streaming(hllbytes.dense(np.array([1 * 64 + 5])))
    assert out[:30] == b"D\0\0\0\1" + bytes(7) + b"\x0e\0\0\0\1\x30\0\0" + b"\x40\1" + bytes(8)
    assert hllforeign.opcodes(hllbytes.to_bytes(state)) == ["XZERO(1234) [0, 1234)", "VALUE(5 over 1) [1234, 1235)", "XZERO(15149) [1235, 16384)"]


def test_low_registers():
    at = hllforeign.low_registers(pa.array([str(i) for i in range(2000)]))
    for x, h in zip(at.tolist(), murmur64(pa.array([str(i) for i in range(2000)])).tolist()):
        rest, rho = (h | 1 << 63) >> 14, 1
        while not rest & 1:
            rest, rho = rest >> 1, rho + 1
        assert x == (h & 16383) * 64 + rho
