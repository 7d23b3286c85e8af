"""Key, value and sketch bytes: fixed values, round trips and order."""

import datetime as dt
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quotes import QUOTES, frame, schema, tuples
from tallyloom.functions import hll, hllbytes
from tallyloom.operators.extract import partials
from tallyloom.sources import keyvalue, rows
from tallyloom.types import DimensionType, MetricType

KINDS = list(DimensionType)[1:]


def test_fixed_values():
    assert rows.put_int(9999).hex() == "f7270f" and rows.put_int(3).hex() == "8b"
    assert rows.put_float(12345.0).hex() == "0540c81c8000000000"
    assert rows.put_string("hello").hex() == "1268656c6c6f0001"
    assert rows.put_time(dt.datetime.fromtimestamp(12345, dt.timezone.utc)).hex() == "14f7303988"


@pytest.mark.parametrize(
    "put, get, values",
    [
        (rows.put_int, rows.get_int, [-(1 << 63), -(1 << 40), -70_000, -257, -256, -255, -2, -1, 0, 1, 109, 110, 255, 256, 65_536, (1 << 63) - 1]),
        (rows.put_float, rows.get_float, [-math.inf, -1e300, -1.5, -1e-300, 0.0, 5e-324, 1.0, 1e300, math.inf]),
        (rows.put_string, rows.get_string, ["", "\0", "\0\0", "\0a", "a", "a\0", "a\0b", "ab", "b", "é", "😀"]),
        (rows.put_time, rows.get_time, [dt.datetime(1, 1, 1, tzinfo=dt.timezone.utc), dt.datetime(1969, 12, 31, 23, 59, 59, 999999, dt.timezone.utc), dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc), dt.datetime(2024, 5, 6, 7, 8, 9, 1, dt.timezone.utc)]),
    ],
)
def test_fields_keep_their_order_and_come_back(put, get, values):
    packed = [put(v) for v in values]
    assert packed == sorted(packed) and [get(p, 0) for p in packed] == [(v, len(p)) for v, p in zip(values, packed)]


def test_nan_is_first():
    assert rows.put_float(math.nan) < rows.put_float(-math.inf) and math.isnan(rows.get_float(rows.put_float(math.nan), 0)[0])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="\0\x01a\xff", max_size=4), st.integers(-300, 300)), max_size=12))
def test_keys_order_like_their_values(pairs):
    kinds = [DimensionType.STRING, DimensionType.VARINT]
    packed = sorted(rows.pack_key(7, kinds, list(p)) for p in pairs)
    assert [rows.unpack_key(k, kinds) for k in packed] == [(7, list(p)) for p in sorted(pairs, key=lambda p: (p[0].encode(), p[1]))]


def test_remainders_and_missing_metrics():
    with pytest.raises(ValueError, match="unexpected key remainder"):
        rows.unpack_key(rows.pack_key(1, [DimensionType.VARINT], [5]) + b"\x88", [DimensionType.VARINT])
    with pytest.raises(ValueError, match="unexpected value remainder"):
        rows.unpack_value(b"\x88\x88", [MetricType.VARINT_SUM])
    for bad, kind in ((b"\x13a\0\x01", "STRING"), (b"\x12abc", "STRING"), (b"\xf7\x01", "VARINT"), (b"\x05\0", "FLOAT"), (b"\x88", "TIMESTAMP")):
        with pytest.raises(ValueError):
            rows.unpack_key(b"\x89" + bad, [DimensionType[kind]])
    assert rows.unpack_value(b"\x89", [MetricType.VARINT_SUM, MetricType.FLOAT_SUM, MetricType.STRING_HLL]) == [1, 0.0, []]


def state(words):
    best = {}
    for x in hll.registers(pa.array(words, pa.string())).tolist():
        best[x // 64] = max(best.get(x // 64, 0), x % 64)
    return np.array(sorted(k * 64 + v for k, v in best.items()), np.int64)


def test_known_sketches():
    """Fixed value: the opcodes of 'hello' alone."""
    assert hllbytes.to_bytes(state(["hello"])).hex() == "48594c4c01000000" + "00" * 8 + "72f5884d08"
    assert hllbytes.to_bytes(state([])).hex() == "48594c4c01000000" + "00" * 8 + "7fff"


@pytest.mark.parametrize("n", [0, 1, 2, 100, 1000, 1500, 20_000])
def test_sketches_come_back(n):
    s = state([f"v{i}" for i in range(n)])
    raw = hllbytes.to_bytes(s)
    assert (hllbytes.from_bytes(raw) == s).all() and (hllbytes.from_bytes(hllbytes.dense(s)) == s).all()
    assert raw[4] == (hllbytes.SPARSE if n <= 1000 else hllbytes.DENSE) and (raw[4] or len(raw) == 12_305)


def test_runs_and_large_rho():
    s = np.array([(5 + i) * 64 + 3 for i in range(11)] + [100 * 64 + 32], np.int64)
    assert (hllbytes.from_bytes(hllbytes.to_bytes(s)) == s).all() and len(hllbytes.to_bytes(s)) == 16 + 1 + 3 + 2 + 1 + 2
    big = np.array([7 * 64 + 33], np.int64)
    assert hllbytes.to_bytes(big)[4] == hllbytes.DENSE and (hllbytes.from_bytes(hllbytes.to_bytes(big)) == big).all()


@pytest.mark.parametrize("data", [b"", b"HYLX" + bytes(20), b"HYLL\x07" + bytes(20), b"HYLL\x00" + bytes(20), b"HYLL\x01" + bytes(11) + b"\x7f", b"HYLL\x01" + bytes(11) + b"\x7f\xfe"])
def test_other_bytes_are_refused(data):
    with pytest.raises(ValueError):
        hllbytes.from_bytes(data)


def test_states_as_text_and_back(spark, tmp_path):
    s = schema()
    folder, out = str(tmp_path / "hex"), []
    for tag in (1, 2):
        states = partials(s, s.views[tag], frame(spark), "exact")
        out.append(states)
    keyvalue.write_hex(rows.encode(s, 1, out[0]).unionByName(rows.encode(s, 2, out[1])), folder)
    lines = [r[0] for r in spark.read.text(folder).collect()]
    assert len(lines) == 8 and sorted(lines) == sorted(lines, key=lambda x: bytes.fromhex(x.partition("\t")[0]))
    pairs = keyvalue.read_hex(spark, folder)
    back = rows.decode(s, 2, pairs)
    assert sorted(tuples(back)) == sorted(tuples(out[1].select(back.columns)))
    words = rows.decode(s, 1, pairs)
    assert sorted(tuples(words.select("d5", "d4", "m2", "m5.value", "m3"))) == sorted(tuples(out[0].select("d5", "d4", "m2", "m5.value", "m3")))
    assert len(QUOTES) == 3 and sorted(tuples(back.select(hllbytes.sketch_state(hllbytes.sketch_bytes("m4")))), key=repr) == sorted(tuples(back.select("m4")), key=repr)
