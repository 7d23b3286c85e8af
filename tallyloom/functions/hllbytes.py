"""Distinct-count states as the bytes that Redis keeps for them (its published format), for exchange with other tools.

A header of 16 bytes ("HYLL", the encoding, three unused bytes, eight of cached count), then registers. Dense: 6 bits each, least
significant first, and a byte at the end. Sparse: runs as opcodes, ZERO 00nnnnnn, XZERO 01nnnnnn nnnnnnnn, VAL 1vvvvvnn (n + 1
registers of v + 1). Here a state is what functions.hll keeps: sorted register * 64 + rho.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from tallyloom.functions.hll import REGISTERS

# Fixed values of the format.
MAGIC = b"HYLL"
DENSE, SPARSE = 0, 1
HEADER = 16
DENSE_SIZE = HEADER + REGISTERS * 6 // 8 + 1
SPARSE_MOST = 2500  # bytes beyond which a sparse sketch becomes dense
SPARSE_RHO = 32  # the largest rho that an opcode holds


def _header(encoding: int) -> bytes:
    return MAGIC + bytes([encoding, 0, 0, 0]) + bytes(8)


def _skip(n: int) -> bytes:
    """n registers of zero."""
    out = b""
    while n > 0:
        k = min(n, REGISTERS)
        out += bytes([k - 1]) if k <= 64 else (0x4000 | k - 1).to_bytes(2, "big")
        n -= k
    return out


def dense(state: np.ndarray) -> bytes:
    rho = np.zeros(REGISTERS, np.uint8)
    rho[state >> 6] = state & 63
    bits = np.unpackbits(rho[:, None], axis=1, count=6, bitorder="little")
    return _header(DENSE) + np.packbits(bits.ravel(), bitorder="little").tobytes() + b"\0"


def to_bytes(state: np.ndarray) -> bytes:
    """Sparse while that is short and no rho is too large, otherwise dense."""
    state = np.asarray(state, np.int64)
    if len(state) > SPARSE_MOST or len(state) and (state & 63).max() > SPARSE_RHO:
        return dense(state)
    out, at, i = [], 0, 0
    register, rho = (state >> 6).tolist(), (state & 63).tolist()
    while i < len(register):
        out.append(_skip(register[i] - at))
        k = 1
        while k < 4 and i + k < len(register) and register[i + k] == register[i] + k and rho[i + k] == rho[i]:
            k += 1
        out.append(bytes([0x80 | rho[i] - 1 << 2 | k - 1]))
        at, i = register[i] + k, i + k
    out.append(_skip(REGISTERS - at))
    sparse = _header(SPARSE) + b"".join(out)
    return sparse if len(sparse) <= SPARSE_MOST + HEADER else dense(state)


def from_bytes(data: bytes) -> np.ndarray:
    """The state that such bytes hold; raises for anything else."""
    if len(data) < HEADER or data[:4] != MAGIC or data[4] not in (DENSE, SPARSE):
        raise ValueError("not a sketch")
    rho = np.zeros(REGISTERS, np.int64)
    if data[4] == DENSE:
        if len(data) < DENSE_SIZE - 1:
            raise ValueError("dense sketch is too short")
        bits = np.unpackbits(np.frombuffer(data, np.uint8, REGISTERS * 6 // 8, HEADER), bitorder="little")
        rho = (bits.reshape(-1, 6).astype(np.int64) << np.arange(6)).sum(1)
    else:
        at, i = 0, HEADER
        while i < len(data):
            op = data[i]
            if op & 0x80:
                n = (op & 3) + 1
                rho[at : at + n] = (op >> 2 & 31) + 1
            elif op & 0x40:
                if i + 1 == len(data):
                    raise ValueError("sparse sketch ends inside an opcode")
                i += 1
                n = ((op & 63) << 8 | data[i]) + 1
            else:
                n = (op & 63) + 1
            at, i = at + n, i + 1
        if at != REGISTERS:
            raise ValueError(f"sparse sketch has {at} registers, not {REGISTERS}")
    used = np.flatnonzero(rho)
    return used * 64 + rho[used]


@F.pandas_udf(BinaryType())
def sketch_bytes(states: pd.Series) -> pd.Series:
    return states.map(lambda s: to_bytes(np.array([] if s is None else s, np.int64)))


@F.pandas_udf(ArrayType(IntegerType()))
def sketch_state(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else from_bytes(bytes(b)).astype(np.int32))
