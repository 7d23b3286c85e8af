"""Key and value bytes as text or frames, for exchange with tools outside Spark.

Text: hex of the key, a tab, hex of the value, one pair a line (what sorting tools and streaming jobs pass on).
Frames: four bytes of big-endian length of key, the same of value, then both; a frame beyond `cap` bytes is refused.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAP = 512 << 20


class TornRecord(ValueError):
    pass


def read_hex(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(key binary, value binary); a line that is not two runs of whole bytes in hex raises."""
    parts = F.split("value", "\t", -1)
    bad = F.raise_error(F.concat(F.lit("unexpected end of record: "), F.substring("value", 1, 60)))
    line = F.when(F.col("value").rlike(r"^(?:[0-9a-fA-F]{2})*\t(?:[0-9a-fA-F]{2})*$"), F.struct(F.unhex(parts[0]).alias("key"), F.unhex(parts[1]).alias("value"))).otherwise(bad)
    return spark.read.text(path).select(line.alias("kv")).select("kv.*")


def write_hex(pairs: DataFrame, path: str) -> None:
    """pairs(key, value) as text, sorted by key within and across part files."""
    pairs.orderBy("key").select(F.concat(F.lower(F.hex("key")), F.lit("\t"), F.lower(F.hex("value"))).alias("value")).write.text(path)


def frame(key: bytes, value: bytes, cap: int = CAP) -> bytes:
    if len(key) + len(value) > cap:
        raise ValueError(f"frame of {len(key) + len(value)} bytes is beyond {cap}")
    return struct.pack(">II", len(key), len(value)) + key + value


def write_frames(pairs: Iterable[tuple[bytes, bytes]], out: BinaryIO, cap: int = CAP) -> None:
    for key, value in pairs:
        out.write(frame(key, value, cap))


def read_frames(stream: BinaryIO, cap: int = CAP) -> Iterator[tuple[bytes, bytes]]:
    def exactly(n: int) -> bytes:
        got = stream.read(n)
        if len(got) < n:
            raise TornRecord("unexpected end of frame")
        return got

    while first := stream.read(1):
        key, value = struct.unpack(">II", first + exactly(7))
        if key + value > cap:
            raise ValueError(f"frame of {key + value} bytes is beyond {cap}")
        yield exactly(key), exactly(value)
