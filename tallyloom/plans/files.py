"""Small files through Hadoop's file systems, so that manifests and catalogs can be wherever Spark can write."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class AlreadyThere(RuntimeError):
    """Someone else has written that version."""


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it is not there."""
    at, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def listing(spark: SparkSession, path: str) -> list[tuple[str, float, int]]:
    """(path, modification time in seconds, bytes) of all files under path that are no side files."""
    at, fs = _path(spark, path)
    if not fs.exists(at):
        return []
    found, it = [], fs.listFiles(at, True)
    while it.hasNext():
        s = it.next()
        if not s.getPath().getName().startswith(("_", ".")):
            found.append((s.getPath().toString(), s.getModificationTime() / 1000, s.getLen()))
    return sorted(found)


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def modified(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """(name, modification time in seconds) of what a folder holds; nothing if it is not there."""
    at, fs = _path(spark, path)
    return sorted((s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(at)) if fs.exists(at) else []


def touch(spark: SparkSession, path: str) -> None:
    """An empty file."""
    at, fs = _path(spark, path)
    fs.create(at, True).close()


def read_text(spark: SparkSession, path: str) -> str:
    at, fs = _path(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a whole new file, or raises AlreadyThere: written under another name, then renamed without overwriting."""
    jvm = spark.sparkContext._jvm
    temp = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}.tmp"
    at, fs = _path(spark, temp)
    stream = fs.create(at, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    target = jvm.org.apache.hadoop.fs.Path(path)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    qualified = [fs.makeQualified(p) for p in (at, target)]
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified[0].toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(*qualified, options)
    except Exception as e:
        fs.delete(at, False)
        if fs.exists(target):
            raise AlreadyThere(path) from e
        raise


class Versions:
    """Numbered JSON documents under a folder; the highest number is current, and committing takes the next one or fails."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 20):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _numbers(self) -> list[int]:
        return [int(n[:-5]) for n in names(self.spark, self.folder) if n.endswith(".json") and n[:-5].isdigit()]

    def read(self) -> tuple[int, Any]:
        """(number, document); (0, None) if there is none yet."""
        if not (numbers := self._numbers()):
            return 0, None
        return max(numbers), json.loads(read_text(self.spark, self._file(max(numbers))))

    def commit(self, after: int, document: Any) -> int:
        """Writes document as the successor of version `after`; raises AlreadyThere if it has one, also one that has been pruned meanwhile."""
        if max(self._numbers(), default=0) > after:
            raise AlreadyThere(self._file(after + 1))
        create_text(self.spark, self._file(after + 1), json.dumps(document))
        numbers = self._numbers()
        # Versions go in ascending order. If `after` is still there, then no successor of it has been pruned, so this is the first.
        if (after not in numbers) if after else (max(numbers) > self.keep):
            delete(self.spark, self._file(after + 1))
            raise AlreadyThere(self._file(after + 1))
        for old in sorted(numbers):
            if old <= after + 1 - self.keep:
                delete(self.spark, self._file(old))
        return after + 1

    def _file(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"
