"""Events of one writer in the order of their positions, by an external merge sort in the worker that has them.

At most RUN bytes of events are held; more go to sorted runs in unnamed files on the executor's own disk. FAN runs of a level are merged into one of the
next, and a run is read a block at a time, so memory is bounded by RUN and, for the runs that are open, by FAN blocks for each level.
"""

from __future__ import annotations

import heapq
import math
import os
import pickle
import sys
import tempfile
from collections.abc import Iterable, Iterator
from typing import IO, Any

import pandas as pd

RUN, BLOCK, FAN = 32 << 20, 256 << 10, 32
_EVENT = 200  # bytes of an event besides its row: a tuple, two numbers, its place in a list

Event = tuple[Any, str | None, int | None]  # seq_no, row, position


def _place(event: Event) -> float:
    return math.inf if event[2] is None else event[2]


def _size(event: Event) -> int:
    return _EVENT + sys.getsizeof(event[1])


def _write(events: Iterable[Event]) -> IO[bytes]:
    run = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
    block, size = [], 0
    for event in events:
        block.append(event)
        size += _size(event)
        if size >= BLOCK:
            pickle.dump(block, run, pickle.HIGHEST_PROTOCOL)
            block, size = [], 0
    pickle.dump(block, run, pickle.HIGHEST_PROTOCOL)
    run.seek(0)
    return run


def _read(run: IO[bytes]) -> Iterator[Event]:
    with run:
        while True:
            try:
                block = pickle.load(run)
            except EOFError:
                return
            yield from block


def _events(batches: Iterable[pd.DataFrame]) -> Iterator[Event]:
    for got in batches:
        rows, places = ([None if gone else x for gone, x in zip(got[c].isna().tolist(), got[c].tolist())] for c in ("row", "position"))
        yield from zip(got["seq_no"].tolist(), rows, (None if p is None else int(p) for p in places))


def by_position(batches: Iterable[pd.DataFrame]) -> Iterator[Event]:
    """Events of all batches by ascending position; equal positions in the order of arrival, events without one last."""
    levels: list[list[IO[bytes]]] = []  # those of a higher level arrived earlier
    held, size = [], 0
    for event in _events(batches):
        held.append(event)
        size += _size(event)
        if size < RUN:
            continue
        held.sort(key=_place)
        run, level = _write(held), 0
        held, size = [], 0
        while True:
            if level == len(levels):
                levels.append([])
            levels[level].append(run)
            if len(levels[level]) < FAN:
                break
            run, levels[level] = _write(heapq.merge(*map(_read, levels[level]), key=_place)), []
            level += 1
    held.sort(key=_place)
    yield from heapq.merge(*(_read(run) for level in reversed(levels) for run in level), held, key=_place)
