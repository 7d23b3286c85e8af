"""Two-phase commit of row events: rows of a writer take effect when its acknowledgement arrives, all or none.

A writer numbers its events upwards. A row event is held; an acknowledgement (an event without a row) of the last number or beyond commits what is
held, one of the number last committed discards it, and anything else is an error that leaves the state as it was.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class SequenceError(ValueError):
    pass


@dataclass(frozen=True)
class DeltaEvent:
    """row is None for an acknowledgement."""

    writer: str
    seq_no: int
    row: Any = None


@dataclass
class _Writer:
    committed: int = 0
    held: list[DeltaEvent] = field(default_factory=list)


class Transactions:
    def __init__(self):
        self._writers: dict[str, _Writer] = {}

    def apply(self, event: DeltaEvent) -> list[DeltaEvent]:
        """The row events that this one commits."""
        w = self._writers.setdefault(event.writer, _Writer())
        last = w.held[-1].seq_no if w.held else w.committed
        if event.row is not None:
            if event.seq_no <= last:
                raise SequenceError(f"repeat SeqNo (extractor {event.writer}, seqNo {event.seq_no})")
            w.held.append(event)
            return []
        if event.seq_no == w.committed:
            w.held = []
            return []
        if event.seq_no < last:
            raise SequenceError(f"unexpected commit SeqNo (seqNo: {event.seq_no}, last event: {last}, last commit: {w.committed})")
        done, w.held, w.committed = w.held, [], event.seq_no
        return done

    def snapshot(self) -> dict[str, dict]:
        """Plain data, to be kept together with the rows; restore() is its reverse."""
        return {k: {"committed": w.committed, "held": [(e.seq_no, e.row) for e in w.held]} for k, w in self._writers.items()}

    @classmethod
    def restore(cls, data: dict[str, dict]) -> Transactions:
        out = cls()
        for k, x in data.items():
            out._writers[k] = _Writer(x["committed"], [DeltaEvent(k, n, row) for n, row in x["held"]])
        return out
