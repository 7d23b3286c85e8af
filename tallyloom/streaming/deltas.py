"""Streams of delta events (writer, seq_no, row) through the two-phase commit, as a stateful operator.

The held events of a writer are its state in the state store, so they survive a restart with the query's checkpoint. A row is any
string, say JSON of a source row. position is an event's place in its writer's log, ascending (an offset of a topic, say): events are sorted by it
within a trigger, on disk if they are many, and the last one is kept in the state. An event that arrives after a later one, or again, is refused with
an error and changes nothing. What a writer holds between two acknowledgements is one state value, in one task: writers acknowledge often enough for that.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.streaming.runs import by_position
from tallyloom.streaming.transactions import DeltaEvent, SequenceError, Transactions

OUT = "writer string, seq_no long, row string, error string"
_ROWS = 2000  # of a frame that goes back to Spark


def committed(events: DataFrame) -> DataFrame:
    """Streaming events(writer, seq_no, row, position) to committed rows; a bad event gives a row with its error and changes nothing."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        writer = key[0]
        kept = json.loads(state.get[0]) if state.exists else {"txn": {}, "last": None}
        txn, last = Transactions.restore(kept["txn"]), kept["last"]
        out = []
        for seq_no, row, position in by_position(batches):
            try:
                if position is None:
                    raise SequenceError("event without a position")
                if last is not None and position <= last:
                    raise SequenceError(f"event out of order (position {position}, last position {last})")
                last = position
                out += [(writer, e.seq_no, e.row, None) for e in txn.apply(DeltaEvent(writer, seq_no, row))]
            except SequenceError as e:
                out.append((writer, seq_no, None, str(e)))
            if len(out) >= _ROWS:
                yield pd.DataFrame(out, columns=["writer", "seq_no", "row", "error"])
                out = []
        state.update((json.dumps({"txn": txn.snapshot(), "last": last}),))
        yield pd.DataFrame(out, columns=["writer", "seq_no", "row", "error"])

    return events.groupBy("writer").applyInPandasWithState(step, OUT, "txn string", "append", GroupStateTimeout.NoTimeout)
