"""Who is connected and what is running, as a stream with timers.

A client's session lives while it is open or has an event stream, and for `IDLE` after it was last seen. A call that has not
ended `LIMIT` after it began is reported once. Rows wait in the state until the watermark has passed them and then take effect in the order of
their time, so results do not depend on how the stream was cut into batches, and are those of the same rows in one batch.

State of a client: its rows above the watermark, packed as compressed Arrow, one row for its session and one packed list of the calls that run and
are not yet reported; all of it goes when the session ends and nothing runs. One client's rows meet in one task, as their order decides; clients are spread.
A row costs the same however many calls run: calls stand in the order of their begin, so only the first can be over its limit.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MINUTE = 60_000_000
IDLE, LIMIT = 30 * MINUTE, 10 * MINUTE
#: Rows of a packed piece, and of a frame that goes out.
PIECE = 10_000

#: kind: open, close, stream, unstream, begin, end or seen; call: of begin and end; at: microseconds
INPUT = "client string, ts timestamp, at long, place long, kind string, call long"
OUTPUT = "client string, what string, since long, until long, last_seen long, calls long, call long"
_SESSION = "since long, seen long, calls long, open long, streams long"
_WAITING = pa.schema([("at", pa.int64()), ("place", pa.int64()), ("kind", pa.string()), ("call", pa.int64())])
_RUNNING = pa.schema([("call", pa.int64()), ("began", pa.int64())])


def _packed(rows: pa.Table) -> Iterator[tuple[bytes]]:
    """Rows as pieces for a list in the state."""
    for first in range(0, rows.num_rows, PIECE):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows.slice(first, PIECE))
        yield (sink.getvalue().to_pybytes(),)


def _unpacked(pieces: Iterator[tuple], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(bytes(x[0])).read_all() for x in pieces)])


class Live(StatefulProcessor):
    def __init__(self, idle: int = IDLE, limit: int = LIMIT) -> None:
        self.idle, self.limit = idle, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", _SESSION)
        self.waiting = handle.getListState("waiting", "rows binary")
        self.running = handle.getListState("running", "rows binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        mark, first = timerValues.getCurrentWatermarkInMs() * 1000, None
        for frame in rows:
            new = pa.Table.from_pandas(frame[_WAITING.names], _WAITING, preserve_index=False)
            for piece in _packed(new):
                self.waiting.appendValue(piece)
            if new.num_rows:
                least = pc.min(new["at"]).as_py()
                first = least if first is None else min(first, least)
        if first is not None and first <= mark:
            yield from self._advanced(key, mark)
        elif first is not None:
            self._timed(-(-first // 1000), list(self.handle.listTimers()))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._advanced(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass

    def _advanced(self, key: Any, mark: int) -> Iterator[pd.DataFrame]:
        """Everything up to the watermark takes effect; the next timer is set at the first time at which something may."""
        waiting = _unpacked(self.waiting.get(), _WAITING).sort_by([("at", "ascending"), ("place", "ascending")])
        due = pc.sum(pc.less_equal(waiting["at"], mark)).as_py() or 0
        found = self.session.get()
        session = list(found) if found is not None else None
        before = _unpacked(self.running.get(), _RUNNING)
        running = OrderedDict(zip(*(c.to_pylist() for c in before.columns)))  # call: its begin, in that order
        out: list[tuple] = []

        def passed(now: int) -> None:
            """Ends what ends before `now`."""
            nonlocal session
            while running and next(iter(running.values())) + self.limit < now:
                call, began = running.popitem(last=False)
                out.append((key[0], "overdue", began, began + self.limit, None, None, call))
            if session and not session[3] and not session[4]:
                end = session[1] + self.idle
                if end < now:
                    out.append((key[0], "session", session[0], end, session[1], session[2], None))
                    session = None

        for first in range(0, due, PIECE):
            part = waiting.slice(first, min(PIECE, due - first))
            for at, kind, call in zip(*(part[c].to_pylist() for c in ("at", "kind", "call"))):
                passed(at)
                session = session or [at, at, 0, 0, 0]
                session[1] = at
                session[2] += kind == "begin"
                session[3] = max(0, session[3] + (kind == "open") - (kind == "close"))
                session[4] = max(0, session[4] + (kind == "stream") - (kind == "unstream"))
                if kind == "begin":
                    running[call] = at
                    running.move_to_end(call)
                elif kind == "end":
                    running.pop(call, None)
            if len(out) >= PIECE:
                yield self._told(out)
                out.clear()
        passed(mark + 1)
        later = [waiting["at"][due].as_py()] if due < waiting.num_rows else []
        later += [began + self.limit for began in list(running.values())[:1]]
        if session and not session[3] and not session[4]:
            later.append(session[1] + self.idle)
        self._timed(-(-min(later) // 1000) if later else None)
        if due:
            self._put(self.waiting, waiting.slice(due))
        self.session.update(tuple(session)) if session else self.session.clear()
        if due or len(running) != before.num_rows:
            self._put(self.running, pa.table([list(running), list(running.values())], _RUNNING))
        yield self._told(out)

    def _told(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[x.split()[0] for x in OUTPUT.split(", ")])

    def _put(self, state: Any, rows: pa.Table) -> None:
        state.clear()
        for piece in _packed(rows):
            state.appendValue(piece)

    def _timed(self, at: int | None, others: list[int] | None = None) -> None:
        """The one timer is at `at`; where others are given, at the first of all."""
        if others and min(others) <= at:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(at)


def live(events: DataFrame, late: str = "10 minutes", idle: int = IDLE, limit: int = LIMIT) -> DataFrame:
    """Sessions that have ended and calls that ran over their limit, from a stream of `INPUT` rows. Times are microseconds; `place` orders rows of one time.

    The session needs RocksDB as its state store: see `rocksdb`.
    """
    rows = events.select(*(x.split()[0] for x in INPUT.split(", "))).withWatermark("ts", late)
    return rows.groupBy("client").transformWithStateInPandas(Live(idle, limit), OUTPUT, "Append", "EventTime")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State with timers and several variables needs this store; streams that are started inside have it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)
