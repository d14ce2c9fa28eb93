"""Timed sessions: batches, disorder within the watermark and a restart give what one look at all rows gives."""

import random
import time

import pandas as pd
from pyspark.sql import functions as F

from passagework.streaming import live

MIN = live.MINUTE


def all_at_once(rows, mark):
    """Sessions and overdue calls of rows up to the mark, one row after the other."""
    out = []
    for client in {r[0] for r in rows}:
        own, session, running = sorted((at, place, kind, call) for c, at, place, kind, call in rows if c == client and at <= mark), None, {}
        for at, _, kind, call in [*own, (mark + 0.5, None, None, None)]:
            for c, began in list(running.items()):
                if began + live.LIMIT < at:
                    out.append((client, "overdue", began, began + live.LIMIT, None, None, c))
                    del running[c]
            if session and not session[3] and not session[4] and session[1] + live.IDLE < at:
                out.append((client, "session", session[0], session[1] + live.IDLE, session[1], session[2], None))
                session = None
            if kind is None:
                break
            session = session or [at, at, 0, 0, 0]
            session[1] = at
            session[2] += kind == "begin"
            for i, (up, down) in ((3, ("open", "close")), (4, ("stream", "unstream"))):
                session[i] = max(0, session[i] + (kind == up) - (kind == down))
            if kind == "begin":
                running[call] = at
            elif kind == "end":
                running.pop(call, None)
    return sorted(out, key=str)


def test_batches_disorder_and_restart(spark, tmp_path):
    rng, rows, at = random.Random(9), [], 1_700_000_000 * 1_000_000
    for place in range(260):
        at += rng.choice([0, MIN // 7, 2 * MIN, 11 * MIN, 35 * MIN]) if place else 0
        kind = rng.choice(["open", "close", "close", "stream", "unstream", "begin", "begin", "end", "seen"])
        call = place if kind == "begin" else place - rng.randint(1, 4) if kind == "end" else None
        rows.append((rng.choice("abc"), at, place, kind, call))
    rows.append(("z", at + 600 * MIN, 999, "seen", None))  # brings the watermark past all others
    parts = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    for i in range(len(parts) - 1):  # neighbours in time change batches
        parts[i][-1], parts[i + 1][0] = parts[i + 1][0], parts[i][-1]

    def run(some):
        for i, part in some:
            spark.createDataFrame(part, "client string, at long, place long, kind string, call long").withColumn("ts", F.timestamp_micros("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/p{i}")
        stream = spark.readStream.schema("client string, at long, place long, kind string, call long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
        with live.rocksdb(spark):
            live.live(stream, late="12 hours").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    run(list(enumerate(parts))[:2])
    run(list(enumerate(parts))[2:])
    got = sorted((tuple(r) for r in spark.read.schema(live.OUTPUT).parquet(f"{tmp_path}/out").collect()), key=str)
    mark = (max(r[1] for r in rows) // 1000 - 12 * 3_600_000) * 1000
    want = all_at_once(rows, mark)
    assert got == want and {r[1] for r in got} == {"session", "overdue"}


class _State:
    """What a processor asks of its handle, in memory."""

    def __init__(self):
        self.held, self.timers = {}, set()

    def _of(self, name, *_):
        state = _State()
        state.held = self.held.setdefault(name, {})
        return state

    getValueState = getListState = getMapState = _of

    def get(self):
        return iter(self.held.get("list", [])) if "list" in self.held else self.held.get("value") or iter(())

    def appendValue(self, x):
        self.held.setdefault("list", []).append(x)

    def clear(self):
        self.held.clear()

    def listTimers(self):
        return list(self.timers)

    registerTimer = lambda self, t: self.timers.add(t)
    deleteTimer = lambda self, t: self.timers.discard(t)
    iterator = lambda self: iter(self.held.get("map", {}).items())
    keys = lambda self: iter(self.held.get("map", {}))

    def put(self, rows):
        self.held["list"] = list(rows)

    def update(self, x):
        self.held["value"] = x

    def updateValue(self, k, x):
        self.held.setdefault("map", {})[k] = x

    def removeKey(self, k):
        self.held["map"].pop(k)


class _Mark:
    def __init__(self, us):
        self.ms = us // 1000

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_client_with_very_many_calls_costs_its_rows(tmp_path):
    """60,000 calls of one open client that never end: each is reported once, and a row does not look at the others."""
    n, start = 60_000, 1_700_000_000 * 1_000_000
    session, handle, p = _State(), _State(), live.Live()
    session.get = lambda: session.held.get("value")
    handle.getValueState = lambda *_: session
    p.init(handle)
    rows = [(start, 0, "open", None)] + [(start + i * 100_000, i, "begin", i) for i in range(1, n)]
    frames = [pd.DataFrame(rows[i : i + 10_000], columns=["at", "place", "kind", "call"]) for i in range(0, n, 10_000)]
    began, mark = time.time(), start + n * 100_000
    out = [f for f in p.handleInputRows(("a",), iter(frames[::-1]), _Mark(0))]
    out += [f for f in p.handleExpiredTimer(("a",), _Mark(mark), None)]
    told = pd.concat([f for f in out if len(f)])
    assert time.time() - began < 20
    assert sorted(told["call"]) == [i for i in range(1, n) if start + i * 100_000 + live.LIMIT <= mark]
    assert (told["what"] == "overdue").all() and len(handle.timers) == 1
