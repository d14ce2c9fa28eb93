"""Numbers that running plans give on their way: no second scan counts what a write or a stream has already seen.

`Metrics` holds counters, latencies and gauges of this driver; the numbers of an action come with it (`Observation`), those of a stream
with each of its batches (`StreamMetrics`), and gauges that need a job of their own are kept for a time.
"""

from __future__ import annotations

import time
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable
from threading import Lock

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from .operators.logs import LATENCY_MS
from .sources import markdown

Labels = tuple[tuple[str, str], ...]


class Metrics:
    """Counters and latency histograms by name and labels; safe for several threads."""

    def __init__(self) -> None:
        self.counters: dict[tuple[str, Labels], float] = defaultdict(float)
        self.latencies: dict[tuple[str, Labels], list[float]] = defaultdict(lambda: [0] * (len(LATENCY_MS) + 1) + [0.0])
        self._lock = Lock()

    def add(self, name: str, n: float, **labels: str) -> None:
        with self._lock:
            self.counters[name, tuple(sorted(labels.items()))] += n

    def took(self, name: str, ms: float, **labels: str) -> None:
        with self._lock:
            own = self.latencies[name, tuple(sorted(labels.items()))]
            own[bisect_left(LATENCY_MS, ms)] += 1
            own[-1] += ms

    def write(self, rows: DataFrame, action: Callable[[DataFrame], None], name: str, counts: dict[str, Column], **labels: str) -> dict[str, int]:
        """Runs an action over rows; what it saw of them is added to the counters `<name>_<count>`, and its time to `<name>_ms`."""
        seen, began = Observation(), time.monotonic()
        action(rows.observe(seen, *(c.alias(k) for k, c in counts.items())))
        got = {k: int(v or 0) for k, v in seen.get.items()}
        for k, v in got.items():
            self.add(f"{name}_{k}", v, **labels)
        self.took(f"{name}_ms", (time.monotonic() - began) * 1000, **labels)
        return got

    def lines(self, spark: SparkSession) -> DataFrame:
        """All of it as exposition text; histograms are cumulative."""
        rows: list[tuple] = []
        for (name, labels), n in sorted(self.counters.items()):
            rows.append((name, "Counted by running plans.", "counter", dict(labels), "", float(n)))
        for (name, labels), own in sorted(self.latencies.items()):
            total = 0
            for bound, n in zip([*map(str, LATENCY_MS), "+Inf"], own):
                total += n
                rows.append((name, "Milliseconds.", "histogram", dict(labels) | {"le": bound}, "_bucket", float(total)))
            rows += [(name, "Milliseconds.", "histogram", dict(labels), "_sum", own[-1]), (name, "Milliseconds.", "histogram", dict(labels), "_count", float(total))]
        return markdown.prometheus_lines(spark.createDataFrame(rows, "name string, help string, type string, labels map<string,string>, suffix string, value double"))


class StreamMetrics(StreamingQueryListener):
    """Adds the observed numbers of every batch of every stream to the counters, labelled with the stream's name. Register it with `spark.streams.addListener`."""

    def __init__(self, metrics: Metrics) -> None:
        self.metrics = metrics

    def onQueryStarted(self, event) -> None:
        self.metrics.add("streams_started", 1)

    def onQueryProgress(self, event) -> None:
        name = event.progress.name or ""
        for observed, row in event.progress.observedMetrics.items():
            for k, v in row.asDict().items():
                self.metrics.add(f"{observed}_{k}", v or 0, stream=name)
        self.metrics.took("batch_ms", event.progress.batchDuration, stream=name)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.metrics.add("streams_failed" if event.exception else "streams_ended", 1)


class Gauges:
    """What a job finds, kept for `ttl_ms`; a read in that time runs no job."""

    def __init__(self, read: Callable[[], list], ttl_ms: int = 5_000) -> None:
        self.read, self.ttl_ms, self._at, self._rows = read, ttl_ms, None, []

    def rows(self, now_ms: int) -> list:
        if self._at is None or not 0 <= now_ms - self._at < self.ttl_ms:
            self._rows, self._at = self.read(), now_ms
        return self._rows
