"""Counters of a running job, by source.

Lines read and parsed are observed in the stream's own plan (``observe``) and come
with its progress events; deliveries come from the reports of the sinks.  Both
arrive per micro-batch and are merged once per batch, so a replay counts once.
Like the counters of a process they start with the driver; nothing is scanned
again for them and nothing but sums reaches the driver.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from riverlog.operators.observe import TOTAL
from riverlog.sinks.outlets import Delivery

_READ, _PARSED = "riverlog_read_", "riverlog_parsed_"
_TABLE = (
    "source string, lines_read bigint, lines_parsed bigint, parse_errors bigint, sink_writes bigint, "
    "sink_errors bigint, lines_dropped bigint, uptime_seconds double"
)


class LiveCounters(StreamingQueryListener):
    """Pass to ``Job.start(counters=...)``; ``table`` gives the counts so far."""

    def __init__(self) -> None:
        self.sources: list[str] = []
        self._lock = threading.Lock()
        self._begun = time.monotonic()
        self._progress: dict[tuple[str, int], dict[str, int]] = {}
        self._deliveries: dict[int, Delivery] = {}
        self._query: str | None = None

    def read(self, lines: DataFrame, number: int) -> DataFrame:
        return lines.observe(f"{_READ}{number}", F.count(F.lit(1)).alias("n"))

    def parsed(self, entries: DataFrame, number: int) -> DataFrame:
        return entries.observe(f"{_PARSED}{number}", F.count(F.lit(1)).alias("n"))

    def delivered(self, batch_id: int, delivery: Delivery) -> None:
        with self._lock:
            self._deliveries[batch_id] = delivery

    def follow(self, query_id: str, sources: Sequence[str]) -> None:
        self._query, self.sources = query_id, list(sources)

    def onQueryStarted(self, event) -> None:  # noqa: N802 - Spark's name
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        counts = {name: row["n"] for name, row in progress.observedMetrics.items() if name.startswith((_READ, _PARSED))}
        with self._lock:
            self._progress[str(progress.id), progress.batchId] = counts

    def batches(self) -> int:
        """How many micro-batches are counted."""
        with self._lock:
            return sum(query == self._query for query, _ in self._progress)

    def wait(self, batches: int, seconds: float = 30.0) -> None:
        """Until so many micro-batches are counted: progress events come late."""
        deadline = time.monotonic() + seconds
        while self.batches() < batches and time.monotonic() < deadline:
            time.sleep(0.05)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per source of the job, and one for all, named ``*``."""
        with self._lock:
            progress = [counts for (query, _), counts in self._progress.items() if query == self._query]
            deliveries = list(self._deliveries.values())
        uptime = time.monotonic() - self._begun
        rows = []
        for number, source in enumerate(self.sources):
            read = sum(counts.get(f"{_READ}{number}", 0) for counts in progress)
            parsed = sum(counts.get(f"{_PARSED}{number}", 0) for counts in progress)
            both = [o.by_origin.get(source, [0, 0]) for delivery in deliveries for o in delivery.outcomes]
            reached = sum(delivery.reached.get(source, 0) for delivery in deliveries)
            writes, errors = sum(pair[0] for pair in both), sum(pair[1] for pair in both)
            rows.append((source, read, parsed, read - parsed, writes, errors, read - reached, uptime))
        rows.append((TOTAL, *[sum(row[at] for row in rows) for at in range(1, 7)], uptime))
        return spark.createDataFrame(rows, _TABLE)
