"""Counts of runs and of streams, taken while they run and kept in a table.

Observed counts are made by the job that writes the rows, not by another pass. A stream's progress
comes from its listener; what is told between two calls of flush() waits on the driver, a few numbers
for each micro-batch.
"""

from __future__ import annotations

import threading
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from plumbline.sources.commits import Log

SCHEMA = "source string, run string, metric string, value double, at timestamp"


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """df with its rows, and what is given by name as aggregates, counted as it is read; the observation has them after an action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in counts.items())), seen


def record(spark: SparkSession, folder: str, run: str, *seen: Observation, names: tuple[str, ...] = ()) -> None:
    """Commits the numbers of observations of one run. names: theirs, else their places from 0."""
    now = datetime.now(timezone.utc)
    rows = [(names[k] if k < len(names) else f"{k}", run, metric, None if value is None else float(value), now) for k, x in enumerate(seen) for metric, value in x.get.items()]
    _commit(spark, folder, rows)


def _commit(spark: SparkSession, folder: str, rows: list[tuple]) -> None:
    if rows:
        log = Log(folder)
        name = log.staged(spark.createDataFrame(rows, SCHEMA).coalesce(1))
        log.commit(lambda read: {"data": name})


class StreamMetrics(StreamingQueryListener):
    """Rows and durations (ms) of every micro-batch of the session's streams; add it to spark.streams."""

    def __init__(self):
        self._rows: list[tuple] = []
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        at = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
        found = {"rows": p.numInputRows, **{f"ms {k}": v for k, v in p.durationMs.items()}, **{f"state rows {k}": s.numRowsTotal for k, s in enumerate(p.stateOperators)}}
        with self._lock:
            self._rows += [(p.name or str(p.id), f"{p.runId}/{p.batchId}", metric, float(value), at) for metric, value in found.items()]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._rows.append((str(event.id), str(event.runId), "failed", float(event.exception is not None), datetime.now(timezone.utc)))

    def flush(self, spark: SparkSession, folder: str) -> int:
        """Commits what was told since; how many numbers."""
        with self._lock:
            rows, self._rows = self._rows, []
        _commit(spark, folder, rows)
        return len(rows)
