"""Streaming forms of limits, liveness, single use, leases and state machines.

Each function takes a streaming (or static) DataFrame of events with a TIMESTAMP column and
returns one; run() drives it to the end of what is there. Keyed state is bounded by watermarks or
by one small value per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATE = "1 hour"


def stream(spark: SparkSession, path: str, like: DataFrame, ts: str = "ts") -> DataFrame:
    """Parquet files under a folder as they arrive, with event time as a TIMESTAMP."""
    return spark.readStream.schema(like.schema).parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def run(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs to the end of the input. The results go to a table of Parquet files beside the checkpoint: appended, or in
    other modes the rows of each batch (of the last one, if complete)."""
    spark, path = df.sparkSession, f"{checkpoint.rstrip('/')}-{name}"

    def write(batch: DataFrame, n: int) -> None:
        # Named by the batch: one that is done again takes its own place.
        batch.write.mode("overwrite").parquet(f"{path}/batch={n if mode != 'complete' else 0}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/batch=*")


def hourly_limit(events: DataFrame, tenant: str, ts: str, most: int, width: str = "1 hour", slide: str = "10 minutes") -> DataFrame:
    """Tenants with at least `most` events in a sliding window."""
    w = events.withWatermark(ts, LATE).groupBy(F.window(ts, width, slide).alias("w"), tenant).agg(F.count(F.lit(1)).alias("n"))
    return w.filter(F.col("n") >= most).select(tenant, F.col("w.start").alias("start"), "n")


def daily_counts(events: DataFrame, tenant: str, ts: str) -> DataFrame:
    """Tumbling days; late events within the watermark count."""
    return events.withWatermark(ts, LATE).groupBy(F.window(ts, "1 day").alias("w"), tenant).agg(F.count(F.lit(1)).alias("n")).select(tenant, F.col("w.start").alias("day"), "n")


def liveness(events: DataFrame, worker: str, ts: str, gap: str) -> DataFrame:
    """Closed sessions of workers: a worker was silent for `gap` after each."""
    return events.withWatermark(ts, LATE).groupBy(worker, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("beats")).select(worker, F.col("w.start").alias("start"), F.col("w.end").alias("silent_from"), "beats")


def single_use(events: DataFrame, keys: list[str], ts: str, horizon: str = "7 days") -> DataFrame:
    """First use of each authorization within the horizon; replays go."""
    return events.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)


def admitted(events: DataFrame, windows: DataFrame, campaign: str, ts: str) -> DataFrame:
    """Events within their campaign's half-open window (a static table)."""
    return events.join(windows, campaign).filter((F.col(ts) >= F.col("opens_at")) & (F.col(ts) < F.col("closes_at")))


class Leases(StatefulProcessor):
    """Lease and use events in order of (ts, event_id): a lease is given when none runs, and raises the generation."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("lease", "generation int, until double, used boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        generation, until, used = self.state.get() if self.state.exists() else (0, 0.0, False)
        out = []
        for r in sorted((r for part in rows for r in part.itertuples(index=False)), key=lambda r: (r.ts, r.event_id)):
            t = r.ts.timestamp()
            given = r.kind == "lease" and until <= t and not used
            taken = r.kind == "use" and t < until
            if given:
                generation, until = generation + 1, t + self.seconds
            used = used or taken
            out.append((key[0], r.event_id, generation, "leased" if given else "used" if taken else "refused"))
        self.state.update((generation, until, used))
        yield pd.DataFrame(out, columns=["key", "event_id", "generation", "decision"])

    def close(self) -> None:
        pass


def leases(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """events: key (long), event_id, ts, kind (lease or use). One decision for each event."""
    e = events.select(F.col(key).alias("key"), "event_id", "ts", "kind")
    return e.groupBy("key").transformWithStateInPandas(Leases(seconds), "key long, event_id long, generation int, decision string", "append", "None")


#: What may follow each state of a submission.
MOVES = {None: ("quarantining",), "quarantining": ("queued", "rejected"), "queued": ("grading",), "grading": ("completed", "failed", "queued"), "completed": (), "failed": (), "rejected": ()}


class Machine(StatefulProcessor):
    """Follows each submission's state; events that don't fit are reported and change nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "status string, attempt int, head long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, attempt, head = self.state.get() if self.state.exists() else (None, 0, -1)
        out = []
        for r in sorted((r for part in rows for r in part.itertuples(index=False)), key=lambda r: (r.ts, r.event_id)):
            fits = r.status in MOVES[status] and r.event_id > head  # the accepted head never goes back
            if fits:
                status, head, attempt = r.status, r.event_id, attempt + (r.status == "grading")
            out.append((key[0], r.event_id, status, attempt, fits))
        self.state.update((status, attempt, head))
        yield pd.DataFrame(out, columns=["key", "event_id", "status", "attempt", "accepted"])

    def close(self) -> None:
        pass


def state_machine(events: DataFrame, key: str) -> DataFrame:
    """events: key (long), event_id, ts, status."""
    e = events.select(F.col(key).alias("key"), "event_id", "ts", "status")
    return e.groupBy("key").transformWithStateInPandas(Machine(), "key long, event_id long, status string, attempt int, accepted boolean", "append", "None")


class Jobs(StatefulProcessor):
    """Grading jobs that recover by themselves: a claim sets a timer, and a job that is still grading
    when it rings has failed (after `most` attempts), waits for a lease that runs, goes back to
    quarantine (its verdict was consumed) or back to the queue."""

    def __init__(self, seconds: int, most: int):
        self.millis, self.most = seconds * 1000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, attempt int, due long, lease long, verdict string")

    def get(self) -> tuple:
        return self.state.get() if self.state.exists() else (None, 0, 0, 0, None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, attempt, due, lease, verdict = self.get()
        out = []
        for r in sorted((r for part in rows for r in part.itertuples(index=False)), key=lambda r: (r.ts, r.event_id)):
            at = int(r.ts.timestamp() * 1000)
            if r.kind == "claimed" and status == "queued":
                status, attempt, due = "grading", attempt + 1, at + self.millis
                self.handle.registerTimer(due)
            elif r.kind == "leased":
                verdict, lease = "leased", at + int(r.seconds * 1000)
            elif r.kind == "consumed":
                verdict = "consumed"
            elif r.kind == "queued" and status in (None, "quarantining"):
                status = "queued"
            elif r.kind == "completed" and status == "grading":
                self.handle.deleteTimer(due)
                status = "completed"
            else:
                continue
            out.append((key[0], r.event_id, status, attempt, r.kind))
        self.state.update((status, attempt, due, lease, verdict))
        yield pd.DataFrame(out, columns=["key", "event_id", "status", "attempt", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, attempt, due, lease, verdict = self.get()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if status != "grading" or now < due:
            return
        if attempt >= self.most:
            status, reason = "failed", "grading_timeout"
        elif verdict == "leased" and lease > now:
            due, reason = lease, "lease runs"
            self.handle.registerTimer(due)
        elif verdict == "consumed":
            status, verdict, reason = "quarantining", None, "stale"
        else:
            status, reason = "queued", "stale"
        self.state.update((status, attempt, due, lease, verdict))
        yield pd.DataFrame([(key[0], None, status, attempt, reason)], columns=["key", "event_id", "status", "attempt", "reason"]).astype({"event_id": "Int64"})

    def close(self) -> None:
        pass


def recovering_jobs(events: DataFrame, key: str, seconds: int = 900, most: int = 3, late: str = "0 seconds") -> DataFrame:
    """events: key (long), event_id, ts, kind (queued, claimed, leased, consumed, completed), seconds (of a
    lease). One row for each event that changes its job, and for each timer that does (event_id null);
    timers ring as the watermark passes them, `late` after the newest event."""
    e = events.select(F.col(key).alias("key"), "event_id", "ts", "kind", "seconds").withWatermark("ts", late)
    return e.groupBy("key").transformWithStateInPandas(Jobs(seconds, most), "key long, event_id long, status string, attempt int, reason string", "append", "EventTime")


def retained(artifacts: DataFrame, now, expires: str = "expires_at") -> DataFrame:
    """Artifacts that haven't expired (hidden from their last moment on)."""
    return artifacts.filter(F.col(expires) > now)
