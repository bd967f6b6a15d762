"""Limits, slots, expiry and admission as keyed state of streams.

Each takes a streaming DataFrame with a TIMESTAMP column and gives one decision for each event. Where
events may come out of order, those within the watermark's delay are held back until it has passed
them, so that any cut of the input into micro-batches gives the same decisions; what comes later
than that is dropped by the watermark, but for admissions(), which reports it.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SLOTS = 3


def micros(ts: pd.Timestamp) -> int:
    return ts.value // 1000 if ts.tzinfo is None else ts.tz_convert(timezone.utc).value // 1000


def rows_of(parts: Iterator[pd.DataFrame]) -> list:
    return [r for part in parts for r in part.itertuples(index=False)]


def keep(state, rows: list[tuple]) -> None:
    """The rows as a list state; a state store holds no empty lists."""
    state.put(rows) if rows else state.clear()


class RollingLimit(StatefulProcessor):
    """The exact number of a tenant's events in the window up to each one. Events wait for the watermark; times
    that no later event can count are pruned."""

    def __init__(self, seconds: int, most: int):
        self.width, self.most = seconds * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long")
        self.recent = handle.getListState("recent", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(micros(r.ts), r.event_id) for r in rows_of(rows)]
        self.waiting.appendList(new)
        for at in {at for at, _ in new}:
            self.handle.registerTimer(at // 1000 + 1)
        yield pd.DataFrame(columns=["key", "event_id", "n", "limited", "retry_after"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs() * 1000
        waiting = sorted(self.waiting.get())
        due = [x for x in waiting if x[0] < upto]
        if due:
            times = sorted([at for (at,) in self.recent.get()] + [at for at, _ in due])
            out = []
            for at, event in due:
                inside = [t for t in times if at - self.width <= t <= at]
                limited = len(inside) >= self.most
                out.append((key[0], event, len(inside), limited, max(1, -(-(inside[0] + self.width - at) // 1_000_000)) if limited else None))
            keep(self.waiting, [x for x in waiting if x[0] >= upto])
            keep(self.recent, [(t,) for t in times if t >= upto - self.width])
            yield pd.DataFrame(out, columns=["key", "event_id", "n", "limited", "retry_after"]).astype({"retry_after": "Int64"})

    def close(self) -> None:
        pass


def rolling_limit(events: DataFrame, tenant: str, ts: str, tie: str, seconds: int, most: int, late: str = "1 hour") -> DataFrame:
    """key, event_id, n, limited, retry_after of every event: as operators.service.rolling_limit."""
    e = events.select(F.col(tenant).cast("long").alias("key"), F.col(tie).cast("long").alias("event_id"), F.col(ts).alias("ts")).withWatermark("ts", late)
    return e.groupBy("key").transformWithStateInPandas(RollingLimit(seconds, most), "key long, event_id long, n long, limited boolean, retry_after long", "append", "EventTime")


class Slots(StatefulProcessor):
    """A campaign's slots: reserved by a submission, free again if it fails before a report, occupied by a report."""

    def __init__(self, slots: int):
        self.slots = slots

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("slots", "slot int", "submission long, occupied boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {slot: tuple(x) for (slot,), x in self.held.iterator()}
        out = []
        for r in sorted(rows_of(rows), key=lambda r: (r.ts, r.event_id)):
            mine = next((s for s, (x, _) in held.items() if x == r.submission), None)
            free = next((s for s in range(1, self.slots + 1) if s not in held), None)
            if r.kind == "reserve":
                slot, done = (mine, "held") if mine else (free, "reserved" if free else "full")
                if slot and not mine:
                    held[slot] = (r.submission, False)
                    self.held.updateValue((slot,), held[slot])
            elif mine is None:
                slot, done = None, "unknown"
            elif r.kind == "report":
                slot, done, held[mine] = mine, "occupied", (r.submission, True)
                self.held.updateValue((mine,), held[mine])
            elif held[mine][1]:
                slot, done = mine, "kept"
            else:
                slot, done = mine, "released"
                del held[mine]
                self.held.removeKey((mine,))
            out.append((key[0], r.event_id, slot, done))
        yield pd.DataFrame(out, columns=["key", "event_id", "slot", "outcome"]).astype({"slot": "Int32"})

    def close(self) -> None:
        pass


def slots(events: DataFrame, campaign: str, most: int = SLOTS) -> DataFrame:
    """events: campaign (long), event_id, ts, submission (long), kind (reserve, fail or report), in order from batch to
    batch. key, event_id, slot and outcome: reserved, held (already), full; released, kept (a report was
    made), occupied, unknown (no slot is held)."""
    e = events.select(F.col(campaign).cast("long").alias("key"), "event_id", "ts", F.col("submission").cast("long").alias("submission"), "kind")
    return e.groupBy("key").transformWithStateInPandas(Slots(most), "key long, event_id long, slot int, outcome string", "append", "None")


class Expiry(StatefulProcessor):
    """Says once that an artifact expired; a later entry of it moves its time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = max(rows_of(rows), key=lambda r: r.ts)
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        # A time that has passed already rings with the next timers.
        at = max(-(-micros(last.expires_at) // 1000), timerValues.getCurrentWatermarkInMs() + 1)
        self.due.update((at,))
        self.handle.registerTimer(at)
        yield pd.DataFrame(columns=["artifact", "expired_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.due.exists() and self.due.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            yield pd.DataFrame({"artifact": [key[0]], "expired_at": [pd.Timestamp(self.due.get()[0], unit="ms", tz="UTC")]})
            self.due.clear()

    def close(self) -> None:
        pass


def expiries(artifacts: DataFrame, artifact: str, late: str = "0 seconds") -> DataFrame:
    """artifacts: artifact (string), ts (of the entry, which moves the time on) and expires_at. artifact and expired_at of
    each whose time has passed, once."""
    a = artifacts.select(F.col(artifact).alias("artifact"), "ts", "expires_at").withWatermark("ts", late)
    return a.groupBy("artifact").transformWithStateInPandas(Expiry(), "artifact string, expired_at timestamp", "append", "EventTime")


def store_artifacts(df: DataFrame, folder: str, expires: str = "expires_at") -> None:
    """Appends artifacts to a folder for each day of expiry."""
    df.withColumn("expires_on", F.to_date(expires)).write.mode("append").partitionBy("expires_on").parquet(folder)


def sweep(spark: SparkSession, folder: str, now: str, expires: str = "expires_at") -> int:
    """Deletes what expired by `now`: the folders of earlier days as a whole; that of the day is written anew beside
    it and takes its place if anything in it has expired. Other folders are not touched. How many folders changed.
    A sweep that dies leaves a folder that its next run finishes."""
    paths = spark._jvm.org.apache.hadoop.fs
    base = paths.Path(folder)
    store, changed = base.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    today = now[:10]
    for status in sorted(store.listStatus(base), key=lambda s: s.getPath().getName()):
        name = status.getPath().getName()
        if name.startswith("_rewritten-"):  # complete if it has _SUCCESS: the day's folder went already, or will
            day = paths.Path(base, "expires_on=" + name.removeprefix("_rewritten-"))
            if store.exists(paths.Path(status.getPath(), "_SUCCESS")):
                store.delete(day, True)
                store.rename(status.getPath(), day)
            else:
                store.delete(status.getPath(), True)
    for status in store.listStatus(base):
        name = status.getPath().getName()
        day = name.removeprefix("expires_on=")
        if not name.startswith("expires_on=") or day > today or day == "__HIVE_DEFAULT_PARTITION__":
            continue
        if day == today:
            rows = spark.read.parquet(status.getPath().toString())
            gone = F.col(expires) <= F.lit(now).cast("timestamp")
            if not rows.filter(gone).take(1):
                continue
            beside = paths.Path(base, f"_rewritten-{day}")
            rows.filter(~F.coalesce(gone, F.lit(False))).write.mode("overwrite").parquet(beside.toString())
            store.delete(status.getPath(), True)
            store.rename(beside, status.getPath())
        else:
            store.delete(status.getPath(), True)
        changed += 1
    return changed


class Admission(StatefulProcessor):
    """Judges every event of a campaign; what is late is measured against the newest event of earlier batches."""

    def __init__(self, late: int):
        self.late = late * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0] if self.newest.exists() else None
        out, top = [], newest
        for r in rows_of(rows):
            at = None if pd.isna(r.ts) else micros(r.ts)
            if at is None:
                reason = "no time"
            elif pd.isna(r.opens_at) or pd.isna(r.closes_at):
                reason = "no window"
            elif at < micros(r.opens_at):
                reason = "before opening"
            elif at >= micros(r.closes_at):
                reason = "at or after closing"
            else:
                reason = "late" if newest is not None and at < newest - self.late else None
            top = at if top is None or at is not None and at > top else top
            out.append((key[0], r.event_id, reason is None, reason))
        if top is not None:
            self.newest.update((top,))
        yield pd.DataFrame(out, columns=["key", "event_id", "accepted", "reason"])

    def close(self) -> None:
        pass


def admissions(events: DataFrame, windows: DataFrame, campaign: str, ts: str, late: int) -> DataFrame:
    """key, event_id, accepted and reason of every event, rejected ones too. windows: campaign, opens_at, closes_at (static)."""
    e = events.join(windows.select(F.col(campaign), "opens_at", "closes_at"), campaign, "left")
    e = e.select(F.col(campaign).cast("long").alias("key"), "event_id", F.col(ts).alias("ts"), "opens_at", "closes_at")
    return e.groupBy("key").transformWithStateInPandas(Admission(late), "key long, event_id long, accepted boolean, reason string", "append", "None")
