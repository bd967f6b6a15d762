"""Keyed state of streams against the same decisions in batch."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators import service
from plumbline.streaming import events as E
from plumbline.streaming import state

START = datetime(2024, 1, 1)


def fed(spark, tmp_path, batches, schema, flow):
    """The output of a flow that gets each batch as a micro-batch of its own."""
    for rows in batches:
        df = spark.createDataFrame(rows, schema).coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = flow(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("seed,cuts", [(1, 1), (2, 5)])
def test_exact_hour_in_any_micro_batches(spark, tmp_path, seed, cuts):
    rng = random.Random(seed)
    rows = [(rng.randrange(4), k, START + timedelta(seconds=rng.randrange(20_000), microseconds=rng.choice([0, 1, 999_999]))) for k in range(150)]
    rows += [(7, 1000 + k, START + timedelta(hours=1, seconds=s)) for k, s in enumerate((0, 0, 0, 3600, 3601))]
    schema = "user long, event_id long, ts timestamp"
    want = service.rolling_limit(spark.createDataFrame(rows, schema), "user", "ts", "event_id", 3600, 3)
    rows.sort(key=lambda r: r[2] + timedelta(seconds=rng.randrange(3000)))  # out of order within the hour that the watermark waits
    batches = [rows[len(rows) * k // cuts : len(rows) * (k + 1) // cuts] for k in range(cuts)]
    batches += [[(99, 9000, START + timedelta(days=2))], [(99, 9001, START + timedelta(days=3))]]
    got = fed(spark, tmp_path, batches, schema, lambda s: state.rolling_limit(s, "user", "ts", "event_id", 3600, 3))
    key = lambda r: (r.event_id, r.n, r.limited, r.retry_after)
    assert sorted(map(key, got.filter("key <> 99").collect())) == sorted(map(key, want.collect()))


def sequential(events, most=3):
    """Slots of one campaign, event by event."""
    held, out = {}, {}
    for _, event, submission, kind in events:
        mine = next((s for s, x in held.items() if x[0] == submission), None)
        if kind == "reserve" and mine is None:
            free = [s for s in range(1, most + 1) if s not in held]
            out[event] = (free[0], "reserved") if free else (None, "full")
            if free:
                held[free[0]] = [submission, False]
        elif kind == "reserve":
            out[event] = (mine, "held")
        elif mine is None:
            out[event] = (None, "unknown")
        elif kind == "report":
            held[mine][1], out[event] = True, (mine, "occupied")
        elif held[mine][1]:
            out[event] = (mine, "kept")
        else:
            out[event] = (held.pop(mine) and mine, "released")
    return out


def test_slots_as_one_after_another(spark, tmp_path):
    rng, rows = random.Random(3), []
    for k in range(300):
        rows.append((k % 3, k, START + timedelta(seconds=k // 2), rng.randrange(6), rng.choice(["reserve", "reserve", "fail", "report"] if k > 150 else ["reserve", "reserve", "fail"])))
    want = {}
    for c in range(3):
        want |= sequential([(t, e, s, kind) for campaign, e, t, s, kind in rows if campaign == c])
    got = fed(spark, tmp_path, [rows[:100], rows[100:101], rows[101:]], "c long, event_id long, ts timestamp, submission long, kind string", lambda s: state.slots(s, "c"))
    assert {r.event_id: (r.slot, r.outcome) for r in got.collect()} == want
    assert {o for _, o in want.values()} == {"reserved", "held", "full", "unknown", "occupied", "kept", "released"}


def test_claims_look_at_the_oldest_only(spark):
    def claims(jobs, running, cap, look, n):
        queue, count, out = sorted(jobs, key=lambda j: (j[2], j[0])), dict(running), []
        for _ in range(n):
            pick = next((j for j in queue[:look] if count.get(j[1], 0) < cap), None)
            if pick is None:
                break
            queue.remove(pick)
            count[pick[1]] = count.get(pick[1], 0) + 1
            out.append(pick[0])
        return out

    rng = random.Random(2)
    for look, n in ((3, 4), (100, 10), (5, 50)):
        jobs = [(k, rng.choice([1, 1, 1, 2, 3]), rng.randrange(40)) for k in range(60)]
        running = {1: rng.randrange(4), 3: 1}
        df, active = spark.createDataFrame(jobs, "id long, tenant long, at long"), spark.createDataFrame(list(running.items()), "tenant long, running long")
        got = service.claim_oldest(df, "tenant", ["at", "id"], active, 3, n, look)
        assert [r.id for r in got.orderBy("at", "id").collect()] == claims(jobs, running, 3, look, n)
    full = spark.createDataFrame([(k, 1, k) for k in range(100)] + [(100, 2, 100)], "id long, tenant long, at long")
    assert service.claim_oldest(full, "tenant", ["at", "id"], spark.createDataFrame([(1, 5)], "tenant long, running long"), 5, 1).count() == 0  # a tenant at its cap fills the first 100


def test_expiry_is_said_once_and_bytes_go(spark, tmp_path):
    t = lambda h: START + timedelta(hours=h)
    batches = [[("a", t(0), t(5)), ("b", t(0), t(30)), ("c", t(1), t(50))], [("tick", t(10), t(9999))], [("b", t(11), t(40)), ("old", t(11), t(2))], [("tick", t(35), t(9999))], [("tick", t(45), t(9999))], [("tick", t(46), t(9999))]]
    got = fed(spark, tmp_path, batches, "id string, ts timestamp, expires_at timestamp", lambda s: state.expiries(s, "id"))
    assert sorted(r.artifact for r in got.collect()) == ["a", "b", "old"] and {r.artifact: r.expired_at for r in got.collect()}["b"] == t(40)


def test_sweep_touches_expired_folders_only(spark, tmp_path):
    folder = str(tmp_path / "store")
    at = lambda s: F.to_timestamp(F.lit(s))
    rows = spark.range(40).withColumn("body", F.repeat(F.lit("x"), 100)).withColumn("expires_at", F.when(F.col("id") < 10, at("2024-01-01 10:00:00")).when(F.col("id") < 20, at("2024-01-02 08:00:00")).when(F.col("id") < 30, at("2024-01-02 18:00:00")).otherwise(at("2024-01-03 00:00:00")))
    state.store_artifacts(rows, folder)
    listed = lambda day: sorted((f, os.stat(f"{folder}/expires_on={day}/{f}").st_mtime_ns) for f in os.listdir(f"{folder}/expires_on={day}"))
    before = listed("2024-01-03")
    assert state.sweep(spark, folder, "2024-01-02 08:00:00") == 2
    assert sorted(r.id for r in spark.read.parquet(folder).collect()) == list(range(20, 40)) and listed("2024-01-03") == before
    second = listed("2024-01-02")
    assert state.sweep(spark, folder, "2024-01-02 09:00:00") == 0 and listed("2024-01-02") == second
    os.rename(f"{folder}/expires_on=2024-01-02", f"{folder}/_rewritten-2024-01-02")  # a sweep that died between its last steps
    assert state.sweep(spark, folder, "2024-01-02 09:00:00") == 0 and spark.read.parquet(folder).count() == 20
    os.makedirs(f"{folder}/_rewritten-2024-01-03")  # and one that died before it had written all
    assert state.sweep(spark, folder, "2024-01-02 18:00:00") == 1 and sorted(r.id for r in spark.read.parquet(folder).collect()) == list(range(30, 40))


def test_every_event_is_admitted_or_rejected_with_a_reason(spark, tmp_path):
    t = lambda h: START + timedelta(hours=h)
    windows = spark.createDataFrame([(1, t(1), t(10)), (2, t(0), t(99))], "c long, opens_at timestamp, closes_at timestamp")
    batches = [[(1, 1, t(0)), (1, 2, t(1)), (1, 3, t(9)), (3, 4, t(5)), (2, 5, t(50))], [(1, 6, t(7)), (1, 7, t(8)), (1, 8, t(10)), (2, 9, t(1)), (2, 10, None)], [(2, 11, t(49))]]
    got = fed(spark, tmp_path, batches, "c long, event_id long, ts timestamp", lambda s: state.admissions(s, windows, "c", "ts", 3600))
    assert {r.event_id: r.reason for r in got.collect()} == {1: "before opening", 2: None, 3: None, 4: "no window", 5: None, 6: "late", 7: None, 8: "at or after closing", 9: "late", 10: "no time", 11: None}
    assert got.count() == sum(map(len, batches)) and all(r.accepted == (r.reason is None) for r in got.collect())


def test_run_leaves_a_table_in_the_store(spark, tmp_path):
    spark.range(10).withColumn("ts", F.timestamp_seconds("id")).write.parquet(str(tmp_path / "in"))
    source = E.stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")))
    got = E.run(source, "kept", str(tmp_path / "cp"))
    assert got.count() == 10 and got.inputFiles()
