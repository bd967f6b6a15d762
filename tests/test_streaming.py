import pytest
from pyspark.sql import functions as F

from plumbline.streaming import events as E


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("feed"))
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(2).write.mode("overwrite").parquet(d)
    like = spark.read.parquet(d)
    return d, like


def test_windows_as_in_batch(spark, feed, tmp_path):
    d, like = feed
    got = E.run(E.daily_counts(E.stream(spark, d, like), "user_id", "ts"), "daily", str(tmp_path / "a"), "complete")
    want = like.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(str, got.select("user_id", "day", "n").collect())) == sorted(map(str, want.collect()))
    got = E.run(E.hourly_limit(E.stream(spark, d, like), "user_id", "ts", 2), "hourly", str(tmp_path / "b"), "update")
    batch = E.hourly_limit(like, "user_id", "ts", 2)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))


def test_sessions_and_single_use(spark, feed, tmp_path):
    d, like = feed
    got = E.run(E.liveness(E.stream(spark, d, like), "user_id", "ts", "2 hours"), "live", str(tmp_path / "a"))
    assert 0 < got.count() <= E.liveness(like, "user_id", "ts", "2 hours").count()
    twice = like.withColumn("event_type", F.lit("x"))
    twice.unionByName(twice).write.parquet(str(tmp_path / "in"))
    got = E.run(E.single_use(E.stream(spark, str(tmp_path / "in"), like), ["event_id"], "ts"), "once", str(tmp_path / "b"))
    assert got.count() == like.count()


def rows(spark, path, data, kind):
    spark.createDataFrame(data, f"k long, event_id long, ts timestamp, {kind} string").coalesce(1).write.mode("append").parquet(path)


def test_leases(spark, tmp_path):
    from datetime import datetime as dt

    t = lambda s: dt(2024, 1, 1, 0, s // 60, s % 60)
    rows(spark, str(tmp_path / "in"), [(1, 1, t(0), "lease"), (1, 2, t(5), "lease"), (1, 3, t(20), "lease"), (1, 4, t(25), "use"), (1, 5, t(99), "lease"), (2, 6, t(1), "use")], "kind")
    like = spark.read.parquet(str(tmp_path / "in"))
    got = E.run(E.leases(E.stream(spark, str(tmp_path / "in"), like), "k", 10), "leases", str(tmp_path / "cp"))
    assert {r.event_id: (r.generation, r.decision) for r in got.collect()} == {1: (1, "leased"), 2: (1, "refused"), 3: (2, "leased"), 4: (2, "used"), 5: (2, "refused"), 6: (0, "refused")}


def test_state_machine(spark, tmp_path):
    from datetime import datetime as dt

    t = lambda s: dt(2024, 1, 1, 0, 0, s)
    rows(spark, str(tmp_path / "in"), [(1, 1, t(0), "quarantining"), (1, 2, t(1), "queued"), (1, 3, t(2), "completed"), (1, 4, t(3), "grading"), (1, 5, t(4), "completed"), (2, 1, t(0), "queued")], "status")
    like = spark.read.parquet(str(tmp_path / "in"))
    got = E.run(E.state_machine(E.stream(spark, str(tmp_path / "in"), like), "k"), "machine", str(tmp_path / "cp"))
    assert {(r.key, r.event_id): (r.status, r.accepted) for r in got.collect()} == {(1, 1): ("quarantining", True), (1, 2): ("queued", True), (1, 3): ("queued", False), (1, 4): ("grading", True), (1, 5): ("completed", True), (2, 1): (None, False)}


def test_stale_jobs_recover_by_timers(spark, tmp_path):
    """Each file is a micro-batch; the ticks of job 9 move the watermark on."""
    from datetime import datetime as dt, timedelta

    t = lambda s: dt(2024, 1, 1) + timedelta(seconds=s)
    batches = [
        [(k, 10 * k, t(0), "queued", 0.0) for k in (1, 2, 3, 4)] + [(k, 10 * k + 1, t(k), "claimed", 0.0) for k in (1, 2, 3, 4)] + [(2, 22, t(3), "consumed", 0.0), (3, 32, t(4), "leased", 1500.0), (4, 42, t(10), "completed", 0.0)],
        [(9, 90, t(1000), "queued", 0.0)],
        [(1, 13, t(1001), "claimed", 0.0), (9, 91, t(1600), "tick", 0.0)],
        [(1, 14, t(1601), "claimed", 0.0), (9, 92, t(2000), "tick", 0.0)],
        [(1, 15, t(2100), "claimed", 0.0), (9, 93, t(4000), "tick", 0.0)],
        [(9, 94, t(5000), "tick", 0.0)],
    ]
    like = None
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "k long, event_id long, ts timestamp, kind string, seconds double").coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "in"))
        like = df
        q = E.recovering_jobs(E.stream(spark, str(tmp_path / "in"), like), "k").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got.setdefault(r.key, []).append((r.event_id, r.status, r.attempt, r.reason))
    stale = {k: [x for x in v if x[0] is None] for k, v in got.items()}
    assert stale[2] == [(None, "quarantining", 1, "stale")] and stale[4] == [] and (42, "completed", 1, "completed") in got[4]
    assert sorted(x[1:] for x in stale[3]) == [("grading", 1, "lease runs"), ("queued", 1, "stale")]
    assert sorted((x[1:] for x in stale[1]), key=lambda x: x[1]) == [("queued", 1, "stale"), ("queued", 2, "stale"), ("failed", 3, "grading_timeout")]


def test_admission_and_retention(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-02 00:00:00")], "c int, t string").withColumn("t", F.to_timestamp("t"))
    w = spark.sql("select 1 as c, timestamp '2024-01-01' as opens_at, timestamp '2024-01-02' as closes_at")
    assert E.admitted(e, w, "c", "t").count() == 1
    assert E.retained(e, F.to_timestamp(F.lit("2024-01-01 00:00:00")), "t").count() == 1
