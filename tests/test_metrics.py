import time

from pyspark.sql import functions as F

from plumbline.sources import metrics
from plumbline.sources.commits import Log
from plumbline.streaming import events


def test_counts_of_a_run_are_those_of_its_rows(spark, tmp_path):
    df, seen = metrics.observed(spark.range(1000).withColumn("odd", F.col("id") % 2), "graded", odd=F.sum("odd"), most=F.max("id"))
    df.filter("id < 10").write.parquet(str(tmp_path / "out"))
    other, second = metrics.observed(spark.range(0), "none", most=F.max("id"))
    other.write.format("noop").mode("append").save()
    for run in ("r1", "r2"):
        metrics.record(spark, str(tmp_path / "metrics"), run, seen, second, names=("graded", "none"))
    got = {(r.source, r.metric): r.value for r in Log(str(tmp_path / "metrics")).data(spark).filter("run = 'r2'").collect()}
    assert got["graded", "rows"] == 1000 and got["none", "rows"] == 0 and got["none", "most"] is None
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_streams_tell_their_batches(spark, tmp_path):
    told = metrics.StreamMetrics()
    spark.streams.addListener(told)
    try:
        for k in range(2):
            spark.range(100 * k, 100 * k + 100).withColumn("ts", F.timestamp_seconds("id")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            events.run(events.stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in"))), "counted", str(tmp_path / "cp"))
        for _ in range(50):
            if sum(r[2] == "failed" for r in told._rows) >= 2:
                break
            time.sleep(0.2)
        assert told.flush(spark, str(tmp_path / "metrics")) > 4 and told.flush(spark, str(tmp_path / "metrics")) == 0
    finally:
        spark.streams.removeListener(told)
    rows = Log(str(tmp_path / "metrics")).data(spark)
    assert rows.filter("metric = 'rows'").agg(F.sum("value")).first()[0] == 200 and rows.filter("metric = 'failed' and value = 0").count() == 2
