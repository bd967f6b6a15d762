"""Append-only tables with an optimistic commit log.

A folder holds `data/<id>` (Parquet, written before its commit) and `log/<number>.json`, one file for each
commit, numbered without gaps. A commit's file appears whole and only if no other writer took its number:
by a hard link on local disks, by a rename elsewhere (HDFS refuses one onto a file that is there; a
store without such a rename, as a bare object store, must not have two writers). Who comes second
looks at what was committed since it read: if that has keys of its own it gives up with Conflict, else
it tries the next number. Readers see what the log names, so data of a writer that died are never seen.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(ValueError):
    """Another writer committed what this one must not repeat."""


class Log:
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        spark = SparkSession.getActiveSession()
        self.fs = None  # of Hadoop, for anything but local disks
        if spark is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            store = path.getFileSystem(spark._jsc.hadoopConfiguration())
            self.path = spark._jvm.org.apache.hadoop.fs.Path
            self.fs = None if store.getUri().getScheme() == "file" else store
        self.local = self.folder.removeprefix("file://").removeprefix("file:")

    def numbers(self) -> list[int]:
        if self.fs is None:
            names = os.listdir(f"{self.local}/log") if os.path.isdir(f"{self.local}/log") else []
        else:
            at = self.path(f"{self.folder}/log")
            names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def entry(self, n: int) -> dict:
        name = f"log/{n:020d}.json"
        if self.fs is None:
            with open(f"{self.local}/{name}") as f:
                return json.load(f)
        stream = self.fs.open(self.path(f"{self.folder}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def entries(self, after: int = 0) -> list[dict]:
        return [self.entry(n) for n in self.numbers() if n > after]

    def taken(self, n: int, entry: dict) -> bool:
        """Whether this writer made commit n."""
        text, draft, name = json.dumps(entry, sort_keys=True), f"log/.{uuid.uuid4().hex}", f"log/{n:020d}.json"
        if self.fs is None:
            os.makedirs(f"{self.local}/log", exist_ok=True)
            with open(f"{self.local}/{draft}", "w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(f"{self.local}/{draft}", f"{self.local}/{name}")
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(f"{self.local}/{draft}")
        source, target = self.path(f"{self.folder}/{draft}"), self.path(f"{self.folder}/{name}")
        stream = self.fs.create(source, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        done = not self.fs.exists(target) and self.fs.rename(source, target)
        if not done:
            self.fs.delete(source, False)
        return done

    def data(self, spark: SparkSession, after: int = 0, upto: int | None = None) -> DataFrame | None:
        """The rows of the commits after one number, up to another; None without any."""
        paths = [f"{self.folder}/data/{e['data']}" for e in self.entries(after) if e.get("data") and (upto is None or e["number"] <= upto)]
        return spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    def staged(self, df: DataFrame) -> str:
        """Writes rows that no reader sees yet."""
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/data/{name}")
        return name

    def commit(self, make: Callable[[int], dict]) -> dict:
        """Commits make(read), which sees the log up to the number it gets and may raise Conflict; again after each lost race."""
        while True:
            read = max(self.numbers(), default=0)
            entry = make(read) | {"number": read + 1}
            if self.taken(read + 1, entry):
                return entry


def append_unique(df: DataFrame, folder: str, keys: list[str]) -> int:
    """Appends rows whose keys must be new; a key that was committed, or is twice in df, is a Conflict. The commit's number."""
    from plumbline.operators.evidence import duplicates

    spark, log = df.sparkSession, Log(folder)
    name = log.staged(df)
    mine, checked = spark.read.parquet(f"{log.folder}/data/{name}"), 0
    if duplicates(mine, keys).take(1):
        raise Conflict(f"repeated {keys}")

    def make(read: int) -> dict:
        nonlocal checked
        there = log.data(spark, checked, read)
        if there is not None and mine.join(there.select(*keys), keys, "left_semi").take(1):
            raise Conflict(f"{keys} exists")
        checked = read
        return {"data": name}

    return log.commit(make)["number"]


def publish(df: DataFrame, folder: str, digest: str = "sha256") -> DataFrame:
    """Adds the rows whose digest isn't there yet, once; what is there is never written again. All rows of the table."""
    spark, log = df.sparkSession, Log(folder)
    name, checked = None, 0
    rows = df.dropDuplicates([digest])

    def make(read: int) -> dict:
        nonlocal name, rows, checked
        there = log.data(spark, checked, read)
        if name is None or there is not None and rows.join(there.select(digest), digest, "left_semi").take(1):
            name = log.staged(rows if there is None else rows.join(there.select(digest), digest, "left_anti"))
            rows = spark.read.parquet(f"{log.folder}/data/{name}")
        checked = read
        return {"data": name}

    log.commit(make)
    return log.data(spark)


def accept_head(folder: str, chain: str, sequence: int, sha256: str) -> None:
    """Makes a hash the accepted head of a chain; Conflict if that would be a rollback (a lower sequence) or a fork (another
    hash for the same one), also against writers at the same time."""
    log = Log(folder)

    def make(read: int) -> dict:
        heads = log.entry(read)["heads"] if read else {}
        now = heads.get(chain)
        if now and (sequence < now["sequence"] or sequence == now["sequence"] and sha256 != now["sha256"]):
            raise Conflict("rollback" if sequence < now["sequence"] else "fork")
        return {"heads": heads | {chain: {"sequence": sequence, "sha256": sha256}}}

    log.commit(make)


def deliver(deliveries: DataFrame, folder: str, send: Callable[[str, str, str], int], waits: tuple[int, ...] = (0, 1, 4, 16)) -> DataFrame:
    """Sends deliveries (delivery_id, url, body) that the log has no outcome of: send(url, body, key) -> status, until one is
    below 500. key is the delivery's, the same in every attempt: a task that is done again, or a run after one
    that died, sends it again, and a receiver that keeps keys takes it once. What will be sent is committed
    before the first is, the attempts after. All attempts so far: delivery_id, attempt, wait, status, outcome."""
    import pandas as pd

    spark, log = deliveries.sparkSession, Log(folder)
    done = log.data(spark)
    todo = deliveries if done is None else deliveries.join(done.filter("attempt > 0").select("delivery_id"), "delivery_id", "left_anti")
    kind = dict(deliveries.dtypes)["delivery_id"]
    schema = f"delivery_id {kind}, attempt int, wait int, status int, outcome string"
    planned = log.staged(todo.selectExpr("delivery_id", "0 as attempt", "0 as wait", "cast(null as int) as status", "'planned' as outcome", "url", "body"))
    log.commit(lambda read: {"data": planned})

    def run(batches):
        for batch in batches:
            rows = []
            for key, url, body in batch[["delivery_id", "url", "body"]].itertuples(index=False):
                for n, wait in enumerate(waits, 1):
                    status = send(url, body, str(key))
                    rows.append((key, n, wait, status, "delivered" if status < 300 else "rejected" if status < 500 else "failed"))
                    if status < 500:
                        break
            yield pd.DataFrame(rows, columns=["delivery_id", "attempt", "wait", "status", "outcome"])

    sent = log.staged(spark.read.parquet(f"{log.folder}/data/{planned}").select("delivery_id", "url", "body").mapInPandas(run, schema))
    log.commit(lambda read: {"data": sent})
    return log.data(spark).filter(F.col("attempt") > 0).select("delivery_id", "attempt", "wait", "status", "outcome")
