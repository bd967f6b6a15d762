"""Sinks: reports, append-only runs, content-addressed files, snapshots, delivery logs."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import html_escape
from plumbline.sources.commits import append_unique, publish

__all__ = ["append_unique", "publish"]


def report(scores: DataFrame, items: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON report for each key: its score, items by id, flags by rule; what is null is left out."""
    sorted_list = lambda df, by: F.array_sort(F.collect_list(F.struct(*by, *(c for c in df.columns if c not in (*by, *keys)))))
    i = items.groupBy(*keys).agg(sorted_list(items, ["id"]).alias("items"))
    f = flags.groupBy(*keys).agg(sorted_list(flags, ["rule_id", "disposition"]).alias("anti_cheat_flags"))
    j = scores.join(i, keys, "left").join(f, keys, "left")
    return j.select(*keys, F.to_json(F.struct(*j.columns)).alias("report"))


def manifest(df: DataFrame, path: str, content: str) -> DataFrame:
    """path, size and SHA-256 of contents, in byte order of the paths: what a bundle's manifest lists."""
    body = F.col(content).cast("binary")
    return df.select(path, F.octet_length(body).alias("size"), F.concat(F.lit("sha256:"), F.sha2(body, 256)).alias("sha256")).orderBy(F.col(path))


def json_report(df: DataFrame, path: str) -> None:
    """One JSON document a line."""
    df.write.mode("errorifexists").json(path)


def html_report(items: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A standalone HTML table for each key, rows in order of the columns, values escaped."""
    cells = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns), F.lit("</tr>"))
    head = "".join(f"<th>{c}</th>" for c in columns)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*columns, cells.alias("_cells")))), lambda x: x["_cells"]), "\n")
    return items.groupBy(*keys).agg(F.concat(F.lit(f"<!doctype html><meta charset='utf-8'><table><tr>{head}</tr>\n"), body, F.lit("\n</table>")).alias("html"))


def text_summary(df: DataFrame, score: str, done: Column) -> DataFrame:
    """A line for each row: INCOMPLETE without a score, else PASS or FAIL with the score."""
    line = F.when(F.col(score).isNull(), "INCOMPLETE").otherwise(F.format_string("%s %.4f", F.when(done, "PASS").otherwise("FAIL"), F.col(score)))
    return df.withColumn("summary", line)


def snapshots(stream: DataFrame, path: str, checkpoint: str, board):
    """Appends board(batch) with the batch's number after every micro-batch; a repeated batch overwrites itself."""

    def write(batch: DataFrame, n: int) -> None:
        board(batch).write.mode("overwrite").json(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def signature(secret: str, timestamp: int, body: str) -> str:
    """HMAC-SHA256 of "timestamp.body" as a header value."""
    return f"t={timestamp},v1={hmac.new(secret.encode(), f'{timestamp}.{body}'.encode(), hashlib.sha256).hexdigest()}"


def delivery_log(deliveries: DataFrame, send, key: str = "delivery_id", waits: tuple[int, ...] = (0, 1, 4, 16), secret: str | None = None, clock: int = 0) -> DataFrame:
    """Attempts of deliveries (key, url, body): send(url, body) -> status, until one is below 500.

    With a secret send(url, body, signature) is called, signed for the attempt's time: clock and the
    waits so far. Rows: key, attempt, wait, status, outcome. The caller's send decides about the network.
    """
    import pandas as pd

    def run(batches):
        for batch in batches:
            rows = []
            for k, url, body in batch[[key, "url", "body"]].itertuples(index=False):
                for n, wait in enumerate(waits, 1):
                    status = send(url, body, signature(secret, clock + sum(waits[:n]), body)) if secret else send(url, body)
                    rows.append((k, n, wait, status, "delivered" if status < 300 else "rejected" if status < 500 else "failed"))
                    if status < 500:
                        break
            yield pd.DataFrame(rows, columns=[key, "attempt", "wait", "status", "outcome"])

    kind = dict(deliveries.dtypes)[key]
    return deliveries.select(key, "url", "body").mapInPandas(run, f"{key} {kind}, attempt int, wait int, status int, outcome string")


def check_output(changes: DataFrame, most: int = 10_000, path: str | None = None) -> tuple[int, str]:
    """(exit code, JSON) of a structural check: how many changes there are and the first `most` of them.
    Where there are more, all are written as JSON lines to `path`, which must be given then."""
    import json

    total = changes.count()
    if total > most:
        if path is None:
            raise ValueError(f"{total} changes: a path to write them to is needed")
        json_report(changes, path)
    rows = [r.asDict(recursive=True) for r in changes.orderBy(*changes.columns).limit(most).collect()]
    out = {"status": "changed" if total else "same", "changed_objects": total, "changes": rows} | ({"all_changes": path} if total > most else {})
    return int(bool(total)), json.dumps(out, ensure_ascii=False, default=str)
