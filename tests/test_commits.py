import json
import os
import threading

import pytest

from plumbline.sources import commits
from plumbline.sources.commits import Conflict, Log


def table(spark, keys, body="x"):
    return spark.createDataFrame([(k, body) for k in keys], "id long, body string")


def together(*calls):
    """What calls that start at once return or raise."""
    out, gate = [None] * len(calls), threading.Barrier(len(calls))

    def go(k):
        gate.wait()
        try:
            out[k] = calls[k]()
        except Conflict as e:
            out[k] = e

    threads = [threading.Thread(target=go, args=(k,)) for k in range(len(calls))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    return out


def test_two_writers_of_one_key(spark, tmp_path):
    folder = str(tmp_path / "t")
    found = together(*(lambda k=k: commits.append_unique(table(spark, [1, 10 + k]), folder, ["id"]) for k in range(3)))
    assert sum(isinstance(x, Conflict) for x in found) == 2 and sum(x == 1 for x in found if isinstance(x, int)) == 1
    rows = [r.id for r in Log(folder).data(spark).collect()]
    assert len(rows) == 2 and 1 in rows


def test_two_writers_of_other_keys_both_win(spark, tmp_path):
    folder = str(tmp_path / "t")
    found = together(*(lambda k=k: commits.append_unique(table(spark, [k, 100 + k]), folder, ["id"]) for k in range(4)))
    assert sorted(found) == [1, 2, 3, 4] and Log(folder).data(spark).count() == 8
    with pytest.raises(Conflict):
        commits.append_unique(table(spark, [200, 200]), folder, ["id"])


def test_a_writer_that_dies_leaves_nothing_to_see(spark, tmp_path):
    folder = str(tmp_path / "t")
    commits.append_unique(table(spark, [1]), folder, ["id"])
    log = Log(folder)
    log.staged(table(spark, [2]))  # dies before its commit
    open(f"{folder}/log/.draft", "w").write('{"da')  # or while it wrote the commit's draft
    assert [r.id for r in Log(folder).data(spark).collect()] == [1] and Log(folder).numbers() == [1]
    assert commits.append_unique(table(spark, [2]), folder, ["id"]) == 2


def test_a_lost_race_looks_at_what_came_between(spark, tmp_path, monkeypatch):
    folder, log = str(tmp_path / "t"), Log(str(tmp_path / "t"))
    other = log.staged(table(spark, [5]))
    first = Log.taken
    monkeypatch.setattr(Log, "taken", lambda self, n, entry: (first(self, 1, {"data": other, "number": 1}), first(self, n, entry))[1] if n == 1 else first(self, n, entry))
    assert commits.append_unique(table(spark, [6]), folder, ["id"]) == 2
    folder2 = str(tmp_path / "u")
    os.makedirs(f"{folder2}/data")
    os.rename(f"{folder}/data/{other}", f"{folder2}/data/{other}")
    with pytest.raises(Conflict):
        commits.append_unique(table(spark, [5]), folder2, ["id"])


def test_publish_writes_each_digest_once(spark, tmp_path):
    folder = str(tmp_path / "cas")
    blobs = lambda *names: spark.createDataFrame([(n, "body of " + n) for n in names], "sha256 string, body string")
    commits.publish(blobs("a", "a", "b"), folder)
    listed = lambda: {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{folder}/data") for f in names}
    files = listed()
    assert sorted(r.sha256 for r in commits.publish(blobs("b", "c"), folder).collect()) == ["a", "b", "c"]
    assert files.items() <= listed().items()
    together(*(lambda k=k: commits.publish(blobs("d", "e", f"x{k}"), folder) for k in range(3)))
    assert sorted(r.sha256 for r in Log(folder).data(spark).collect()) == ["a", "b", "c", "d", "e", "x0", "x1", "x2"]


def test_heads_never_go_back(tmp_path):
    folder = str(tmp_path / "heads")
    commits.accept_head(folder, "c", 2, "x")
    found = together(*(lambda s=s: commits.accept_head(folder, "c", 3, s) for s in "abcd"))
    assert sum(isinstance(x, Conflict) for x in found) == 3 and Log(folder).entry(2)["heads"]["c"]["sequence"] == 3
    together(*(lambda k=k: commits.accept_head(folder, f"k{k}", 1, "z") for k in range(5)))
    last = Log(folder).entries()[-1]
    assert set(last["heads"]) == {"c", *(f"k{k}" for k in range(5))} and json.dumps(last)
    for n, sha, why in ((2, "x", "rollback"), (3, "other", "fork")):
        with pytest.raises(Conflict, match=why):
            commits.accept_head(folder, "c", n, sha)


def test_deliveries_keep_their_key_and_are_not_sent_again(spark, tmp_path):
    folder, told = str(tmp_path / "d"), str(tmp_path / "told")
    os.makedirs(told)

    def send(url, body, key):
        open(f"{told}/{key}-{len(os.listdir(told))}", "w").close()
        return {"up": 204, "bad": 404, "down": 503}[url]

    rows = spark.createDataFrame([(1, "up", "b"), (2, "down", "b"), (3, "bad", "b")], "delivery_id long, url string, body string").coalesce(1)
    got = commits.deliver(rows, folder, send)
    assert sorted((r.delivery_id, r.attempt, r.outcome) for r in got.collect()) == [(1, 1, "delivered"), (2, 1, "failed"), (2, 2, "failed"), (2, 3, "failed"), (2, 4, "failed"), (3, 1, "rejected")]
    got.collect()  # a second action sends nothing
    more = commits.deliver(rows.unionByName(spark.createDataFrame([(4, "up", "b")], rows.schema)).coalesce(1), folder, send)
    assert sorted(n.split("-")[0] for n in os.listdir(told)) == ["1", "2", "2", "2", "2", "3", "4"] and more.count() == 7
    assert commits.Log(folder).data(spark).filter("outcome = 'planned'").count() == 4
