"""What a worker holds at once: a slice of a batch, whatever the batch is like."""

import subprocess
import sys

import numpy as np
import pyarrow as pa

from plumbline.llm import language
from plumbline.llm.common import slices


def test_slices_are_bounded_by_rows_too():
    batch = pa.record_batch({"n": pa.array(range(1000)), "text": pa.array(["", None, "abc", "x" * 500] * 250)})
    parts = list(slices(batch, "text", language.SLICE, language.SLICE_ROWS))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert max(p.num_rows for p in parts) == language.SLICE_ROWS
    assert [p.num_rows for p in slices(batch, "text", 1000, 3)] == [3] * 333 + [1]
    assert [p.num_rows for p in slices(batch, "text", 1)][:3] == [2, 1, 1]


def test_slices_of_bytes_that_are_no_text():
    sets = [np.arange(n, dtype=np.uint64).tobytes() + b"\xff\xfe" for n in (0, 3, 40, 1)]
    batch = pa.record_batch({"shingles": pa.array([*sets, None], pa.binary())})
    parts = list(slices(batch, "shingles", 64))
    assert [x for p in parts for x in p.column("shingles").to_pylist()] == [*sets, None] and len(parts) == 3


def test_language_of_many_short_texts_takes_little_memory(spark, monkeypatch):
    """10 000 rows of features at once would be some 700 MB."""
    train = [(k, t, v) for k in range(60) for t, v in ((f"the cat and the dog {k}", "en"), (f"der Hund und die Katze {k}", "de"))]
    docs = spark.createDataFrame([(i, t, v) for i, (_, t, v) in enumerate(train)], "doc_id long, text string, lang string")

    def peak(df):
        def grown(batches):
            import tracemalloc

            tracemalloc.start()
            for out in search(batches):
                yield pa.RecordBatch.from_arrays([pa.array([tracemalloc.get_traced_memory()[1]] * out.num_rows)], names=["peak"])
            tracemalloc.stop()

        found = []
        monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: found.append(f) or self)
        language.identify(df, model)
        monkeypatch.undo()
        (search,) = found
        return df.mapInArrow(grown, "peak long").agg({"peak": "max"}).first()[0]

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **b: 1 / 0)  # would start workers for rows
    model = language.fit(docs)
    monkeypatch.undo()
    assert sorted(v for f in model.langs.values() for v in f) == ["de", "en"]
    short = spark.range(0, 5000, 1, 1).selectExpr("id as doc_id", "concat('the cat ', id) as text")
    assert peak(short) < 50e6


def test_workers_of_the_join_do_not_load_pandas():
    said = subprocess.run([sys.executable, "-c", "import sys, plumbline.llm.jaccard; print('pandas' in sys.modules)"], capture_output=True, text=True, timeout=120)
    assert said.stdout.split()[-1:] == ["False"], said.stderr
