"""Memory of a model's fit: its worker lives on, and its memory counts as the executor's."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tidemark.llm import common, quality


def sample(rows, entries, seed=3):
    """Examples as quality.train makes them, in two batches of an Arrow table."""
    rng = np.random.default_rng(seed)
    batches = []
    for _ in range(2):
        idx = [np.concatenate([[0], np.sort(rng.choice(1 << quality.BITS, entries, replace=False))]).astype(np.int32) for _ in range(rows)]
        x = [np.concatenate([[1.0], rng.random(entries)]).astype(np.float32) for _ in range(rows)]
        y = rng.integers(0, 2, rows)
        batches.append(pa.RecordBatch.from_arrays([pa.array(idx, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32())), pa.array(y, pa.int32())], names=["idx", "x", "y"]))
    return pa.Table.from_batches(batches)


def learner(monkeypatch, spark):
    """What quality.train learns from a table of examples."""
    monkeypatch.setattr(quality, "fitted", lambda made, most, learn: learn)
    docs = spark.createDataFrame([(1, "a text")], "doc_id bigint, text string")
    return quality.train(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int"))


def test_fit_does_not_copy_its_sample(spark, monkeypatch):
    learn, got = learner(monkeypatch, spark), sample(150, 30_000)
    learn(sample(2, 10))  # what is made once
    tracemalloc.start()
    learn(got)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.nbytes > 70e6
    assert peak < got.nbytes / 3  # twice the size before


def test_fit_has_the_weights_of_wide_rows(spark, monkeypatch):
    got = sample(40, 300)
    wide = [(np.array(i, dtype=np.int64), np.array(x, dtype=np.float64), y) for i, x, y in zip(*(got[c].to_pylist() for c in ("idx", "x", "y")), strict=True)]
    assert np.array_equal(learner(monkeypatch, spark)(got), quality.fit(wide))


def test_parts_of_a_slice():
    lists = pa.array([[1], [2, 3], [], [4, 5, 6]], pa.list_(pa.int32())).slice(1, 3)
    assert [x.tolist() for x in common.parts(lists)] == [[2, 3], [], [4, 5, 6]]
