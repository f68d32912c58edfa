"""The parts of may_hold: no listed key is in the second, every row is in just one, whatever the columns are called."""

from tidemark.llm.bloom import may_hold


def test_parts_hold_every_row_once_and_no_listed_key_is_ruled_out(spark):
    rows = spark.createDataFrame([(k if k % 7 else None, k, "x") for k in range(500)], "row long, k long, bloom string")
    keys = spark.createDataFrame([(k,) for k in range(0, 500, 5)], "key long")
    hit, miss = may_hold(rows, "row", keys, 100)
    assert hit.columns == miss.columns == ["row", "k", "bloom"]
    hits, misses = hit.collect(), miss.collect()
    assert sorted(r.k for r in hits + misses) == list(range(500))
    assert not [r for r in misses if r.row is not None and r.row % 5 == 0]
    assert all(r.row is not None for r in hits) and len(hits) < 150


def test_no_keys(spark):
    rows = spark.createDataFrame([(1,), (None,)], "row long")
    hit, miss = may_hold(rows, "row", spark.createDataFrame([], "key long"), 0)
    assert hit.count() == 0 and miss.count() == 2
