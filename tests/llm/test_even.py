"""What must grow evenly: ranges of the mix whatever the weights, the merge of suffix shards, and counts kept apart by source."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import mixing, pipeline, suffix


@pytest.mark.parametrize("weight", [0.5, 1.0, 2.0, 0.0, None])
def test_ranges_of_the_mix_are_even(spark, monkeypatch, weight):
    held = {}
    plain = mixing.summed

    def watched(d, value, name):
        held.setdefault("sizes", [r["count"] for r in d.groupBy("source", "bin").count().collect()])
        return plain(d, value, name)

    monkeypatch.setattr(mixing, "summed", watched)
    d = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    mixing.mix(d, F.lit(weight).cast("double"), F.lit(3), F.col("doc_id").cast("string"), ranges=50).count()
    assert max(held["sizes"]) < 3 * 60_000 / 50


def test_merge_grows_with_rows_not_with_shards():
    def took(shards, rows=200_000):
        x = np.sort(np.random.default_rng(1).integers(0, rows, (shards, rows // shards)), 1)
        t = time.perf_counter()
        out = suffix.merge_runs(list(x))
        return time.perf_counter() - t, x, out

    seconds, x, out = took(10_000)
    assert seconds < 5
    _, x, out = took(20, 2_000)
    sets = [set(r.tolist()) for r in x]
    for i, run in enumerate(x):
        assert out[i].tolist() == [sum(v in s for k, s in enumerate(sets) if k != i) for v in run.tolist()]
    assert suffix.merge_runs([]) == [] and suffix.merge_runs([np.zeros(0, np.int64), np.array([1, 1])])[1].tolist() == [0, 0]


@pytest.mark.parametrize("turned", [False, True])
def test_mix_keeps_sources_apart(spark, turned):
    """One id and text in two sources: each row has the count of its own source, in either order of the input."""
    rows = [(1, "x y z", "A"), (1, "x y z", "B")]
    more = [(10 + i, "w " * 3, "A" if i < 10 else "B") for i in range(20)]
    docs = spark.createDataFrame((rows[::-1] if turned else rows) + more, "doc_id long, text string, source string").coalesce(1)
    got = pipeline.mix(spark, docs, "/root/testdata/sf0.001").filter("doc_id = 1").groupBy("source").count().collect()
    sizes = spark.createDataFrame([("A", 33), ("B", 33)], "source string, source_size long")
    # target of A is twice its size, so each of its documents stands twice; B has the rest, a half of its size
    assert {r["source"]: round(r["target"] / 33, 6) for r in mixing.targets(sizes, 1.5, 2.0).collect()} == {"A": 2.0, "B": 1.0}
    assert {r["source"]: r["count"] for r in got} == {"A": 2, "B": 1}


@pytest.mark.parametrize("turned", [False, True])
def test_one_of_equal_copies_is_the_same_in_any_order(spark, turned):
    text = "a b c d e f g h i j k l"
    rows = [(1, text, s) for s in ("A", "B", None)]
    docs = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string, source string").coalesce(1)
    got = [r["source"] for r in pipeline.keep_one(spark, docs, "/root/testdata/sf0.001").collect()]
    want = docs.orderBy(F.xxhash64("doc_id", "text", "source")).first()["source"]
    assert got == [want]
