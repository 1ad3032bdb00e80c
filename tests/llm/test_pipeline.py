"""The pipeline's stages, one by one."""

import corpus_pipeline
from rankloom.llm import minhash, packing, quality
from rankloom.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
        assert k == 4 or seen[-1].columns == columns
    good = quality.score(docs, quality.train(docs, table(spark, SF, "labels"))).filter("predicted = 1")
    assert {r[0] for r in seen[1].select("doc_id").collect()} == {r[0] for r in good.select("doc_id").collect()}
    kept = minhash.near_duplicates(seen[1]).filter("kept")
    assert sorted(r[0] for r in seen[2].select("doc_id").collect()) == sorted(r[0] for r in kept.select("doc_id").collect())
    assert seen[3].count() == seen[2].count() and seen[3].filter("text like '%AKIA%'").count() == 0
    assert 0 < seen[4].count() and {r[0] for r in seen[4].select("doc_id").collect()} <= {r[0] for r in seen[3].select("doc_id").collect()}
    whole = seen[5].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert all(r["sum(length)"] % r["max(doc_tokens)"] == 0 for r in whole) and packing.PIECES.split()[0] in seen[5].columns


def test_repeated_rows(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (None, "g h i j k", "en", "s", 9), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.STAGES[1][1](spark, docs, SF).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == [("1", "a b c d e f"), ("None", "None"), ("None", "g h i j k")]


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run_keeps_its_last_table_alone(spark, tmp_path):
    before = spark.sparkContext._jsc.sc().getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = corpus_pipeline.run(spark, SF)
    last = [f for f in tmp_path.rglob("*.parquet") if "ids_crc32" in spark.read.parquet(str(f)).columns]
    assert rows.count() > 0 and last
    assert not any({"source", "lang"} <= set(spark.read.parquet(str(f)).columns) for f in tmp_path.rglob("*.parquet"))
    if before.isDefined():
        spark.sparkContext.setCheckpointDir(before.get())


def test_clashing_names_and_equal_rows(spark):
    """Every stage keeps columns whatever their names, gives equal rows equal results, and copes with nulls in each."""
    names = "_id long, _th long, row string, _times string, size long, taken long, _quality double, score double"
    full = "plain words of a good and quiet document about rivers and the towns along them " * 4
    rows = [(1, full), (1, full), (2, None), (None, full + "x"), (None, None), (3, ""), (4, "password = hunter2secret99 " + full)]
    docs = spark.createDataFrame([(d, t, None, s, None, 1, 2, "r", "t", 3, 4, 0.5, 0.25) for s in ("a", None) for d, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, SF)
        if k < 4:
            assert got.columns == docs.columns
            found = got.collect()
            assert all((r["_id"], r["row"], r["_times"], r["taken"], r["_quality"]) == (1, "r", "t", 4, 0.5) for r in found)
            assert len(found) == {0: len(found), 1: 4, 2: 14}.get(k, len(found))  # 4 and the row without id are near copies of 1
        else:
            assert got.select("doc_id").distinct().count() == 5
