"""The stored index, keyed passages, run catalogue and sinks: what is read, what is exchanged, and what a second write leaves."""

import json
import math

import pytest
from pyspark.sql import functions as F

from rankloom.operators import conversation, impacts, lexical, metrics, ranking
from rankloom.operators import index as index_module
from rankloom.plans import catalog, experiments, runs, search
from rankloom.sources import passages, sinks, tables
from rankloom.sources.storage import kept

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("docid"), F.col("text").alias("contents"))


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    lists = lexical.term_lists(docs, "docid", "contents")
    return lexical.write_index(lists, str(tmp_path_factory.mktemp("index") / "i"), folders=16, buckets=8)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def bytes_read(df):
    """Of the files that a scan without exchanges has opened."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("filesSize").value()


def test_search_opens_its_terms_folders(spark, index):
    wanted = kept(spark.createDataFrame([("the",), ("zwei",)], "term string"))
    few, rows = index.met_by(wanted)
    assert "PartitionFilters: [folder" in plan(rows) and "In(term" in plan(rows)
    assert 0 < bytes_read(rows) < bytes_read(index.postings) / 4
    assert {r["term"] for r in rows.collect()} <= {"the", "zwei"}
    all_terms = kept(index.terms.select("term"))
    assert "PartitionFilters: []" in plan(index.met_by(all_terms)[1])


def test_scores_are_summed_without_an_exchange(spark, index):
    q = lexical.query_terms(spark.createDataFrame([(1, ["the", "and"])], "qid int, words array<string>"), ["qid"])
    text = plan(lexical.bm25(q, index, ["qid"], 5))
    assert text.count("Exchange hashpartitioning") == 1 and text.index("WindowGroupLimit") < text.index("Exchange hashpartitioning") < text.index("HashAggregate")


def test_stored_and_computed_index_agree(spark, docs, index):
    other = lexical.Index.of(lexical.term_lists(docs, "docid", "contents"))
    assert sorted(map(tuple, index.postings.select("term", "docid", "tf", "dl").collect())) == sorted(map(tuple, other.postings.select("term", "docid", "tf", "dl").collect()))
    assert sorted(map(tuple, index.terms.collect())) == sorted(map(tuple, other.terms.collect()))
    assert index.stats.select("n_docs", "n_tokens", "avgdl").first() == other.stats.first()


def test_passages_without_terms_count(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x y x"), ("b", ""), ("c", None)], "docid string, contents string")
    found = lexical.write_index(lexical.term_lists(rows, "docid", "contents"), str(tmp_path / "i"), positions=True)
    s = found.stats.first()
    assert (s["n_docs"], s["n_tokens"], s["avgdl"]) == (3, 3, 1.0)
    assert {(r["term"], r["tf"], tuple(r["gaps"])) for r in found.postings.collect()} == {("x", 2, (0, 2)), ("y", 1, (1,))}
    empty = lexical.write_index(lexical.term_lists(rows.limit(0), "docid", "contents"), str(tmp_path / "e"))
    assert empty.stats.first()["n_docs"] == 0 and empty.postings.count() == 0


def test_feedback_reads_its_passages_alone(spark, index):
    wanted = kept(spark.createDataFrame([(3,), (5,)], "docid long"))
    rows = index.of_passages(wanted)
    assert "In(docid" in plan(rows) and {r["docid"] for r in rows.collect()} == {3, 5}
    opened = rows._jdf.queryExecution().executedPlan().collectLeaves().apply(0).optionalBucketSet()
    assert opened.isDefined() and opened.get().cardinality() <= 2 < 8


def test_index_of_another_session(spark, docs, tmp_path):
    """What a table is dealt by is read from its specification."""
    path = str(tmp_path / "t")
    tables.write_table(docs, path, 4, "docid", ["docid"])
    tables.drop_table(spark, path)
    again = tables.read_table(spark, path)
    assert again.count() == docs.count() and "hashpartitioning(docid" not in plan(again.groupBy("docid").count())


def test_index_once_tells_plans_apart(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([("a", "x y", "de"), ("b", "z", "en")], "docid string, contents string, lang string").write.parquet(path)
    rows = lambda: spark.read.parquet(path)
    once = lambda df: lexical.index_once(df, "docid", "contents")
    n = lambda df: once(df).stats.first()["n_docs"]
    assert n(rows()) == 2 and n(rows().filter("lang = 'de'")) == 1 and n(rows().filter("lang = 'en'")) == 1
    assert [r["term"] for r in once(rows().withColumn("contents", F.lit("q"))).terms.collect()] == ["q"]
    before = once(rows()).postings.inputFiles()
    assert sorted(once(rows()).postings.inputFiles()) == sorted(before)
    spark.createDataFrame([("c", "w", "de")], "docid string, contents string, lang string").write.mode("append").parquet(path)
    assert n(rows()) == 3


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def exchanged(df):
    """The columns that exchanges of the plan carry."""
    lines = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n")
    return [lines[i + 1] for i, line in enumerate(lines) if line.startswith("(") and ") Exchange" in line]


def test_lookups_leave_texts_where_they_are(spark, docs, no_broadcast):
    ids = spark.createDataFrame([(3,), (4,), (10**9,), (3,)], "docid long")
    got = passages.by_ids(docs, ids)
    assert not any("contents" in x for x in exchanged(got))
    rows = got.collect()
    assert sorted(r["docid"] for r in rows) == [3, 3, 4, 10**9] and [r["contents"] for r in rows if r["docid"] == 10**9] == [None]
    assert not any("contents" in x or "text" in x for x in exchanged(catalog.passage_lookup(spark, DATA)))


def test_any_number_of_ids_meets_a_store(spark, docs, tmp_path, no_broadcast, monkeypatch):
    store = passages.write_passages(docs, str(tmp_path / "store"), 8)
    monkeypatch.setattr(passages, "small", lambda df: df)
    monkeypatch.setattr(tables, "MOST_LITERALS", 2)
    got = passages.by_ids(store, docs.select("docid"))
    assert not any("contents" in x for x in exchanged(got)) and exchanged(got)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))


def test_turn_of(spark):
    t = spark.createDataFrame([("1-1", 2, "b"), ("1-1", 1, "a"), ("1-2", 1, "c")], "turn_id string, n int, text string")
    ask = lambda *ids: spark.createDataFrame([(i,) for i in ids], "qid string")
    assert {tuple(r) for r in conversation.turn_of(t, ask("1-1", "1-2"), "n").select("qid", "text").collect()} == {("1-1", "a"), ("1-2", "c")}
    assert conversation.turn_of(t, ask("1-1")).count() == 1
    for columns in (["qid", "text"], ["turn_id"], ["qid"]):
        with pytest.raises(Exception, match="no turn 9-9"):
            conversation.turn_of(t, ask("1-1", "9-9")).select(*columns).collect()
    with pytest.raises(Exception, match="no turn null"):
        conversation.turn_of(t, ask(None)).select("text").collect()


def test_runs_of_other_settings_are_not_served(spark, docs, index, tmp_path):
    queries = spark.createDataFrame([("1", "a", "the and", "", "")], "qid string, level string, retrieval string, reranking string, generation string")
    texts = lambda x: spark.createDataFrame([(0, "1", x)], "list_id int, qid string, text string")
    collection, folder = search.Collection(docs, index), str(tmp_path / "runs")
    config = experiments.Config(k=5)
    find = lambda c, x="the and", col=collection: search.search(queries, texts(x), col, c, folder=folder)
    assert find(config).count() == 5
    stored = search.runs_in(spark, folder)
    assert len(stored) == 1 and stored[0].startswith(search.name_of(config))
    assert find(experiments.replace(config, k=20)).count() == 20
    two = find(experiments.replace(config, k1=2.0)).orderBy("rank").collect()
    assert two != find(config).orderBy("rank").collect()
    assert find(config, "zwei").count() <= 5 and len(search.runs_in(spark, folder)) == 4
    find(config), find(config)
    assert len(search.runs_in(spark, folder)) == 4
    # without an index only a catalogued run can answer
    assert find(config, col=search.Collection(docs)).count() == 5
    with pytest.raises(Exception):
        find(experiments.replace(config, k=7), col=search.Collection(docs)).count()
    d = runs.digests(texts("the and"), 1, collection, config)
    assert d != runs.digests(texts("the or"), 1, collection, config) and d != runs.digests(texts("the and"), 1, collection, experiments.replace(config, feedback=True))


def test_sinks_written_twice(spark, tmp_path):
    folder = str(tmp_path / "out")
    per = spark.createDataFrame([("1", 0.5)], "qid string, map double")
    for name, value in (("a", 0.25), ("b", 0.5), ("a", 0.75)):
        sinks.save_measures(per, spark.createDataFrame([(1, value)], "n_queries int, map double"), folder, name, ["map"])
    rows = spark.read.text(f"{folder}/measures").collect()
    assert {(r["measure"], r["run"], r["value"]) for r in rows} == {("map", "a", "a-[0.75]"), ("map", "b", "b-[0.5]")} and len(rows) == 2
    assert json.loads(spark.read.text(f"{folder}/means/a").first()[0])["map"] == 0.75


def test_buckets_grow_with_the_texts(spark, docs, tmp_path, monkeypatch):
    """What a task of the index holds doesn't grow with the collection; texts are moved once, and each bucket is a file."""
    monkeypatch.setattr(tables, "BUCKET_BYTES", 4096)
    n = tables.buckets_for(docs)
    assert n >= 290_000 // 4096 > spark.sparkContext.defaultParallelism
    moved = lexical.term_lists(docs, "docid", "contents", n)
    found = lexical.index_texts(docs, "docid", "contents", str(tmp_path / "i"))
    assert moved.rdd.getNumPartitions() == n
    files = [f.rpartition("/")[2] for f in found.passages.inputFiles()]
    assert len(files) == len({f.rpartition("_")[2] for f in files}) > spark.sparkContext.defaultParallelism
    other = lexical.Index.of(moved)
    assert sorted(map(tuple, found.terms.collect())) == sorted(map(tuple, other.terms.collect()))


def test_runs_are_retrieved_once(spark):
    """What is made of runs reads them from where they were written, not from the postings again."""
    for name in ("fuse_per_level", "fuse_concat", "fuse_round_robin", "norm_max", "fuse_linear_comb_1000"):
        assert "rankloom_" not in plan(catalog.QUERIES[name](spark, DATA))
    for name in ("search_end_to_end", "search_end_to_end_1000"):
        assert plan(catalog.QUERIES[name](spark, DATA)).count("rankloom_") == 0


def test_postings_come_from_whole_buckets(spark, docs, tmp_path, monkeypatch):
    """Postings are written from the stored passages, a bucket a task, and nothing is exchanged for it."""
    plans, tasks, write = [], [], index_module.write_table

    def seen(df, path, buckets, by, *more, **named):
        if path.endswith("/postings"):
            dealt = df.repartition(buckets, by)
            plans.append(plan(dealt))
            tasks.append(dealt._jdf.queryExecution().toRdd().getNumPartitions())
        return write(df, path, buckets, by, *more, **named)

    monkeypatch.setattr(index_module, "write_table", seen)
    key = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    before = spark.conf.get(key)
    found = lexical.write_index(lexical.term_lists(docs, "docid", "contents"), str(tmp_path / "i"), folders=2, buckets=8)
    assert "Exchange" not in plans[0] and tasks == [8] and spark.conf.get(key) == before
    assert len(found.postings.inputFiles()) == 16
    other = lexical.Index.of(lexical.term_lists(docs, "docid", "contents"))
    assert sorted(map(tuple, found.postings.select("term", "docid", "tf", "dl").collect())) == sorted(map(tuple, other.postings.select("term", "docid", "tf", "dl").collect()))


def test_judgements_stay_where_they_are(spark, no_broadcast, monkeypatch):
    """Only judgements of a run's passages are exchanged; the best gain comes from counts, as from all rows in order."""
    monkeypatch.setattr(metrics, "PLACES_AT_ONCE", 3)
    rels = {1: [2, 0, 1, 1, 2, 1, 0, 1, 1, 1, None, -1], 2: [0, 0], 3: [1], 4: [None], 5: [-1, 3]}
    rows = [(q, i, x) for q, xs in rels.items() for i, x in enumerate(xs)]
    qrels = kept(spark.createDataFrame(rows, "qid int, docid int, rel int"))
    best = metrics.ideal(qrels, (1, 5))
    assert exchanged(best) and not any("docid" in x for x in exchanged(best))
    got = {r["qid"]: r for r in best.collect()}
    for q, xs in rels.items():
        gains = [max(x or 0, 0) / math.log2(i + 2) for i, x in enumerate(sorted(xs, key=lambda x: -9 if x is None else x, reverse=True))]
        assert (got[q]["num_rel"] or 0, *(got[q][c] for c in ("idcg", "idcg_1", "idcg_5"))) == pytest.approx((sum((x or 0) > 0 for x in xs), sum(gains), gains[0], sum(gains[:5])))
    run = kept(spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 10, 3), (1, 99, 4), (9, 0, 1)], "qid int, docid int, rank int"))
    seen = metrics.judged(run, qrels)
    assert "LeftSemi, BuildRight" in plan(seen)
    assert {(r["qid"], r["docid"]): r["rel"] for r in seen.collect()} == {(1, 0): 2, (1, 1): 0, (1, 10): 0, (1, 99): 0, (9, 0): 0}


def test_no_row_for_a_query_and_passage(spark, index):
    """Passages meet queries in blocks, and what comes out is what sums of all parts give, ties and cuts included."""
    items = catalog.three_queries(spark, DATA)
    q = lexical.query_terms(items, ["list_id", "qid"])
    found = lexical.bm25(q, index, ["list_id", "qid"], 20)
    assert "MapInArrow" in plan(found) and "keys=[list_id" not in plan(found)
    sums = lambda w: ranking.ranked(lexical.contributions(w, index).groupBy("list_id", "qid", "docid").agg(ranking.settled(F.sum("part")).alias("score")), ["list_id", "qid"], 20)
    rows = lambda df: sorted(map(tuple, df.select("list_id", "qid", "docid", "score", "rank").collect()))
    assert rows(found) == rows(sums(q)) != []
    # a term without weight still makes a passage a candidate, so these are summed row by row
    none = q.withColumn("qtf", F.lit(0.0))
    assert rows(lexical.bm25(none, index, ["list_id", "qid"], 20)) == rows(sums(none)) != []


def test_many_queries_in_passes_and_blocks(spark, index, monkeypatch):
    q = lexical.query_terms(catalog.items(spark, DATA), ["qid"])
    rows = lambda: sorted(map(tuple, lexical.bm25(q, index, ["qid"], 7).select("qid", "docid", "score", "rank").collect()))
    whole = rows()
    for name, value in (("QUERY_BYTES", 4096), ("PASSAGES", 16), ("QUERIES", 3)):
        monkeypatch.setattr(impacts, name, value)
    assert rows() == whole and len(whole) == 7 * catalog.items(spark, DATA).count()


def test_explanation_moves_its_passages_parts_alone(spark, index, no_broadcast):
    """The best are found first; no part of another passage is exchanged."""
    items = catalog.items(spark, DATA)
    q = lexical.query_terms(items, ["qid"])
    found = lexical.bm25_explain(q, index, ["qid"], 3)
    assert not exchanged(found)
    parts = lexical.contributions(q, index)
    best = lexical.bm25(q, index, ["qid"], 3)
    other = parts.join(best, ["qid", "docid"]).select("qid", "docid", "rank", "term", "tf", "df", ranking.settled(F.col("part")).alias("part"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, other.collect())) != []
