"""Stored indexes, search end to end, generation, lookups and write-back on small cases worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import flattening, parsing, text
from rankloom.operators import conversation, lexical, vectors
from rankloom.plans import experiments, generation, search
from rankloom.sources import passages, storage, turns


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("a", "red fox"), ("b", "red red hen"), ("c", "blue hen"), ("d", None)], "docid string, contents string")


@pytest.fixture(scope="module")
def asked(spark):
    one_ = lambda name, q: (name, q, [1])
    rows = [("1-1", "red hen", "o", [1], [one_("m_rar_rw", "red"), one_("m_rar_rs", "hen"), one_("m_judge_and_rewrite_rw", "blue"), one_("m_judge_and_rewrite_lv", "b: some")]), ("1-2", "fox", "o", [], [one_("m_rar_rw", "fox"), one_("m_rar_rs", "red"), one_("m_judge_and_rewrite_rw", "fox"), one_("m_judge_and_rewrite_lv", "c")])]
    return spark.createDataFrame(rows, "turn_id string, current_utterance string, oracle_utterance string, ptkb_provenance array<int>, reformulations array<struct<reformulation_name:string,reformulated_query:string,ptkb_provenance:array<int>>>")


def test_index(spark, docs, tmp_path):
    lists = lexical.term_lists(docs, "docid", "contents")
    found = lexical.write_index(lists, str(tmp_path / "index"))
    assert {(r["term"], r["docid"], r["tf"], r["dl"]) for r in found.postings.collect()} == {("red", "a", 1, 2), ("fox", "a", 1, 2), ("red", "b", 2, 3), ("hen", "b", 1, 3), ("blue", "c", 1, 2), ("hen", "c", 1, 2)}
    assert {(r["term"], r["df"], r["cf"], r["max_tf"]) for r in found.terms.collect()} == {("red", 2, 3, 2), ("fox", 1, 1, 1), ("hen", 2, 2, 1), ("blue", 1, 1, 1)}
    assert tuple(found.stats.first()) == (4, 7, 1.75)
    q = lexical.query_terms(spark.createDataFrame([(1, ["red", "hen"])], "qid int, words array<string>"), ["qid"])
    rows = lambda x: sorted((r["docid"], r["score"]) for r in lexical.bm25(q, x, ["qid"]).collect())
    assert rows(found) == rows(lists) and len(rows(found)) == 3


def test_index_once(spark, docs, tmp_path):
    path = str(tmp_path / "docs")
    docs.write.parquet(path)
    count = lambda: lexical.index_once(spark.read.parquet(path), "docid", "contents").stats.first()["n_docs"]
    assert count() == 4
    before = set(storage._kept)
    assert count() == 4 and set(storage._kept) == before
    docs.limit(1).write.mode("append").parquet(path)
    assert count() == 5


def test_small(spark):
    joined = lambda most: spark.range(1000).join(storage.small(spark.range(10), most), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in joined(10) and "strategy=broadcast" not in joined(9)


def test_query_list(asked):
    config = experiments.replace(experiments.PRESETS["by_level"], queries=("m_rar_rw", "m_rar_rwrs", "m_judge_and_rewrite_rw"), reranking_query="m_rar_rw", level_type="m_judge_and_rewrite")
    queries, texts = search.query_list(asked, config)
    assert {tuple(r) for r in queries.collect()} == {("1-1", "b", "red hen", "red", ""), ("1-2", "c", "fox", "fox", "")}
    assert {tuple(r) for r in texts.collect()} == {(0, "1-1", "red"), (1, "1-1", " hen"), (2, "1-1", "blue"), (0, "1-2", "fox"), (1, "1-2", " red"), (2, "1-2", "fox")}
    assert [r["qid"] for r in search.query_list(asked, experiments.replace(config, group="c"))[0].collect()] == ["1-2"]
    assert [r["qid"] for r in search.query_list(asked, config, ["1-1"])[0].collect()] == ["1-1"]


def test_search(spark, docs, asked, tmp_path):
    config = experiments.Config(lists=[0, 1], queries=("m_rar_rw", "m_judge_and_rewrite_rw"), fusion="linear_combination", weights=[1.0, 1.0], reranking_query="m_rar_rw", level_type="m_judge_and_rewrite", reranker="pointwise", rerank_k=2)
    queries, texts = search.query_list(asked, config)
    index = lexical.Index.of(lexical.term_lists(docs, "docid", "contents"))
    collection = search.Collection(docs, index)
    models = search.Models(score=lambda q, c: [-len(x) for x in c])
    got = {(r["qid"], r["docid"]): r["rank"] for r in search.search(queries, texts, collection, config, models).collect()}
    assert {k for k in got if k[0] == "1-1"} == {("1-1", x) for x in "abc"} and got["1-1", "b"] in (2, 3) and got["1-2", "a"] == 1
    listwise = experiments.replace(config, reranker="listwise", window=2, step=1, rerank_k=2)
    models = search.Models(permute=lambda q, c: [2, 1])
    assert search.search(queries, texts, collection, listwise, models).count() == len(got)
    with pytest.raises(ValueError):
        search.search(queries, texts, collection, experiments.replace(config, reranker="other"), models)
    # a stored run stands in for retrieval
    folder = str(tmp_path / "runs")
    plain = experiments.Config(retrieval_query="raw", k=3)
    q2, t2 = search.query_list(asked, plain)
    first = search.search(q2, t2, collection, plain, folder=folder)
    assert [x.startswith(search.name_of(plain)) for x in search.runs_in(spark, folder)] == [True] and search.stored_run(search.runs_in(spark, folder), "raw", "BM25")
    again = search.search(q2, t2, search.Collection(docs), plain, folder=folder)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))
    given = spark.createDataFrame([("1-1", "c", 2.0), ("1-1", "a", 3.0)], "qid string, docid string, score double")
    assert [r["docid"] for r in search.search(q2, t2, search.Collection(docs), plain, given=given).orderBy("rank").collect()] == ["a", "c"]


def test_stored_run():
    names = ["S1[raw]-S2[raw]-g[none]-[BM25]-[pointwise]-[s2_top50]", "S1[raw]-S2[x]-g[none]-[BM25]-[none]-[s2_top50]", "notes.txt"]
    assert search.stored_run(names, "raw", "BM25") == names[1] and search.stored_run(names, "raw", "dense") is None


def test_other_retrieval(spark, docs):
    texts = spark.createDataFrame([(0, "q1", "red"), (1, "q1", "blue"), (0, "q2", None)], "list_id int, qid string, text string")
    code = lambda xs: np.array([[float("red" in (x or "")), float("blue" in (x or ""))] for x in xs])
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "docid string, embedding array<float>")
    dense = experiments.Config(model="dense", lists=[0, 1], k=1)
    got = search.retrieve(texts, search.Collection(docs, vectors=v), dense, search.Models(encode=code)).collect()
    assert {(r["list_id"], r["qid"], r["docid"], r["rank"]) for r in got} == {(0, "q1", "a", 1), (1, "q1", "c", 1)}
    w = spark.createDataFrame([(1, "a", 2.0), (2, "c", 3.0)], "dim int, docid string, value double")
    sparse = experiments.Config(model="sparse", lists=[0, 1], k=5)
    got = search.retrieve(texts, search.Collection(docs, weights=w), sparse, search.Models(encode_terms=lambda xs: [{1: 1.0} if x == "red" else {2: 0.5, 9: 1.0} for x in xs])).collect()
    assert {(r["list_id"], r["docid"], r["score"]) for r in got} == {(0, "a", 2.0), (1, "c", 1.5)}
    with pytest.raises(ValueError):
        search.retrieve(texts, search.Collection(docs), experiments.Config(model="none"))


def test_vector_blocks(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"d{i}", "x" * i) for i in (3, 1, 2)], "n long, docid string, contents string")
    got = vectors.write_blocks(rows, "contents", "n", lambda xs: np.array([[len(x), 1.0] for x in xs]), str(tmp_path / "v"), 2)
    assert {(r["docid"], tuple(r["embedding"]), r["block"]) for r in got.collect()} == {("d1", (1.0, 1.0), 0), ("d2", (2.0, 1.0), 0), ("d3", (3.0, 1.0), 1)}


def test_generation(spark, docs):
    t = spark.createDataFrame([("1", "x"), ("2", "bad"), ("3", None)], "turn_id string, text string")
    model = lambda prompts: ["Rewrite: r\nResponse: s" if "bad" not in p else "no" for p in prompts]
    old = spark.createDataFrame([("1", "n_rw", "old", 0), ("2", "n_rw", "old", 0)], "turn_id string, name string, query string, seq int")
    got = generation.rewritten(t, F.col("text"), model, parsing.parse_rewrite_response, "n", old)
    assert {(r["turn_id"], r["name"], r["query"]) for r in got.collect()} == {("1", "n_rw", "r"), ("1", "n_rs", "s"), ("2", "n_rw", "old")}
    many = generation.several(t.limit(1), F.col("text"), lambda p: ["1. foo\n- bar"], "mq", 3, "GG").collect()
    assert [(r["name"], r["query"]) for r in many] == [("mq_1", "foo"), ("mq_2", "bar"), ("mq_3", "GG")]
    run = spark.createDataFrame([("1", "a", 1.0, 1), ("1", "b", 0.5, 2), ("2", "zzz", 1.0, 1)], "qid string, docid string, score double, rank int")
    people = spark.createDataFrame([("1", ["before"], ["likes tea"]), ("2", [], [])], "qid string, context array<string>, profile array<string>")
    queries = spark.createDataFrame([("1", "now"), ("2", "then")], "qid string, generation string")
    seen = lambda prompts: [f"Response: {p}" for p in prompts]
    got = {r["qid"]: r["response"] for r in generation.responses(people, queries, run, docs, seen, 1).collect()}
    assert got["1"].startswith("Passages:\n1. red fox\n\n") and "hen" not in got["1"] and "likes tea" in got["1"] and "Passages" not in got["2"]
    assert {r["response"] for r in generation.responses(people, queries, run, docs, None, kind="none").collect()} == {"No response generated"}


def test_demonstrations(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"turns": [{"question": "q", "manual_rewrite": "w", "response": "r", "cot": "c"}]}, {"turns": []}]')
    assert generation.read_demonstrations(spark, str(tmp_path / "d.json")) == "Example #1:\nQuestion: q\nRewrite: w\nResponse: r\n\nExample #2:\n"
    assert "Rewrite: c so w" in generation.read_demonstrations(spark, str(tmp_path / "d.json"), "so ")
    with pytest.warns(UserWarning):
        assert generation.read_demonstrations(spark, str(tmp_path / "none.json")) == ""


def test_turn_lookups(spark, asked):
    twice = asked.withColumn("reformulations", F.concat("reformulations", "reformulations"))
    assert asked.select(conversation.reformulation("none").alias("x")).first()["x"] is None
    for broken in (lambda: twice.select(conversation.reformulation("m_rar_rw")).collect(), lambda: asked.select(conversation.provenance_of("none")).collect(), lambda: conversation.turn_of(asked, spark.createDataFrame([("9",)], "qid string")).collect()):
        with pytest.raises(Exception, match="several|no "):
            broken()
    schema = turns.TURNS[turns.TURNS.index("results ") + 8 :]
    t = spark.createDataFrame([("t", None)], f"turn_id string, results {schema}")
    new = spark.createDataFrame([("t", "c", "BM25", "none", "g", "a", "b", "c", {"map": 0.5}, "r")], "turn_id string, collection string, retrieval_model string, reranker string, generation_model string, retrieval_query_type string, reranking_query_type string, generation_query_type string, metrics map<string,double>, response string")
    first = conversation.with_results(t, new)
    second = conversation.with_results(first, new.withColumn("response", F.lit("s")))
    assert [(x["metrics"]["map"], x["response"]) for x in second.first()["results"]] == [(0.5, "s")]
    key = dict(zip(conversation.RESULT_KEY, ("c", "BM25", "none", "g", "a", "b", "c")))
    assert second.select(conversation.result(key)["response"].alias("x")).first()["x"] == "s" and conversation.with_results(t, new.limit(0)).first()["results"] == []


def test_passages(spark, docs):
    lines = spark.createDataFrame([("p1\ta\tb\thttp://u",), ("p2\ta",)], "value string")
    assert [r["value"] for r in passages.clean_tsv(lines).collect()] == ["p1\ta    b"]
    rows = spark.range(1000)
    assert [r["id"] for r in passages.sampled(rows, "id", 5).collect()] == [r["id"] for r in passages.sampled(rows.repartition(7), "id", 5).collect()]
    places = {r["id"]: r["place"] for r in passages.permuted(rows, "id").collect()}
    assert sorted(places.values()) == list(range(1000)) and places != {r["id"]: r["place"] for r in passages.permuted(rows, "id", 1).collect()}
    words = spark.createDataFrame([("Foxes",), ("xyz",)], "w string")
    vocabulary = spark.createDataFrame([("FOX",)], "v string")
    assert [r["w"] for r in text.known_words(words, "w", vocabulary, "v", lambda c: F.regexp_replace(F.lower(c), "es$", "")).collect()] == ["Foxes"]


def test_stop_words(tmp_path, spark):
    (tmp_path / "long.txt").write_text("a b\nc a")
    assert len(text.stop_words()) < len(text.stop_words("longer")) and text.stop_words("long", str(tmp_path / "long.txt")) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        text.stop_words("long")
    assert one(spark, text.without_stop_words(F.split(F.lit("what is of fox"), " "))) == ["of", "fox"]


def test_parsers(spark):
    assert one(spark, parsing.parse_lines(F.lit(" a \n b\n"))) == ["a", "b"]
    assert one(spark, parsing.parse_expansion(F.lit("Rewrite: x\nResponse: y\nz"))) is None
    got = one(spark, parsing.parse_expansion(F.lit("Rewrite: x\nResponse: y\nReason: z")))
    assert (got["rewrite"], got["response"], got["cot"]) == ("x", "y\nReason: z", None)
    assert one(spark, parsing.parse_expansion(F.lit("Rewrite: x\nReason: z"), "so ")) is None
    words = F.array(*map(F.lit, ("a", ":", "b")))
    row = lambda *x: F.array(*map(F.lit, x))
    got = one(spark, parsing.expansion_terms(F.array(row(1.0, 0.0, 0.0), row(0.0, 1.0, 0.0), row(0.5, 0.1, 0.9)), words, 2))
    assert [(r["token"], r["logit"]) for r in got] == [("b", 0.9), ("a", 0.5)]
    assert one(spark, parsing.expansion_terms(F.array(row(1.0, 0.0, 0.0)), words, 2)) is None
    messages = one(spark, parsing.listwise_prompt(F.lit("q"), F.array(F.lit("a b c"), F.lit("d")), 2))
    assert len(messages) == 8 and messages[3]["content"] == "[1] a b" and "q" in messages[-1]["content"]
    assert "receive" not in one(spark, parsing.completion_prompt(parsing.listwise_prompt(F.lit("q"), F.array(F.lit("a")))))


def test_flattening(spark):
    split = lambda x: F.split(F.lit(x), " ")
    assert one(spark, flattening.turn_text(split("q1 q2 q3"), F.array(split("a b c"), split("d e f")), 6, 2, 1)) == ["q1", "q2", "d", "a", "b"]
    assert one(spark, flattening.single_context(split("q"), split("a b c"), 3, 9)) == ["q", "a", "c"]
    assert one(spark, flattening.split_context(F.lit("a [SEP] b"))) == ["a", "b"] and one(spark, flattening.split_context(F.lit(None).cast("string"))) == []
    assert one(spark, flattening.labelled(F.lit("q"), F.array(F.lit("a"), F.lit("b")))) == "[Current question]: q [Context]: b a"
    rows = spark.createDataFrame([(None, ["x"]), ("y", None)], "query string, made array<string>")
    assert [r["x"] for r in rows.select(flattening.first_field(rows, ["none", "made", "query"]).alias("x")).collect()] == ["x", "y"]
    with pytest.raises(ValueError):
        flattening.first_field(rows, ["none"])
    assert tuple(one(spark, flattening.fixed_length(F.array(F.lit(5)), 2))) == ([5, 0], [1, 0])
    assert "Question: q" in one(spark, flattening.task_prompt("rewrite", F.lit("q"), F.array(F.lit("a"))))


def test_experiments_do_not_leak():
    config = {"iterate": {"m": ["x", "y"]}, "param_mapping": {"m": {"x": {"only_x": True}}}, "fixed": {"l": [1, 2], "off": False}}
    got = experiments.run_all(config, experiments.flags)
    assert [f for _, f in got] == [["--l", "1 2", "--only_x", "--m", "x"], ["--l", "1 2", "--m", "y"]]
    assert experiments.by_name(["a", "b"], [1.0, 0.4]).queries == ("a", "b")
