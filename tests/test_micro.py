"""Small cases with answers worked out by hand."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import parsing, text
from rankloom.operators import conversation, fusion, metrics, rerank, tuning, vectors
from rankloom.operators.ranking import normalized, ranked
from rankloom.plans import experiments
from rankloom.sources import passages, trec, turns
from rankloom.streaming import index as stream


def run_of(spark, lists):
    rows = [(i, "q", d, float(s)) for i, x in enumerate(lists) for d, s in x.items()]
    return ranked(spark.createDataFrame(rows, "list_id int, qid string, docid string, score double"), ["list_id", "qid"])


def scores(df):
    return {r["docid"]: round(r["score"], 6) for r in df.collect()}


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


A, B = {"a": 4, "b": 2}, {"b": 6, "c": 3}


def test_normalised(spark):
    r = run_of(spark, [{"a": 10, "b": 6, "c": 2}])
    assert scores(normalized(r, "min-max", ["qid"])) == {"a": 1.0, "b": 0.5, "c": 0.0}
    assert scores(normalized(r, "max", ["qid"])) == {"a": 1.0, "b": 0.6, "c": 0.2}
    assert scores(normalized(run_of(spark, [{"a": 5, "b": 5}]), "min-max", ["qid"])) == {"a": 0.0, "b": 0.0}
    with pytest.raises(ValueError):
        normalized(r, "other", ["qid"])


def test_fusion(spark):
    r = run_of(spark, [A, B])
    lists = [r.filter(f"list_id = {i}") for i in (0, 1)]
    assert scores(fusion.linear_weighted(*lists, 0.5)) == {"a": 5.5, "b": 5.0, "c": 3.5}
    w = fusion.same_weights(r, [1.0, 0.5])
    assert scores(fusion.linear_combination(r, w)) == {"a": 5.5, "b": 5.0, "c": 3.5}
    assert scores(fusion.linear_combination(r, w, missing="zero")) == {"a": 4.0, "b": 5.0, "c": 1.5}
    assert scores(fusion.concatenation(r)) == {"a": 4.0, "b": 2.0, "c": 3.0}
    got = fusion.reciprocal_rank(r).orderBy("rank").collect()
    assert [x["docid"] for x in got] == ["b", "a", "c"] and got[0]["score"] == round(1 / 62 + 1 / 61, 6)


def test_one_weight_is_its_list(spark):
    r = run_of(spark, [A, B])
    got = fusion.linear_combination(r, fusion.same_weights(r, [0.0, 1.0])).orderBy("rank").collect()
    assert [x["docid"] for x in got][:2] == ["b", "a"] or got[0]["docid"] == "b"
    assert scores(fusion.linear_combination(r, fusion.same_weights(r, [1.0, 0.0])))["a"] == 4.0


def test_round_robin(spark):
    assert [fusion.draw_order(n) for n in (2, 3, 4)] == [[1, 0], [1, 0, 2], [2, 1, 3, 0]]
    r = run_of(spark, [{"a": 9, "b": 8, "c": 7}, {"b": 6, "d": 5}])
    assert scores(fusion.round_robin(r, 2, 3)) == {"b": 1.0, "a": 0.5, "d": 0.333333}
    assert scores(fusion.round_robin(r, 2, 10)) == {"b": 6.0, "a": 9.0, "d": 5.0}


def test_level_weights(spark):
    t = spark.createDataFrame([(x,) for x in "abcd"], "level string").select(*(fusion.level_weight(F.col("level"), k).alias(f"w{k}") for k in (1, 2, 3))).collect()
    assert [r["w1"] for r in t] == [0, 0.25, 0.5, 0.75] and [r["w2"] for r in t] == [0.1875, 0.375, 0.5625, 0.75] and [r["w3"] for r in t] == [0.4, 0.5, 0.6, 0.6]
    third = one(spark, fusion.three_weights((F.lit(0.6), F.lit(0.4)), (F.lit(0.8), F.lit(0.2))))
    assert third == pytest.approx([0.6, 0.4, 0.25])
    assert one(spark, fusion.three_weights((F.lit(0.6), F.lit(0.4)), (F.lit(0.0), F.lit(1.0))))[2] is None


def test_grid():
    assert len(tuning.grid(3, 10)) == 66 and len(tuning.grid(3, 100)) == 5151 and len(tuning.grid(2, 100)) == 101
    assert all(math.isclose(sum(t), 1) for t in tuning.grid(3, 100))


def test_measures(spark):
    run = spark.createDataFrame([("q", f"d{i}", i) for i in (1, 2, 3)], "qid string, docid string, rank int")
    qrels = spark.createDataFrame([("q", "d1", 0), ("q", "d2", 2), ("q", "d3", 1), ("q", "d4", 1)], "qid string, docid string, rel int")
    m = metrics.per_query(run, qrels).first()
    assert (m["recip_rank"], m["p_1"], m["p_3"], m["recall_5"]) == (0.5, 0.0, round(2 / 3, 6), round(2 / 3, 6))
    assert m["map"] == 0.388889 and m["ndcg_cut_3"] == round((2 / math.log2(3) + 0.5) / (2 + 1 / math.log2(3) + 0.5), 6) and m["num_rel"] == 3
    none = metrics.per_query(run, qrels.limit(0))
    assert none.count() == 0


def test_rerank(spark):
    run = spark.createDataFrame([("q", f"d{i}", i, s) for i, s in zip(range(1, 6), (0.1, 0.9, 0.5, 1.0, 1.0))], "qid string, docid string, rank int, m double")
    got = rerank.rescored(run, "m", 3).orderBy("rank").collect()
    assert [r["docid"] for r in got] == ["d2", "d3", "d1", "d4", "d5"] and [r["score"] for r in got] == [1, 0.5, 0.333333, 0.25, 0.2]
    assert rerank.repaired([3, 1, 3, 9], 4) == [2, 0, 1, 3]
    assert one(spark, parsing.repair_permutation(F.lit("[3] > [1] > [3] > [9]"), F.lit(4))) == [3, 1, 2, 4]
    assert rerank.window_starts(5, 2, 1) == [(3, 5), (2, 4), (1, 3), (0, 2)] and rerank.window_starts(2, 3, 1) == []
    pairs = spark.createDataFrame([("a", "bb"), ("a", "c")], "query string, contents string")
    assert sorted(r["model_score"] for r in rerank.scored(pairs, lambda q, c: np.array([len(x) for x in c])).collect()) == [1.0, 2.0]


def test_resolver(spark):
    assert [text.copies_for_weight(w) for w in (0, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9)] == [0, 1, 1, 2, 3, 4, 9]
    with pytest.raises(ValueError):
        text.copies_for_weight(1.0)
    t = spark.range(1).select(F.lit("now").alias("current"), F.create_map(F.lit("x_rw"), F.lit("q"), F.lit("x_rs"), F.lit("r"), F.lit("x_lv"), F.lit("b: some")).alias("queries"))
    r = t.select(conversation.resolve("x_rwrs", w=0.5).alias("a"), conversation.resolve("x_rwrs+raw", w=0.5).alias("b"), conversation.resolve("y_rwrs", w=0.5).alias("c"), conversation.level_of("x").alias("d"), conversation.level_of("z").alias("e")).first()
    assert tuple(r) == ("q r", " r now", None, "b", None)


def test_judgement(spark):
    answer = "Reason: x\nLevel: b\nRewrite: y\nResponse: z1\nz2"
    assert tuple(one(spark, parsing.parse_judgement(F.lit(answer)))) == ("x", "b", "y", "z1\nz2")
    assert one(spark, parsing.parse_judgement(F.lit("Reason: x\nRewrite: y\nResponse: z"))) is None
    assert one(spark, parsing.parse_queries(F.lit('1. foo\n- bar\n"baz"'))) == ["foo", "bar", "baz"]
    assert one(spark, parsing.parse_queries(F.lit("1. foo\n\nbar"))) is None
    assert one(spark, parsing.parse_prefixed(F.lit("Summary: s"), "Summary: ")) == "s" and one(spark, parsing.parse_prefixed(F.lit("s"), "Summary: ")) is None


def test_text(spark):
    assert one(spark, text.as_sentence(F.lit('what is "it"?'))) == "What is it?" and one(spark, text.as_sentence(F.lit("go on"))) == "Go on."
    assert one(spark, text.truncate_words(F.lit(" a  b\nc d "), 3)) == "a b c"
    ids, mask = text.pad(F.array(F.lit(5), F.lit(6)), 4)
    assert one(spark, ids) == [5, 6, 0, 0] and one(spark, mask) == [1, 1, 0, 0]
    assert one(spark, text.terms(F.lit(None).cast("string"))) == [] and one(spark, text.file_stem(F.lit("/a/b.c.txt"))) == "b.c"
    flat = text.flatten_context(F.split(F.lit("q1 q2"), " "), F.array(F.split(F.lit("a b c d"), " "), F.split(F.lit("e f"), " ")), 6, 10)
    assert one(spark, flat) == ["q1", "q2", "e", "f", "a", "d"]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0, 0.3]), (2, [0.0, 0.4, 0.0]), (3, [0.5, 0.0, 0.0])], "docid long, embedding array<double>")
    assert {(r["dim"], r["docid"], r["value"]) for r in vectors.inverted(v).collect()} == {(2, 1, 0.3), (1, 2, 0.4), (0, 3, 0.5)}
    got = vectors.dense(v.filter("docid = 3").withColumnRenamed("docid", "qid"), v, 1).collect()
    assert [(r["qid"], r["docid"], r["score"]) for r in got] == [(3, 3, 0.25)]
    assert one(spark, vectors.pooled(F.array(F.array(F.lit(-1.0), F.lit(1.0)), F.array(F.lit(3.0), F.lit(0.0))))) == pytest.approx([math.log(4), math.log(2)])
    coded = vectors.encoded(spark.createDataFrame([("ab",), (None,)], "t string"), "t", lambda x: np.array([[len(y)] for y in x])).collect()
    assert sorted(r["embedding"][0] for r in coded) == [0.0, 2.0]
    s = spark.createDataFrame([("q", "a", 2.0), ("q", "b", 1.0), ("q", "c", -5.0)], "qid string, docid string, score double")
    assert {r["docid"] for r in vectors.nucleus(s, ["qid"], 0.5).collect()} == {"a"}


def test_files(spark, tmp_path):
    lines = spark.createDataFrame([("p1\ta\tb\thttp://u",), ("p2\ta",), ("p3\ta\tftp://u",)], "value string")
    assert [tuple(r) for r in passages.repaired_tsv(lines).orderBy("docid").collect()] == [("p1", "a    b", "http://u", True), ("p2", None, None, False), ("p3", None, None, False)]
    b = passages.blocks(spark.createDataFrame([(i,) for i in (5, 70000, 200000)], "i long"), "i", 2).orderBy("i").collect()
    assert [(r["pos"], r["block"]) for r in b] == [(0, 0), (1, 0), (2, 1)]
    run = run_of(spark, [A]).drop("list_id")
    trec.write_run(run, str(tmp_path / "run"), "t")
    assert scores(trec.read_run(spark, str(tmp_path / "run"))) == {"a": 4.0, "b": 2.0}
    c = passages.collection(spark.createDataFrame([("1", "t", "x"), ("z", None, "y"), ("2", None, None)], "docid string, title string, text string"))
    assert {tuple(r) for r in c.collect()} == {(1, "t[SEP]x"), (2, "")}


def test_topics(spark, tmp_path):
    topic = [{"number": "9-1", "title": "t", "ptkb": {"1": "p"}, "turns": [{"turn_id": str(i), "utterance": f"u{i}", "response": "r", "response_provenance": [], "resolved_utterance": "o", "ptkb_provenance": [1]} for i in (1, 2, 10)]}]
    (tmp_path / "topics.json").write_text(json.dumps(topic))
    got = {r["turn_id"]: r["context_utterances"] for r in turns.read_topics(spark, str(tmp_path / "topics.json")).collect()}
    assert got == {"9-1-1": [], "9-1-2": ["u1"], "9-1-10": ["u1", "u2"]}
    run = run_of(spark, [A]).drop("list_id").withColumn("qid", F.lit("9-1-3"))
    s = turns.submission(run, spark.createDataFrame([("9-1-3", "answer")], "qid string, text string"), 1, "name").first()
    assert s["turns"][0]["turn_id"] == "9-1_3" and [p["used"] for p in s["turns"][0]["responses"][0]["passage_provenance"]] == [True, False]


def test_upsert(spark):
    schema = "turn_id string, name string, query string, seq int"
    old = spark.createDataFrame([("t", "a", "1", 0), ("t", "b", "2", 0)], schema)
    new = spark.createDataFrame([("t", "a", "3", 1), ("t", "a", "4", 2)], schema)
    assert {(r["name"], r["query"]) for r in conversation.upserted(old, new, ["turn_id", "name"]).collect()} == {("a", "4"), ("b", "2")}


def test_experiments(tmp_path):
    config = {"iterate": {"m": ["x", "y"], "n": [1, 2]}, "param_mapping": {"m": {"x": {"k": 5, "n": 9}}}, "fixed": {"k": 1}}
    (tmp_path / "c.json").write_text(json.dumps(config))
    got = experiments.combinations(experiments.load_config(str(tmp_path / "c.json")))
    assert got == [{"k": 5, "n": 1, "m": "x"}, {"k": 5, "n": 2, "m": "x"}, {"k": 1, "n": 1, "m": "y"}, {"k": 1, "n": 2, "m": "y"}]
    with pytest.raises(ValueError):
        experiments.load_config(__file__)
    assert experiments.Config.of({"k": 7, "unknown": 1}).k == 7


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": "1", "contents": "x y x"}\n{"id": "2", "contents": "x"}\n')
    s = stream.passage_stream(spark, str(tmp_path / "in"))
    q = stream.document_frequencies(s).writeStream.format("memory").queryName("dfs").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["term"], r["df"]) for r in spark.table("dfs").collect()} == {("x", 2), ("y", 1)}
    stream.append_postings(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


@pytest.mark.parametrize("name", list(experiments.PRESETS))
def test_presets(spark, name):
    r = run_of(spark, [A, B, {"a": 1, "c": 5}])
    levels = spark.createDataFrame([("q", "a")], "qid string, level string")
    qrels = spark.createDataFrame([("q", "c", 1)], "qid string, docid string, rel int")
    c = experiments.PRESETS[name]
    assert len(c.queries) == len(c.lists) and experiments.fuse(r, c, levels, qrels).count() == len({"none": A}.get(c.fusion, {**A, **B}))


def test_lists_go_by_their_place(spark):
    """Lists 0 and 2 of three: list 2 counts, list 1 doesn't."""
    r = run_of(spark, [A, {"only1": 9, "a": 1}, {"only2": 5, "a": 1}])
    levels = spark.createDataFrame([("q", "a")], "qid string, level string")
    qrels = spark.createDataFrame([("q", "only2", 1)], "qid string, docid string, rel int")
    for c in (experiments.PRESETS["two_lists_late"], experiments.Config([0, 2], "linear_weighted_score", weights=[0.5]), experiments.Config([2, 0], "linear_combination", weights=[1.0, 0.5])):
        got = scores(experiments.fuse(r, c, levels, qrels))
        assert set(got) == {"a", "b", "only2"}
    assert max(got, key=got.get) == "only2"


def test_listwise_keeps_every_passage(spark):
    rows = [(1, "q", i, f"{'x' * i}", 100.0 - i, i) for i in range(1, 36)]
    run = spark.createDataFrame(rows, "qid long, query string, docid long, contents string, score double, rank int")
    longest = lambda q, c: [i + 1 for i in sorted(range(len(c)), key=lambda i: -len(c[i]))]
    got = [r["docid"] for r in rerank.listwise(run, longest, 20, 10, 20).orderBy("rank").collect()]
    assert got == [*range(20, 0, -1), *range(21, 36)]
    # windows 30-50, 20-40, 10-30, 0-20 of a head of 50, of which 35 are there
    want = list(range(1, 36))
    for a, z in ((30, 50), (20, 40), (10, 30), (0, 20)):
        want[a:z] = sorted(want[a:z], reverse=True)
    found = rerank.listwise(run, longest, 20, 10, 50).orderBy("rank").collect()
    assert [r["docid"] for r in found] == want and [r["score"] for r in found] == [100.0 - i for i in range(1, 36)]
    assert rerank.window_starts(50, 20, 10) == [(30, 50), (20, 40), (10, 30), (0, 20)]


def test_question_words(spark):
    for words, end in (("which one", "?"), ("whose is it", "?"), ("should we go", "."), ("Whatever else", "?"), ("tell me", ".")):
        assert one(spark, text.as_sentence(F.lit(words)))[-1] == end


def test_ragged_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0, 1.0, 2.0]), (4, None), (5, [1.0, None]), (6, [0.5, 0.5])], "docid long, embedding array<double>")
    q = v.filter("docid = 1").withColumnRenamed("docid", "qid")
    assert {(r["docid"], r["score"]) for r in vectors.dense(q, v).collect()} == {(1, 1.0), (6, 0.5)}
    three = v.filter("docid in (1, 6)").withColumnRenamed("docid", "qid")
    assert vectors.dense(three, v, query_block=1).count() == 4
    with pytest.raises(ValueError):
        vectors.dense(v.filter("docid < 3").withColumnRenamed("docid", "qid"), v)


def test_jsonl_to_tsv_quotes_as_csv_writers_do(spark):
    import csv
    import io

    rows = [("1", "plain"), ("2", 'say "hi"'), ("3", "a\tb"), ("4", "a\nb\r\nc"), ("5", ""), ("6", " é ")]
    got = passages.jsonl_to_tsv(passages.to_jsonl(spark.createDataFrame(rows, "docid string, contents string"))).collect()
    for (i, t), r in zip(rows, got):
        csv.writer(out := io.StringIO(newline=""), delimiter="\t").writerow([i, t, f"http://example.com/{i}"])
        assert r["value"] + "\r\n" == out.getvalue()
