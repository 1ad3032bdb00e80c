"""Positions, segments of impacts, listwise rounds, fine weight grids, against plain versions."""

import glob
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import impacts, lexical, positions, rerank, tuning, vectors
from rankloom.sources import passages, trec, turns


@pytest.fixture(scope="module")
def words(spark, tmp_path_factory):
    r = random.Random(4)
    rows = [(i, [r.choice("abcd") for _ in range(r.randrange(60))]) for i in range(40)] + [(90, ["a"] * 3000), (91, [])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "docid long, contents string")
    return dict(rows), lexical.write_index(lexical.term_lists(docs, "docid", "contents"), str(tmp_path_factory.mktemp("pos") / "i"), positions=True, folders=4, buckets=4)


QUERIES = ["ab", "aab", "abca", "aa", "a", "aaaa", "dcba"]


@pytest.mark.parametrize("width", [None, 1, 3, 10])
def test_phrases_and_windows(spark, words, width):
    rows, index = words
    q = spark.createDataFrame([(i, list(x)) for i, x in enumerate(QUERIES)] + [(99, []), (98, ["zzz", "a"])], "qid int, words array<string>")
    want = {}
    for i, terms in enumerate(QUERIES):
        for docid, w in rows.items():
            if width is None:
                tf = sum(w[p : p + len(terms)] == list(terms) for p in range(len(w)))
            else:
                live = [p for p, x in enumerate(w) if x == terms[-1]]
                for t in terms[-2::-1]:
                    after = set(live)
                    live = [p for p, x in enumerate(w) if x == t and any(p + k in after for k in range(1, width + 1))]
                tf = len(live)
            if tf:
                want[i, docid] = tf
    assert {(r["qid"], r["docid"]): r["tf"] for r in positions.matches(q, index, ["qid"], width).collect()} == want
    top = positions.topk(q, index, ["qid"], 3, width).collect()
    assert all(r["rank"] <= 3 and want[r["qid"], r["docid"]] == r["tf"] for r in top)


def test_positions_meet_without_an_exchange(spark, words):
    q = spark.createDataFrame([(1, ["a", "b"])], "qid int, words array<string>")
    plan = positions.matches(q, words[1], ["qid"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    with pytest.raises(ValueError):
        positions.matches(q, lexical.Index.of(lexical.term_lists(spark.createDataFrame([(1, "a")], "docid long, contents string"), "docid", "contents")), ["qid"])


def scores(rows, query):
    out = {}
    for dim, docid, v in rows:
        out[docid] = out.get(docid, 0.0) + query.get(dim, 0.0) * round(v * 1000) / 1000
    return {d: round(s, 6) for d, s in out.items() if s > 1e-9}


def test_segments(spark, tmp_path):
    r = random.Random(5)
    rows = [(dim, docid, r.uniform(-0.2, 2)) for docid in range(60) for dim in range(20) if r.random() < 0.3] + [(1, 7000, 0.0001)]
    part = lambda k: spark.createDataFrame([x for x in rows if x[1] % 3 == k], "dim int, docid long, value double")
    path = str(tmp_path / "impacts")
    query = {1: 1.0, 3: 0.5, 19: 2.0, 400: 1.0}
    q = spark.createDataFrame([(0, d, v) for d, v in query.items()] + [(1, 77, 1.0)], "qid int, dim int, q double")
    find = lambda k=1000: {x["docid"]: x["score"] for x in impacts.search(q, path, k).collect()}
    assert find() == {} and impacts.segments(spark, path) == []
    for k in range(3):
        impacts.append(part(k), path, buckets=4)
        assert find() == pytest.approx(scores([x for x in rows if x[1] % 3 <= k], query), abs=2e-6)
    assert impacts.segments(spark, path) == ["segment-0-0", "segment-1-1", "segment-2-2"]
    best = sorted(scores(rows, query).items(), key=lambda x: (-x[1], x[0]))[:4]
    assert find(4) == pytest.approx(dict(best), abs=2e-6)
    with pytest.raises(ValueError, match="some of these passages"):
        impacts.append(part(1).limit(3), path)
    # a segment that wasn't written to its end doesn't count, nor one that a merged one holds
    os.makedirs(f"{path}/segment-3-3/postings")
    assert len(impacts.segments(spark, path)) == 3
    impacts.merge(spark, path, 4)
    assert impacts.segments(spark, path) == ["segment-0-2"] and find() == pytest.approx(scores(rows, query), abs=2e-6)
    impacts.append(spark.createDataFrame([(1, 10**6, 1.0)], "dim int, docid long, value double"), path)
    assert impacts.segments(spark, path) == ["segment-0-2", "segment-3-3"] and find()[10**6] == 1.0
    dims = {x["dim"]: x for x in spark.read.parquet(f"{path}/segment-0-2/dims").collect()}
    assert dims["1"]["most"] == max(round(v * 1000) for d, _, v in rows if d == 1)


def heads(spark):
    r = random.Random(6)
    rows = [(f"q{q}", f"text {q}", f"d{i}", "x" * r.randrange(1, 90), float(100 - i), i + 1) for q in range(5) for i in range(30 if q else 7)]
    return spark.createDataFrame(rows, "qid string, query string, docid string, contents string, score double, rank int")


def by_length(asked, folder):
    def permute(queries, contents):
        for q in queries:
            open(f"{folder}/{q.replace(' ', '-')}-{random.getrandbits(60)}", "w").close()
        if os.path.exists(f"{folder}/broken") and len(glob.glob(f"{folder}/text*")) > 12:
            raise RuntimeError("lost")
        return [[i + 1 for i in sorted(range(len(c)), key=lambda i: (-len(c[i]), i))] for c in contents]

    return permute


def test_rounds_are_asked_once(spark, tmp_path):
    run, calls, folder = heads(spark), str(tmp_path / "calls"), str(tmp_path / "answers")
    os.makedirs(calls)
    plain = rerank.listwise(run, lambda q, c: [i + 1 for i in sorted(range(len(c)), key=lambda i: (-len(c[i]), i))], 8, 4, 20)
    want = sorted(map(tuple, plain.collect()))
    # the model dies in a later round
    open(f"{calls}/broken", "w").close()
    with pytest.raises(Exception, match="lost"):
        rerank.listwise_rounds(run, by_length(run, calls), folder, 8, 4, 20).collect()
    whole = [d for d in os.listdir(folder) if os.path.exists(f"{folder}/{d}/_SUCCESS")]
    assert 0 < len(whole) < 4
    os.remove(f"{calls}/broken")
    before = len(glob.glob(f"{calls}/text*"))
    got = rerank.listwise_rounds(run, by_length(run, calls), folder, 8, 4, 20)
    assert sorted(map(tuple, got.collect())) == want
    asked = len(glob.glob(f"{calls}/text*")) - before
    # four windows; the query of seven passages has prompts in the two windows that reach it
    prompts = {"round-12-20": 4, "round-8-16": 4, "round-4-12": 5, "round-0-8": 5}
    assert asked == sum(n for d, n in prompts.items() if d not in whole)
    before = len(glob.glob(f"{calls}/text*"))
    rerank.listwise_rounds(run, by_length(run, calls), folder, 8, 4, 20).collect()
    assert len(glob.glob(f"{calls}/text*")) == before


def test_tuning_against_plain_sums(spark):
    r = random.Random(7)
    docs = [f"d{i:02d}" for i in range(25)]
    runs = [(l, q, d, round(r.random(), 2), 0) for l in range(3) for q in range(4) for d in r.sample(docs, 15)]
    qrels = [(q, d, r.choice([-1, 0, 0, 1, 2])) for q in range(3) for d in r.sample(docs, 12)] + [(9, "d00", 1)]
    trials = tuning.grid(3, 7)
    groups = [(q, "x" if q < 2 else "y") for q in range(4)]
    frames = spark.createDataFrame(runs, "list_id int, qid int, docid string, score double, rank int"), spark.createDataFrame(qrels, "qid int, docid string, rel int"), spark.createDataFrame(groups, "qid int, grp string")
    terms = ("mrr", "ndcg@3", "recall@10", "precision@5")
    got = {(x["grp"], x["trial"]): x["objective"] for x in tuning.supervised(*frames, 3, trials, terms).collect()}
    rel = {(q, d): v for q, d, v in qrels}
    for t, w in enumerate(trials):
        totals = {"x": [], "y": []}
        for q in range(3):
            s = {}
            for l, q2, d, v, _ in runs:
                if q2 == q:
                    s.setdefault(d, [0.0] * 3)[l] = v
            order = sorted(s, key=lambda d: (-np.floor(sum(a * b for a, b in zip(s[d], w)) * 1e6 + 0.5), d))
            g = [rel.get((q, d), 0) for d in order]
            ideal = sorted((max(v, 0) for (q2, _), v in rel.items() if q2 == q), reverse=True)
            dcg = lambda x: sum(max(v, 0) / np.log2(i + 2) for i, v in enumerate(x[:3]))
            n = sum(v > 0 for (q2, _), v in rel.items() if q2 == q)
            first = next((i for i, v in enumerate(g) if v > 0), None)
            value = (0 if first is None else 1 / (first + 1)) + (dcg(g) / dcg(ideal) if dcg(ideal) else 0) + (sum(v > 0 for v in g[:10]) / n if n else 0) + sum(v > 0 for v in g[:5]) / 5
            totals["x" if q < 2 else "y"].append(value)
        for grp in "xy":
            assert got[grp, t] == pytest.approx(sum(totals[grp]) / len(totals[grp]), abs=2e-6)
    assert len(got) == 2 * len(trials)


def test_readers_and_lengths(spark, tmp_path):
    """Flat turns there and back, plain lines, and lengths against their limits."""
    from rankloom.functions import text

    lines = spark.createDataFrame([("p1\ta b\tc",), ("p2",), ("",)], "value string")
    assert [tuple(r) for r in passages.plain_tsv(lines).collect()] == [("p1", "a b"), ("p2", ""), ("", "")]
    run = spark.createDataFrame([("q1 Q0 d2 1 3.5 t",), ("q1 Q0 d1 2 3.5 t",), ("short line",)], "value string")
    assert [(r["docid"], r["rank"]) for r in trec.parse_run(run).orderBy("rank").collect()] == [("d1", 1), ("d2", 2)]
    assert [(r["docid"], r["rank"]) for r in trec.parse_run(run, ties_down=True).orderBy("rank").collect()] == [("d2", 1), ("d1", 2)]
    long = spark.createDataFrame([("a b c",), ("a b",), ("",)], "t string").select(text.shorter_than(F.col("t"), 3).alias("x"))
    assert [r["x"] for r in long.collect()] == [False, True, True]
    schema = turns.TURNS
    one = {"turn_id": "1-1", "reformulations": [("n", "old", []), ("m", "x", []), ("n", "new", [1])], "results": [("c", "BM25", None, None, "a", "b", None, {"map": 0.1}, "r"), ("c", "BM25", None, None, "a", "b", None, {"map": 0.2}, "s")]}
    fields = [f.split()[0] for f in ("turn_id", "conversation_id", "title", "current_utterance", "current_response", "oracle_utterance", "response_provenance", "context_utterances", "ptkb", "ptkb_provenance", "reformulations", "results")]
    t = spark.createDataFrame([tuple(one.get(f) for f in fields)], schema)
    turns.write_turns(t, str(tmp_path / "t"))
    turns.write_turns(t, str(tmp_path / "t"))
    (row,) = turns.read_turns(spark, str(tmp_path / "t")).collect()
    assert [(x["reformulation_name"], x["reformulated_query"]) for x in row["reformulations"]] == [("m", "x"), ("n", "new")]
    assert [x["metrics"]["map"] for x in row["results"]] == [0.2] and row["title"] is None
    places = spark.range(5).withColumnRenamed("id", "n")
    assert [[r["n"] for r in turns.sliced(places, "n", *x).collect()] for x in ((0, -1), (1, 3), (4, 9))] == [[0, 1, 2, 3, 4], [1, 2, 3], [4]]


def test_dense_in_blocks(spark, monkeypatch):
    """More queries than a pass broadcasts, odd sizes of blocks; no vector passes through the driver."""
    rng = np.random.default_rng(8)
    v, q = rng.normal(size=(50, 8)).round(1), rng.normal(size=(23, 8)).round(1)
    v[7] = v[3]
    frame = lambda x, key: spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], f"{key} long, embedding array<float>").repartition(3)
    vectors_, queries = frame(v, "docid").unionByName(spark.createDataFrame([(900, None), (901, [1.0]), (902, [None] * 8)], "docid long, embedding array<float>")), frame(q, "qid")
    scores = np.round(q.astype(np.float32).astype(float) @ v.astype(np.float32).astype(float).T, 6)
    want = {(i, int(d), n + 1) for i in range(23) for n, d in enumerate(np.lexsort((np.arange(50), -scores[i]))[:5])}
    collected = []
    monkeypatch.setattr(type(queries), "collect", lambda self, f=type(queries).collect: collected.append(self.columns) or f(self))
    for limit in (128 << 20, 400):
        monkeypatch.setattr(vectors, "QUERY_BYTES", limit)
        found = vectors.dense(queries, vectors_, 5, 7, 4)
        assert not any("embedding" in c for c in collected)
        assert {(r["qid"], r["docid"], r["rank"]) for r in found.collect()} == want
    assert vectors.dense(queries.limit(0), vectors_, 5).count() == 0
    with pytest.raises(ValueError):
        vectors.dense(vectors_.withColumnRenamed("docid", "qid"), vectors_)


def test_models_are_loaded_once_a_worker_and_texts_share_lengths(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        open(f"{folder}/load-{os.getpid()}-{random.getrandbits(60)}", "w").close()

        def encode(texts):
            n = [len(t.split()) for t in texts]
            with open(f"{folder}/pad-{random.getrandbits(60)}", "w") as f:
                f.write(str(len(n) * max(n) - sum(n)))
            return np.array([[x, len(t)] for x, t in zip(n, texts)], np.float32)

        return encode

    r = random.Random(9)
    texts = ["w " * r.choice([1, 2, 3, 60, 70]) for _ in range(400)] + [None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)

    def padding(budget):
        for f in glob.glob(f"{folder}/*"):
            os.remove(f)
        got = vectors.encoded(rows, "t", vectors.PerWorker(load), 32, budget).collect()
        assert all(x["embedding"] == [len((x["t"] or "").split()), len(x["t"] or "")] for x in got) and len(got) == 401
        loads = [f.split("-")[-2] for f in glob.glob(f"{folder}/load-*")]
        assert len(loads) == len(set(loads)) > 0
        return sum(int(open(f).read()) for f in glob.glob(f"{folder}/pad-*"))

    assert padding(1000) < 0.35 * padding(None)
    assert [len(x) for x in vectors.by_length([5, 1, 9, 30, 2], 10, 3)] == [1, 1, 2, 1] and vectors.by_length([], 10, 3) == []


def test_segments_are_searched_in_blocks(spark, tmp_path, monkeypatch):
    """No row for a query and passage is made; blocks and their cuts change nothing, with ties by docid over all blocks."""
    r, path = random.Random(8), str(tmp_path / "impacts")
    rows = [(f"d{dim}", docid, float(r.randrange(1, 4)), dim) for docid in range(400) for dim in range(200) if dim < 2 or r.random() < 0.05]
    rows += [("d0", docid, 2.0, 0) for docid in range(1000, 1300)]  # copies
    asked = [(q, f"d{dim}", float(r.randrange(1, 3)), dim) for q in range(30) for dim in (0, 1, *r.sample(range(2, 200), 5))] + [(99, "d0", 1.0, 0), (98, "d1", -1.0, 1)]
    impacts.append(spark.createDataFrame(rows, "dim string, docid long, value double, n int"), path, buckets=2)
    q = spark.createDataFrame(asked, "qid int, dim string, q double, n int")
    want = set()
    for qid in {x[0] for x in asked}:
        found = scores([(d, i, v) for d, i, v, _ in rows], {d: v for i, d, v, _ in asked if i == qid})
        want |= {(qid, docid, s) for docid, s in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:7]}
    for size in (2048, 5):
        monkeypatch.setattr(impacts, "PASSAGES", size)
        monkeypatch.setattr(impacts, "QUERIES", size)
        run = impacts.search(q, path, 7)
        assert {(x["qid"], x["docid"], x["score"]) for x in run.collect()} == want
        assert not re.search(r"Aggregate\(keys=\[qid#\w+, docid", run._jdf.queryExecution().executedPlan().toString())
    # queries in more passes than one
    monkeypatch.setattr(impacts, "QUERY_BYTES", 1000)
    assert {(x["qid"], x["docid"], x["score"]) for x in impacts.search(q, path, 7).collect()} == want
