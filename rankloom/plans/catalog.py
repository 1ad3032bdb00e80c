"""Queries over the driver's tables, each with the SQL that DuckDB runs for the same rows.

Roles: documents are passages, benchmark items queries, labels judgements (quality * (2 - toxic), for every item),
conversations turns, embeddings vectors. Each item has three queries: its whole text, its first and its last ten terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flattening, parsing, text
from ..operators import conversation, fusion, impacts, lexical, metrics, positions, rerank, tuning, vectors
from ..operators.ranking import normalized, ranked, settled
from ..sources import passages, sinks, tables, trec, turns
from ..sources.storage import kept, scratch_path, small
from . import experiments, generation, search

#: Passages a list in the short queries, and in those that end in _1000: the reference's depth.
DEPTH, FULL = 50, 1000
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- building blocks ----


def items(spark, d):
    return read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text", text.terms(F.col("text")).alias("words"))


def three_queries(spark, d):
    w = F.col("words")
    forms = F.array(*(F.struct(F.lit(i).alias("list_id"), x.alias("words")) for i, x in enumerate((w, text.first_terms(w, 10), text.last_terms(w, 10)))))
    return items(spark, d).select("qid", F.explode(forms).alias("x")).select("x.list_id", "qid", "x.words")


def index(spark, d):
    """The stored index of documents, written when the first query asks for it."""
    return lexical.index_once(read(spark, d, "documents"), "doc_id", "text")


def runs(spark, d, n=3, k=DEPTH):
    """Written, as what is made of runs reads them several times."""
    return kept(experiments.retrieve(three_queries(spark, d), index(spark, d), experiments.Config(list(range(n)), k=k)))


def unit_runs(spark, d, n=3, k=DEPTH):
    return normalized(runs(spark, d, n, k), "min-max", ["list_id", "qid"])


def one_run(spark, d, k=DEPTH):
    return runs(spark, d, 1, k).drop("list_id")


def qrels(spark, d):
    rel = read(spark, d, "labels").select(F.col("doc_id").alias("docid"), (F.col("quality") * (2 - F.col("toxic"))).cast("int").alias("rel"))
    return items(spark, d).select("qid").crossJoin(rel)


def level():
    return F.substring(F.lit("abc"), (F.pmod(F.col("qid"), F.lit(3)) + 1).cast("int"), F.lit(1))


def levels(spark, d):
    return items(spark, d).select("qid", level().alias("level"))


def vector_table(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("docid"), "embedding")


def vector_queries(spark, d):
    return vector_table(spark, d).filter("docid % 20 = 0").withColumnRenamed("docid", "qid")


def talk(spark, d):
    return read(spark, d, "conversations").withColumn("turn_id", F.concat_ws("-", "conv_id", "turn"))


W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
ITEMS = f"items AS (SELECT item_id AS qid, text, {W} AS words FROM benchmark)"
CORPUS = f"""lists AS (SELECT doc_id AS docid, coalesce({W}, []) AS words FROM documents),
lens AS (SELECT docid, len(words) AS dl FROM lists),
stats AS (SELECT count(*)::DOUBLE AS n, avg(dl)::DOUBLE AS avgdl FROM lens),
post AS (SELECT docid, term, count(*) AS tf FROM (SELECT docid, unnest(words) AS term FROM lists) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""
QUERY3 = f"""{ITEMS}, q3 AS (SELECT 0 AS list_id, qid, words FROM items UNION ALL SELECT 1, qid, words[1:10] FROM items
  UNION ALL SELECT 2, qid, words[greatest(len(words) - 9, 1):] FROM items),
qw AS (SELECT list_id, qid, term, count(*)::DOUBLE AS qtf FROM (SELECT list_id, qid, unnest(words) AS term FROM q3) GROUP BY ALL)"""


def bm25_sql(weights: str, prefix: str) -> str:
    return f"""{prefix}parts AS (SELECT list_id, qid, post.docid, term, tf, df, qtf * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf / (tf + 0.9e0 * (1 - 0.4e0 + 0.4e0 * dl / avgdl)) AS part
  FROM {weights} JOIN post USING (term) JOIN dfs USING (term) JOIN lens ON lens.docid = post.docid CROSS JOIN stats),
{prefix}runs AS (SELECT * FROM (SELECT list_id, qid, docid, score, row_number() OVER (PARTITION BY list_id, qid ORDER BY score DESC, docid)::INT AS rank
  FROM (SELECT list_id, qid, docid, round(sum(part), 6) AS score FROM {prefix}parts GROUP BY ALL)) WHERE rank <= {DEPTH})"""


BASE = f"{CORPUS}, {QUERY3}, {bm25_sql('qw', '')}"
UNIT = f"""{BASE}, unit AS (SELECT list_id, qid, docid, rank, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0) AS score
  FROM runs WINDOW w AS (PARTITION BY list_id, qid))"""
QRELS = "rel AS (SELECT doc_id AS docid, (quality * (2 - toxic))::INT AS rel FROM labels), qrels AS (SELECT qid, docid, rel FROM items CROSS JOIN rel)"
LEVELS = "levels AS (SELECT qid, substr('abc', (qid % 3 + 1)::INT, 1) AS level FROM items)"


def rank_sql(source: str, k: int | None = None, keys: str = "qid") -> str:
    out = f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, docid)::INT AS rank FROM ({source})"
    return f"SELECT * FROM ({out}) WHERE rank <= {k}" if k else out


# ---- index and retrieval ----


@query(f"WITH {CORPUS} SELECT (SELECT count(*) FROM lists) AS n_docs, sum(dl)::BIGINT AS n_tokens, (SELECT count(*) FROM dfs) AS n_terms, round(avg(dl), 6) AS avgdl FROM lens")
def tokenize_stats(spark, d):
    found = index(spark, d)
    return found.stats.select("n_docs", "n_tokens", settled(F.col("avgdl")).alias("avgdl")).crossJoin(found.terms.agg(F.count("*").alias("n_terms")))


@query(f"WITH {CORPUS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS max_tf FROM post GROUP BY term")
def postings_dist(spark, d):
    return index(spark, d).terms


@query(f"WITH {CORPUS} SELECT term, docid, tf, dl FROM post JOIN lens USING (docid)")
def index_postings(spark, d):
    return index(spark, d).postings.select("term", "docid", "tf", "dl")


@query(f"WITH {CORPUS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS max_tf, n::BIGINT AS n_docs, any_value((SELECT sum(dl) FROM lens))::BIGINT AS n_tokens FROM post CROSS JOIN stats GROUP BY term, n")
def index_write_read(spark, d):
    """A new index each time: written, read back, its terms beside the collection's size."""
    found = lexical.index_texts(read(spark, d, "documents"), "doc_id", "text", scratch_path(spark))
    return found.terms.crossJoin(F.broadcast(found.stats.select("n_docs", "n_tokens")))


@query(f"WITH {BASE} SELECT qid, docid, score, rank FROM runs WHERE list_id = 0")
def bm25_topk(spark, d, k=DEPTH):
    return one_run(spark, d, k)


@query(f"WITH {BASE} SELECT p.qid, p.docid, r.rank, term, tf, df, round(part, 6) AS part FROM parts p JOIN runs r USING (list_id, qid, docid) WHERE list_id = 0 AND r.rank <= 10")
def bm25_explain(spark, d):
    q = lexical.query_terms(items(spark, d), ["qid"])
    return lexical.bm25_explain(q, index(spark, d), ["qid"], 10)


RM3 = f"""{BASE}, top AS (SELECT qid, docid, score / sum(score) OVER (PARTITION BY qid) AS share FROM runs WHERE list_id = 0 AND rank <= 10),
model AS (SELECT qid, term, round(sum(share * tf / dl), 6) AS p FROM top JOIN post USING (docid) JOIN lens USING (docid) GROUP BY ALL),
pick AS (SELECT * FROM model QUALIFY row_number() OVER (PARTITION BY qid ORDER BY p DESC, term) <= 10),
rm AS (SELECT 0 AS list_id, qid, term, round(sum(v), 6) AS qtf FROM (
  SELECT qid, term, 0.5e0 * qtf / sum(qtf) OVER (PARTITION BY qid) AS v FROM qw WHERE list_id = 0
  UNION ALL SELECT qid, term, 0.5e0 * p / sum(p) OVER (PARTITION BY qid) FROM pick) GROUP BY ALL)"""


def feedback(spark, d, k=DEPTH):
    q, found = lexical.query_terms(items(spark, d), ["qid"]), index(spark, d)
    return lexical.feedback_terms(q, lexical.bm25(q, found, ["qid"], k), found, ["qid"])


@query(f"WITH {RM3} SELECT qid, term, qtf FROM rm")
def rm3_terms(spark, d):
    return feedback(spark, d)


@query(f"WITH {RM3}, {bm25_sql('rm', 'rm_')} SELECT qid, docid, score, rank FROM rm_runs")
def rm3_topk(spark, d, k=DEPTH):
    return lexical.bm25(kept(feedback(spark, d, k)), index(spark, d), ["qid"], k)


DOT = "list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"


@query("WITH s AS (" + rank_sql(f"SELECT q.vec_id AS qid, v.vec_id AS docid, round({DOT}, 6) AS score FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 20 = 0", 20) + ") SELECT * FROM s")
def dense_topk(spark, d):
    return vectors.dense(vector_queries(spark, d), vector_table(spark, d), 20)


@query("WITH s AS (" + rank_sql(f"SELECT q.vec_id AS qid, v.vec_id AS docid, round({DOT} / (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 6) AS score FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 20 = 0", 20) + ") SELECT * FROM s")
def cosine_topk(spark, d):
    unit = lambda t: t.withColumn("embedding", vectors.l2_normalized(F.col("embedding"), 0.0))
    return vectors.dense(unit(vector_queries(spark, d)), unit(vector_table(spark, d)), 20)


@query(f"WITH {CORPUS}, {QUERY3}, s AS (" + rank_sql("SELECT qid, docid, round(sum(qtf * tf), 6) AS score FROM qw JOIN post USING (term) WHERE list_id = 0 GROUP BY ALL HAVING sum(qtf * tf) > 0", 20) + ") SELECT * FROM s")
def sparse_dot_topk(spark, d):
    q = lexical.query_terms(items(spark, d), ["qid"]).select("qid", F.col("term").alias("dim"), F.col("qtf").alias("q"))
    rows = index(spark, d).postings.select(F.col("term").alias("dim"), "docid", F.col("tf").cast("double").alias("value"))
    return vectors.sparse(small(q), rows, 20)


@query("""WITH x AS (SELECT vec_id, u.d AS dim, u.t AS tok, ln(1 + greatest(embedding[u.t * 16 + u.d + 1]::DOUBLE, 0)) AS v FROM embeddings, (SELECT d, t FROM range(16) a(d), range(4) b(t)) u)
SELECT vec_id, dim::INT AS dim, round(max(v), 6) AS by_max, round(sum(v), 6) AS by_sum FROM x GROUP BY ALL""")
def splade_pool(spark, d):
    rows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, F.lit(16)))
    t = read(spark, d, "embeddings").select("vec_id", rows.alias("r"))
    both = t.select("vec_id", F.posexplode(F.arrays_zip(vectors.pooled(F.col("r"), "max").alias("m"), vectors.pooled(F.col("r"), "sum").alias("s"))).alias("dim", "x"))
    return both.select("vec_id", "dim", settled(F.col("x.m")).alias("by_max"), settled(F.col("x.s")).alias("by_sum"))


@query("SELECT u.d::INT AS dim, vec_id AS docid, embedding[u.d + 1]::DOUBLE AS value FROM embeddings, range(64) u(d) WHERE embedding[u.d + 1] <> 0")
def inverted_vectors(spark, d):
    return vectors.inverted(vector_table(spark, d))


@query(f"WITH {ITEMS} SELECT DISTINCT qid, unnest(words) AS dim, 1.0::DOUBLE AS q FROM items")
def bow_query(spark, d):
    return items(spark, d).select("qid", F.explode(vectors.bag_of_words(F.col("words"))).alias("x")).select("qid", "x.dim", "x.q")


@query(f"""WITH {BASE}, e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY qid)) AS e FROM runs WHERE list_id = 0),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY qid) AS prob FROM e),
c AS (SELECT *, round(coalesce(sum(prob) OVER (PARTITION BY qid ORDER BY score DESC, docid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS before FROM p)
SELECT qid, docid, score, rank, round(prob, 6) AS prob FROM c WHERE before <= 0.9e0""")
def top_p(spark, d, k=DEPTH):
    return vectors.nucleus(one_run(spark, d, k), ["qid"], 0.9)


def positional(spark, d):
    """The stored index of documents with positions."""
    return lexical.index_once(read(spark, d, "documents"), "doc_id", "text", positions=True)


def near_sql(least: int, terms: str, second: str, third: str) -> str:
    """terms: the three of an item; second and third: where their places b and c may be, seen from the places a and b."""
    return f"""WITH {CORPUS}, {ITEMS}, occ AS (SELECT docid, unnest(words) AS term, unnest(range(1, len(words) + 1)) AS pos FROM lists), p AS (SELECT qid, {terms} AS p FROM items WHERE len(words) >= {least}),
m AS (SELECT qid, a.docid, count(DISTINCT a.pos) AS tf FROM p JOIN occ a ON a.term = p[1] JOIN occ b ON b.docid = a.docid AND b.term = p[2] AND {second} JOIN occ c ON c.docid = b.docid AND c.term = p[3] AND {third} GROUP BY ALL),
f AS (SELECT *, count(*) OVER (PARTITION BY qid) AS df FROM m JOIN lens USING (docid)),
s AS (""" + rank_sql("SELECT qid, docid, tf::BIGINT AS tf, round(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf / (tf + 0.9e0 * (1 - 0.4e0 + 0.4e0 * dl / avgdl)), 6) AS score FROM f CROSS JOIN stats", 20) + ") SELECT * FROM s"


@query(near_sql(3, "words[1:3]", "b.pos = a.pos + 1", "c.pos = b.pos + 1"))
def phrase_topk(spark, d):
    """Passages with an item's first three terms in a row."""
    q = items(spark, d).filter(F.size("words") >= 3).select("qid", text.first_terms(F.col("words"), 3).alias("words"))
    return positions.topk(q, positional(spark, d), ["qid"], 20)


@query(near_sql(5, "[words[1], words[3], words[5]]", "b.pos > a.pos AND b.pos <= a.pos + 6", "c.pos > b.pos AND c.pos <= b.pos + 6"))
def window_topk(spark, d):
    """Passages with an item's first, third and fifth term in this order, each at most six places after the one before."""
    w = F.col("words")
    q = items(spark, d).filter(F.size("words") >= 5).select("qid", F.array(w[0], w[2], w[4]).alias("words"))
    return positions.topk(q, positional(spark, d), ["qid"], 20, 6)


@query("SELECT u.d::VARCHAR AS dim, count(*) AS df, max(round(embedding[u.d + 1]::DOUBLE * 1000))::INT AS most FROM embeddings, range(64) u(d) WHERE round(embedding[u.d + 1]::DOUBLE * 1000) <> 0 GROUP BY u.d")
def sparse_index_write_read(spark, d):
    """Weights written in two segments, merged, and their dimensions read back."""
    path, rows = scratch_path(spark), vectors.inverted(vector_table(spark, d))
    for i in (0, 1):
        impacts.append(rows.filter(F.col("docid") % 2 == i), path)
    impacts.merge(spark, path)
    (name,) = impacts.segments(spark, path)
    return tables.read_table(spark, f"{path}/{name}/postings").groupBy("dim").agg(F.count("*").alias("df"), F.max("impact").alias("most"))


@query("WITH s AS (" + rank_sql("SELECT q.vec_id AS qid, v.vec_id AS docid, round(list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * round(v.embedding[i]::DOUBLE * 1000) / 1000)), 6) AS score FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 20 = 0", 20) + ") SELECT * FROM s WHERE score > 0")
def sparse_index_search(spark, d):
    """Vectors as weights on 64 dimensions: two segments, searched together."""
    path, rows = scratch_path(spark), vectors.inverted(vector_table(spark, d))
    for i in (0, 1):
        impacts.append(rows.filter(F.col("docid") % 2 == i), path)
    q = vectors.inverted(vector_table(spark, d).filter("docid % 20 = 0")).select(F.col("docid").alias("qid"), "dim", F.col("value").alias("q"))
    return impacts.search(q, path, 20)


# ---- fusion ----


@query(f"WITH {UNIT} SELECT list_id, qid, docid, rank, round(score, 6) AS score FROM unit")
def norm_minmax(spark, d, k=DEPTH):
    return unit_runs(spark, d, k=k).select("list_id", "qid", "docid", "rank", settled(F.col("score")).alias("score"))


@query(f"WITH {BASE} SELECT list_id, qid, docid, rank, round(coalesce(score / nullif(max(score) OVER (PARTITION BY list_id, qid), 0), 0), 6) AS score FROM runs")
def norm_max(spark, d, k=DEPTH):
    return normalized(runs(spark, d, k=k), "max", ["list_id", "qid"]).select("list_id", "qid", "docid", "rank", settled(F.col("score")).alias("score"))


def pair_sql(a: str, b: str, alpha: float, k: int = DEPTH) -> str:
    return rank_sql(f"""SELECT qid, docid, round(coalesce(s0, min(s0) OVER (PARTITION BY qid), 0) + {alpha}::DOUBLE * coalesce(s1, min(s1) OVER (PARTITION BY qid), 0), 6) AS score
  FROM (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.docid, b.docid) AS docid, a.score AS s0, b.score AS s1 FROM {a} a FULL JOIN {b} b ON a.qid = b.qid AND a.docid = b.docid)
  WHERE qid IN (SELECT qid FROM {a})""", k)


THREE = ", ".join(f"l{i} AS (SELECT qid, docid, score, rank FROM unit WHERE list_id = {i})" for i in range(3))


@query(f"WITH {UNIT}, {THREE}, f AS ({pair_sql('l0', 'l1', 0.1)}) SELECT * FROM f")
def fuse_linear_weighted(spark, d, k=DEPTH):
    r = unit_runs(spark, d, 2, k)
    return fusion.linear_weighted(r.filter("list_id = 0"), r.filter("list_id = 1"), 0.1, k)


@query(f"WITH {UNIT}, {THREE}, f AS ({pair_sql('l0', 'l1', 0.1)}), g AS ({pair_sql('f', 'l2', 0.4)}) SELECT * FROM g")
def fuse_linear_fold3(spark, d, k=DEPTH):
    return experiments.fuse(runs(spark, d, k=k), experiments.Config([0, 1, 2], "linear_weighted_score", weights=[0.1, 0.4], k=k))


def combination_sql(weights: str, runs_: str = "unit") -> str:
    """weights: a table (qid, list_id, weight)."""
    return rank_sql(f"""SELECT m.qid, m.docid, round(sum(weight * coalesce(u.score, low.least)), 6) AS score
  FROM (SELECT DISTINCT qid, docid FROM {runs_} WHERE qid IN (SELECT qid FROM {runs_} WHERE list_id = 0)) m JOIN (SELECT qid, list_id, min(score) AS least FROM {runs_} GROUP BY ALL) low ON low.qid = m.qid
  JOIN {weights} w ON w.qid = m.qid AND w.list_id = low.list_id LEFT JOIN {runs_} u ON u.qid = m.qid AND u.docid = m.docid AND u.list_id = low.list_id GROUP BY ALL""", DEPTH)


@query(f"WITH {UNIT}, w AS (SELECT qid, l.list_id, l.weight FROM items, (VALUES (0, 1.0::DOUBLE), (1, 0.5::DOUBLE), (2, 0.25::DOUBLE)) l(list_id, weight)), f AS ({combination_sql('w')}) SELECT * FROM f")
def fuse_linear_comb(spark, d, k=DEPTH):
    r = unit_runs(spark, d, k=k)
    return fusion.linear_combination(r, fusion.same_weights(r, [1.0, 0.5, 0.25]), k)


@query(f"""WITH {UNIT}, {LEVELS}, w AS (SELECT qid, 0 AS list_id, 1.0::DOUBLE AS weight FROM levels UNION ALL SELECT qid, 1, 0.1::DOUBLE FROM levels
  UNION ALL SELECT qid, 2, CASE level WHEN 'a' THEN 0.4::DOUBLE WHEN 'b' THEN 0.5::DOUBLE ELSE 0.6::DOUBLE END FROM levels), f AS ({combination_sql('w')}) SELECT * FROM f""")
def fuse_per_level(spark, d, k=DEPTH):
    return experiments.fuse(runs(spark, d, k=k), experiments.Config([0, 1, 2], "per_query", k=k), levels(spark, d))


@query(f"""WITH {ITEMS}, {LEVELS}, n AS (SELECT qid, level, instr('abcd', level) AS p FROM levels)
SELECT qid, level, round(0.25e0 * (p - 1), 6) AS w1, round(0.1875e0 * p, 6) AS w2, CASE level WHEN 'a' THEN 0.4::DOUBLE WHEN 'b' THEN 0.5::DOUBLE ELSE 0.6::DOUBLE END AS w3,
  round(CASE WHEN p = 1 THEN NULL ELSE (1 - 0.25e0 * (p - 1)) / (0.25e0 * (p - 1)) END, 6) AS third FROM n""")
def level_weighting(spark, d):
    x, one = F.col("level"), F.lit(1.0)
    c = fusion.level_weight(x, 1)
    third = fusion.three_weights((F.lit(0.6), F.lit(0.4)), (c, one - c))
    return levels(spark, d).select("qid", "level", settled(c).alias("w1"), settled(fusion.level_weight(x, 2)).alias("w2"), fusion.level_weight(x, 3).alias("w3"), settled(third[2]).alias("third"))


@query(f"WITH {BASE}, f AS (" + rank_sql("SELECT qid, docid, round(sum(1.0e0 / (60 + rank)), 6) AS score FROM runs GROUP BY ALL", DEPTH) + ") SELECT * FROM f")
def fuse_rrf(spark, d, k=DEPTH):
    return fusion.reciprocal_rank(runs(spark, d, k=k), k)


@query(f"WITH {BASE}, f AS (" + rank_sql("SELECT qid, docid, score, list_id AS first_list, rank AS first_rank FROM runs QUALIFY row_number() OVER (PARTITION BY qid, docid ORDER BY list_id, rank) = 1").replace("AS rank FROM", "AS new_rank FROM") + ") SELECT qid, docid, score, first_list, first_rank, new_rank AS rank FROM f")
def fuse_concat(spark, d, k=DEPTH):
    return fusion.concatenation(runs(spark, d, k=k))


def robin_sql(k: int) -> str:
    return f"""WITH {BASE}, depth AS (SELECT qid, min(n) AS n, count(*) AS lists FROM (SELECT qid, list_id, max(rank) AS n FROM runs GROUP BY ALL) GROUP BY qid),
near AS (SELECT r.*, CASE list_id WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS turn FROM runs r JOIN depth d ON d.qid = r.qid WHERE lists = 3 AND rank <= least(n, {k})),
once AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY qid, docid ORDER BY rank, turn) = 1),
place AS (SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY rank, turn) AS place, count(*) OVER (PARTITION BY qid) AS n FROM once),
s AS (SELECT qid, docid, CASE WHEN n >= {k} THEN round(1.0e0 / place, 6) ELSE round(score, 6) END AS score FROM place WHERE n < {k} OR place <= {k}),
f AS ({rank_sql('SELECT * FROM s')}) SELECT * FROM f"""


@query(robin_sql(30))
def fuse_round_robin(spark, d):
    return fusion.round_robin(runs(spark, d), 3, 30)


@query(robin_sql(1000))
def fuse_round_robin_short(spark, d, k=DEPTH):
    return fusion.round_robin(runs(spark, d, k=k), 3, 1000)


# ---- tuning ----

STEPS = 5
TRIALS = f"""trials AS (SELECT (row_number() OVER (ORDER BY a, b) - 1)::INT AS trial, [a / {STEPS}.0e0, b / {STEPS}.0e0, ({STEPS} - a - b) / {STEPS}.0e0] AS w FROM range({STEPS + 1}) x(a), range({STEPS + 1}) y(b) WHERE a + b <= {STEPS})"""
PAIR_TRIALS = f"pair_trials AS (SELECT a::INT AS trial, [a / {STEPS}.0e0, ({STEPS} - a) / {STEPS}.0e0] AS w FROM range({STEPS + 1}) x(a))"


@query(f"WITH {TRIALS} SELECT trial, unnest([0, 1, 2]) AS list_id, unnest(w) AS weight FROM trials")
def grid_weights(spark, d):
    t = spark.range(1).select(F.explode(tuning.trial_rows(tuning.grid(3, STEPS))).alias("t"))
    return t.select("t.trial", F.posexplode("t.w").alias("list_id", "weight"))


def cells_sql(source: str, n: int, name: str = "cells") -> str:
    return f"{name} AS (SELECT qid, docid, [" + ", ".join(f"coalesce(max(score) FILTER (list_id = {i}), 0)" for i in range(n)) + f"] AS s FROM {source} GROUP BY ALL)"


def objective_sql(cells: str, trials: str, n: int, groups: str, prefix: str = "") -> str:
    total = " + ".join(f"s[{i + 1}] * w[{i + 1}]" for i in range(n))
    return f"""{prefix}fused AS ({rank_sql(f'SELECT trial, w, qid, docid, round({total}, 6) AS score FROM {cells} CROSS JOIN {trials}', None, 'trial, qid')}),
{prefix}q AS (SELECT f.trial, any_value(w) AS w, f.qid, coalesce(1.0e0 / min(CASE WHEN rel > 0 THEN f.rank END), 0) AS rr,
   sum(CASE WHEN f.rank <= 3 THEN coalesce(rel, 0) / log2(f.rank + 1.0e0) ELSE 0 END) AS dcg,
   sum(CASE WHEN f.rank <= 10 AND rel > 0 THEN 1.0e0 ELSE 0 END) AS h10, sum(CASE WHEN f.rank <= 100 AND rel > 0 THEN 1.0e0 ELSE 0 END) AS h100
   FROM {prefix}fused f LEFT JOIN qrels r ON r.qid = f.qid AND r.docid = f.docid GROUP BY f.trial, f.qid),
{prefix}obj AS (SELECT grp, trial, any_value(w) AS w, round(avg(rr + coalesce(dcg / nullif(idcg_3, 0), 0) + coalesce(h10 / nullif(num_rel, 0), 0) + coalesce(h100 / nullif(num_rel, 0), 0)), 6) AS objective
   FROM {prefix}q JOIN ideal USING (qid) JOIN {groups} USING (qid) GROUP BY grp, trial),
{prefix}best AS (SELECT * FROM {prefix}obj QUALIFY row_number() OVER (PARTITION BY grp ORDER BY objective DESC, trial) = 1)"""


IDEAL = """ideal AS (SELECT qid, count(*) FILTER (rel > 0) AS num_rel, sum(rel / log2(pos + 1.0e0)) AS idcg, """ + ", ".join(f"sum(rel / log2(pos + 1.0e0)) FILTER (pos <= {c}) AS idcg_{c}" for c in (1, 3, 5, 10)) + """
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, docid) AS pos FROM qrels) GROUP BY qid)"""
GROUPS = "groups AS (SELECT qid, level AS grp FROM levels), everyone AS (SELECT qid, 'all' AS grp FROM items)"
TUNE = f"{UNIT}, {QRELS}, {IDEAL}, {LEVELS}, {GROUPS}, {TRIALS}, {PAIR_TRIALS}, {cells_sql('unit', 3)}"


@query(f"WITH {TUNE}, {objective_sql('cells', 'trials', 3, 'everyone')} SELECT grp, trial, w, objective FROM obj")
def tune_global(spark, d, k=DEPTH):
    everyone = items(spark, d).select("qid", F.lit("all").alias("grp"))
    return tuning.supervised(unit_runs(spark, d, k=k), qrels(spark, d), everyone, 3, tuning.grid(3, STEPS))


@query(f"WITH {TUNE}, {objective_sql('cells', 'trials', 3, 'groups')} SELECT grp, trial, w, objective FROM best")
def tune_by_level(spark, d, k=DEPTH):
    groups = levels(spark, d).withColumnRenamed("level", "grp")
    return tuning.best(tuning.supervised(unit_runs(spark, d, k=k), qrels(spark, d), groups, 3, tuning.grid(3, STEPS)), ["grp"])


@query(f"""WITH {TUNE}, pair AS (SELECT * FROM unit WHERE list_id < 2), {cells_sql('pair', 2, 'pair_cells')}, {objective_sql('pair_cells', 'pair_trials', 2, 'everyone', 'a_')},
aw AS (SELECT qid, 0 AS list_id, w[1] AS weight FROM items CROSS JOIN a_best UNION ALL SELECT qid, 1, w[2] FROM items CROSS JOIN a_best),
af AS ({combination_sql('aw', 'pair')}),
two AS (SELECT 0 AS list_id, qid, docid, score, rank FROM af UNION ALL SELECT 1, qid, docid, score, rank FROM unit WHERE list_id = 2),
{cells_sql('two', 2, 'two_cells')}, {objective_sql('two_cells', 'pair_trials', 2, 'groups', 'b_')},
bw AS (SELECT qid, 0 AS list_id, w[1] AS weight FROM groups JOIN b_best USING (grp) UNION ALL SELECT qid, 1, w[2] FROM groups JOIN b_best USING (grp)),
f AS ({combination_sql('bw', 'two')}) SELECT * FROM f""")
def tune_2plus1(spark, d, k=DEPTH):
    return experiments.fuse(runs(spark, d, k=k), experiments.Config([0, 1, 2], "per_query", tuning="2+1", steps=STEPS, k=k), levels(spark, d), qrels(spark, d))


@query(f"""WITH {TUNE}, low AS (SELECT qid, list_id, min(score) AS least FROM unit GROUP BY ALL),
lows AS (SELECT qid, [""" + ", ".join(f"coalesce(max(least) FILTER (list_id = {i}), 0)" for i in range(3)) + """] AS l FROM low GROUP BY qid),
full_cells AS (SELECT c.qid, c.docid, [""" + ", ".join(f"coalesce(max(score) FILTER (list_id = {i}), any_value(l[{i + 1}]))" for i in range(3)) + f"""] AS s FROM unit c JOIN lows USING (qid) GROUP BY c.qid, c.docid),
r AS ({rank_sql('SELECT trial, w, qid, docid, round(s[1] * w[1] + s[2] * w[2] + s[3] * w[3], 6) AS score FROM full_cells CROSS JOIN trials', 100, 'trial, qid')}),
obj AS (SELECT grp, trial, any_value(w) AS w, round(sum(score), 6) AS objective FROM r JOIN groups USING (qid) GROUP BY grp, trial)
SELECT grp, trial, w, objective FROM obj QUALIFY row_number() OVER (PARTITION BY grp ORDER BY objective DESC, trial) = 1""")
def tune_retrieval_score(spark, d, k=DEPTH):
    groups = levels(spark, d).withColumnRenamed("level", "grp")
    return tuning.best(tuning.by_score(unit_runs(spark, d, k=k), groups, 3, tuning.grid(3, STEPS)), ["grp"])


#: The step of the reference's setting: 5151 trials of three lists.
FINE = 100


def finely(sql: str) -> str:
    """SQL over the coarse grid as one over the fine grid."""
    fine = TRIALS.replace(f"{STEPS}.0e0", f"{FINE}.0e0").replace(f"range({STEPS + 1})", f"range({FINE + 1})").replace(f"({STEPS} - a - b)", f"({FINE} - a - b)").replace(f"a + b <= {STEPS})", f"a + b <= {FINE})")
    pair = PAIR_TRIALS.replace(f"{STEPS}.0e0", f"{FINE}.0e0").replace(f"range({STEPS + 1})", f"range({FINE + 1})").replace(f"({STEPS} - a)", f"({FINE} - a)")
    return sql.replace(TRIALS, fine).replace(PAIR_TRIALS, pair)


@query(finely(SQL["tune_global"]))
def tune_global_fine(spark, d, k=DEPTH):
    """All 5151 weights of three lists in steps of 0.01."""
    everyone = items(spark, d).select("qid", F.lit("all").alias("grp"))
    return tuning.supervised(unit_runs(spark, d, k=k), qrels(spark, d), everyone, 3, tuning.grid(3, FINE))


@query(finely(SQL["tune_by_level"]))
def tune_by_level_fine(spark, d, k=DEPTH):
    groups = levels(spark, d).withColumnRenamed("level", "grp")
    return tuning.best(tuning.supervised(unit_runs(spark, d, k=k), qrels(spark, d), groups, 3, tuning.grid(3, FINE)), ["grp"])


@query(finely(SQL["tune_retrieval_score"]))
def tune_retrieval_score_fine(spark, d, k=DEPTH):
    groups = levels(spark, d).withColumnRenamed("level", "grp")
    return tuning.best(tuning.by_score(unit_runs(spark, d, k=k), groups, 3, tuning.grid(3, FINE)), ["grp"])


# ---- measures ----

# the cuts as the SQL has them, whatever the operator's are
AT_NDCG, AT_P, AT_RECALL = (1, 3, 5, 10), (1, 3, 5, 10, 20), (5, 10, 20, 50, 100, 1000)
MEASURES = ["map", "ndcg", "recip_rank", *(f"ndcg_cut_{c}" for c in AT_NDCG), *(f"p_{c}" for c in AT_P), *(f"recall_{c}" for c in AT_RECALL)]
HITS = (1, 3, 5, 10, 20, 50, 100, 1000)

def per_query_sql(run: str) -> str:
    return f"""j AS (SELECT r.qid, r.docid, r.rank, coalesce(rel, 0) AS rel FROM {run} r LEFT JOIN qrels USING (qid, docid)),
h AS (SELECT *, sum((rel > 0)::INT) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM j),
a AS (SELECT qid, sum(CASE WHEN rel > 0 THEN hits / rank::DOUBLE ELSE 0 END) AS ap, sum(rel / log2(rank + 1.0e0)) AS dcg, min(CASE WHEN rel > 0 THEN rank END) AS first,
  {', '.join(f'coalesce(sum(rel / log2(rank + 1.0e0)) FILTER (rank <= {c}), 0) AS dcg_{c}' for c in AT_NDCG)},
  {', '.join(f'count(*) FILTER (rel > 0 AND rank <= {c}) AS hit_{c}' for c in HITS)} FROM h GROUP BY qid),
m AS (SELECT qid, num_rel, round(coalesce(ap / nullif(num_rel, 0), 0), 6) AS map, round(coalesce(dcg / nullif(idcg, 0), 0), 6) AS ndcg, round(coalesce(1.0e0 / first, 0), 6) AS recip_rank,
  {', '.join(f'round(coalesce(dcg_{c} / nullif(idcg_{c}, 0), 0), 6) AS ndcg_cut_{c}' for c in AT_NDCG)},
  {', '.join(f'round(hit_{c} / {c}.0e0, 6) AS p_{c}' for c in AT_P)},
  {', '.join(f'round(coalesce(hit_{c} / nullif(num_rel, 0)::DOUBLE, 0), 6) AS recall_{c}' for c in AT_RECALL)} FROM a JOIN ideal USING (qid))"""


PER_QUERY = f"{BASE}, {QRELS}, {IDEAL}, {per_query_sql('(SELECT * FROM runs WHERE list_id = 0)')}"


@query(f"WITH {PER_QUERY} SELECT * FROM m")
def metrics_per_query(spark, d, k=DEPTH):
    return metrics.per_query(one_run(spark, d, k), qrels(spark, d))


COARSE = "(SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid DESC) AS rank FROM (SELECT qid, docid, floor(score) AS score FROM runs WHERE list_id = 0))"


@query(f"WITH {BASE}, {QRELS}, {IDEAL}, {per_query_sql(COARSE)} SELECT * FROM m")
def metrics_trec_ties(spark, d, k=DEPTH):
    """Measures of a run whose scores are whole numbers, so that many tie, in the usual evaluation program's order of ties."""
    return metrics.per_query(one_run(spark, d, k).withColumn("score", F.floor("score").cast("double")), qrels(spark, d), trec_ties=True)


MEANS = ", ".join(f"round(avg({x}), 6) AS {x}" for x in ["num_rel", *MEASURES])


@query(f"WITH {PER_QUERY} SELECT count(*) AS n_queries, {MEANS} FROM m")
def metrics_mean(spark, d, k=DEPTH):
    return metrics.mean(metrics.per_query(one_run(spark, d, k), qrels(spark, d)))


@query(f"WITH {PER_QUERY}, {LEVELS} SELECT level, count(*) AS n_queries, round(avg(map), 6) AS map, round(avg(ndcg_cut_3), 6) AS ndcg_cut_3 FROM m JOIN levels USING (qid) GROUP BY level")
def metrics_by_level(spark, d, k=DEPTH):
    per = metrics.per_query(one_run(spark, d, k), qrels(spark, d)).join(levels(spark, d), "qid")
    return metrics.mean(per.select("qid", "level", "map", "ndcg_cut_3"), ("level",))


@query(f"WITH {PER_QUERY}, x AS (SELECT {MEANS} FROM m) SELECT printf('%.1f & %.1f & %.1f', map * 100, ndcg * 100, recip_rank * 100) AS latex FROM x")
def latex_row(spark, d, k=DEPTH):
    return metrics.mean(metrics.per_query(one_run(spark, d, k), qrels(spark, d))).select(text.latex_row([F.col("map"), F.col("ndcg"), F.col("recip_rank")]).alias("latex"))


@query(f"""WITH {BASE}, {QRELS}, g AS (SELECT qid, coalesce(min(r.rank - 1), 1000) AS place FROM (SELECT * FROM qrels WHERE rel > 0) q LEFT JOIN (SELECT * FROM runs WHERE list_id = 0) r USING (qid, docid) GROUP BY qid)
SELECT count(*) AS n_queries, {', '.join(f'round(100 * avg((place < {c})::INT::DOUBLE), 2) AS r_{c}' for c in (1, 3, 5, 10, 20, 30, 50, 100))},
  round(100 * avg(CASE WHEN place < 1000 THEN 1.0e0 / (place + 1) ELSE 0 END), 2) AS mrr, round(100 * avg(CASE WHEN place < 1000 THEN 1.0e0 / log2(place + 2.0e0) ELSE 0 END), 2) AS ndcg FROM g""")
def legacy_hit_rates(spark, d, k=DEPTH):
    return metrics.hit_rates(one_run(spark, d, k), qrels(spark, d).filter("rel > 0").select("qid", "docid"))


# ---- conversations ----


@query("""SELECT conv_id || '-' || turn AS turn_id, conv_id::VARCHAR AS conversation, turn::INT AS turn_order, conv_id || '_' || turn AS submission_id FROM conversations""")
def turn_ids(spark, d):
    t = F.col("turn_id")
    return talk(spark, d).select("turn_id", conversation.conversation_of(t).alias("conversation"), conversation.turn_order(t).alias("turn_order"), conversation.submission_id(t).alias("submission_id"))


CONTEXT = """SELECT conv_id, turn, len(c) AS n_before, array_to_string(c, ' | ') AS context FROM (SELECT conv_id, turn, coalesce(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS c
  FROM conversations WHERE role = 'user')"""


@query(CONTEXT)
def context_window(spark, d):
    t = conversation.with_context(talk(spark, d).filter("role = 'user'"), "conv_id", "turn", "text")
    return t.select("conv_id", "turn", F.size("context").cast("long").alias("n_before"), F.array_join("context", " | ").alias("context"))


@query(CONTEXT)
def context_join(spark, d):
    t = conversation.context_by_join(talk(spark, d).filter("role = 'user'"), "conv_id", "turn", "text")
    return t.select("conv_id", "turn", F.size("context").cast("long").alias("n_before"), F.array_join("context", " | ").alias("context"))


@query(f"""WITH c AS (SELECT conv_id, turn, {W} AS words, coalesce(list({W}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS past FROM conversations),
s AS (SELECT conv_id, turn, words[1:16] AS own, list_transform(list_reverse(past), lambda x: x[1:16]) AS parts FROM c),
p AS (SELECT conv_id, turn, own, parts, list_transform(range(1, len(parts) + 1), lambda i: len(own) + coalesce(list_sum(list_transform(parts[1:i], lambda x: len(x))), 0)) AS ends FROM s),
k AS (SELECT *, len(list_filter(ends, lambda e: e <= 48)) AS whole FROM p),
f AS (SELECT *, len(own) + coalesce(list_sum(list_transform(parts[1:whole], lambda x: len(x))), 0) AS used, parts[(whole + 1)::BIGINT] AS cutpart FROM k)
SELECT conv_id, turn, array_to_string(list_concat(list_concat(own, flatten(parts[1:whole])), CASE WHEN cutpart IS NULL OR used >= 48 THEN [] ELSE list_concat(cutpart[1:(47 - used)::BIGINT], cutpart[len(cutpart):]) END), ' ') AS flat FROM f""")
def flatten_query(spark, d):
    t = talk(spark, d).withColumn("words", text.terms(F.col("text")))
    t = conversation.with_context(t, "conv_id", "turn", "words")
    return t.select("conv_id", "turn", F.array_join(text.flatten_context(F.col("words"), F.col("context"), 48, 16), " ").alias("flat"))


@query("SELECT conv_id, turn, substr('abc', (conv_id % 3 + 1)::INT, 1) AS level FROM conversations WHERE role = 'user' AND substr('abc', (conv_id % 3 + 1)::INT, 1) = 'b'")
def group_filter(spark, d):
    lv = F.substring(F.lit("abc"), (F.pmod("conv_id", F.lit(3)) + 1).cast("int"), F.lit(1))
    return conversation.of_level(talk(spark, d).filter("role = 'user'").select("conv_id", "turn", lv.alias("level")), "b")


@query("SELECT conv_id, turn, role FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations s WHERE s.conv_id = c.conv_id AND s.role = 'system')")
def evaluated_semi(spark, d):
    t = talk(spark, d)
    return conversation.evaluated(t.withColumn("turn_id", F.col("conv_id")), t.filter("role = 'system'").select(F.col("conv_id").alias("turn_id"))).select("conv_id", "turn", "role")


@query(f"""WITH {ITEMS}, m AS (SELECT qid, text AS cur, array_to_string(words[1:10], ' ') AS rw, array_to_string(words[greatest(len(words) - 9, 1):], ' ') AS rs, array_to_string(words, ' ') AS ex FROM items)
SELECT qid, cur AS raw, rw || ' ' || rs AS rwrs, ' ' || rs || ' ' || cur AS joined, '' AS nothing, 'ranking list fusion, no query needed' AS fused,
  CASE WHEN qid % 2 = 0 THEN rs ELSE rw END AS by_manual, rw || array_to_string(list_transform(list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_position(w, w[i]) = i THEN w[i] END), lambda x: x IS NOT NULL)[1:5], lambda x: x), ' ') AS expanded, '' AS missing
FROM (SELECT *, string_split(lower(ex), ' ') AS w FROM m)""")
def query_resolver(spark, d):
    w = F.col("words")
    rw, rs = F.array_join(text.first_terms(w, 10), " "), F.array_join(text.last_terms(w, 10), " ")
    names = {"rar_rw": rw, "rar_rs": rs, "gpt-4o_rar_rw": rw, "gpt-4o_judge_and_rewrite_rw": rs, "x": rw, "x_llm_rm": F.array_join(w, " ")}
    q = items(spark, d).select("qid", F.col("text").alias("current"), F.create_map(*(c for k, v in names.items() for c in (F.lit(k), v))).alias("queries"), F.when(F.pmod("qid", F.lit(2)) == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("provenance"))
    r = conversation.resolve
    return q.select("qid", r("raw").alias("raw"), r("rar_rwrs", w=0.5).alias("rwrs"), r("rar_rwrs+raw", w=0.5).alias("joined"), r("none").alias("nothing"), r("a_fuse_b").alias("fused"), r("alter_selon_manual_ptkb").alias("by_manual"), r("x_llm_rm", 5, 0.5).alias("expanded"), r("unknown").alias("missing"))


@query("""SELECT conv_id, turn, t AS formatted, q FROM (SELECT conv_id, turn, q, upper(substr(p, 1, 1)) || substr(p, 2) || CASE WHEN q THEN '?' ELSE '.' END AS t
  FROM (SELECT conv_id, turn, translate(text, '?\\"', '') AS p, regexp_matches(lower(text), '^(?:what|when|why|who|how|where|whose|which|is|are|were|was|do|does|did|can)') AS q FROM conversations))""")
def nl_query_format(spark, d):
    return talk(spark, d).select("conv_id", "turn", text.as_sentence(F.col("text")).alias("formatted"), text.is_question(F.col("text")).alias("q"))


@query("""WITH old AS (SELECT conv_id || '-' || turn AS turn_id, role AS name, text AS query, turn AS seq, 0 AS gen FROM conversations),
new AS (SELECT conv_id || '-' || turn, 'user', 'new ' || text, turn, 1 FROM conversations WHERE turn >= 2 UNION ALL SELECT conv_id || '-' || turn, 'user', 'last ' || text, turn + 100, 1 FROM conversations WHERE turn >= 4)
SELECT turn_id, name, query, seq FROM (SELECT * FROM old UNION ALL SELECT * FROM new) QUALIFY row_number() OVER (PARTITION BY turn_id, name ORDER BY gen DESC, seq DESC) = 1""")
def upsert_reformulations(spark, d):
    t = talk(spark, d)
    old = t.select("turn_id", F.col("role").alias("name"), F.col("text").alias("query"), F.col("turn").alias("seq"))
    new = t.filter("turn >= 2").select("turn_id", F.lit("user").alias("name"), F.concat(F.lit("new "), "text").alias("query"), F.col("turn").alias("seq"))
    late = t.filter("turn >= 4").select("turn_id", F.lit("user").alias("name"), F.concat(F.lit("last "), "text").alias("query"), (F.col("turn") + 100).alias("seq"))
    return conversation.upserted(old, new.unionByName(late), ["turn_id", "name"])


@query("SELECT conv_id || '-' || turn AS turn_id, length(text) >= 300 AS a_wins FROM conversations")
def better_rewrite(spark, d):
    pair = F.array(*(F.struct(F.lit(k).alias("name"), F.create_map(F.lit("ndcg"), v).alias("metrics")) for k, v in (("a", F.length("text").cast("double")), ("b", F.lit(300.0)))))
    return conversation.better_rewrite(talk(spark, d).select("turn_id", F.explode(pair).alias("x")).select("turn_id", "x.*"), "a", "b", "ndcg")


# ---- prompts and answers ----

PARTS = f"{ITEMS}, p AS (SELECT qid, array_to_string(words, ' ') AS a, array_to_string(list_reverse(words), ' ') AS b, substr('abc', (qid % 3 + 1)::INT, 1) AS level FROM items)"


def parts(spark, d):
    """Each item's whole text as terms, forwards and backwards, and its level: what answers are made of here."""
    return items(spark, d).select("qid", F.array_join("words", " ").alias("a"), F.array_join(F.reverse("words"), " ").alias("b"), level().alias("level"))


@query(f"""WITH {PARTS} SELECT qid, CASE WHEN qid % 5 <> 0 THEN a END AS reason, CASE WHEN qid % 5 <> 0 THEN level END AS level, CASE WHEN qid % 5 <> 0 THEN b END AS rewrite, CASE WHEN qid % 5 <> 0 THEN a || chr(10) || b END AS response FROM p""")
def parse_judge(spark, d):
    mark = lambda x: F.when(F.pmod("qid", F.lit(4)) == 0, F.lit(f"{x}: ")).when(F.pmod("qid", F.lit(4)) == 1, F.lit(f"**{x}**: ")).when(F.pmod("qid", F.lit(4)) == 2, F.lit(f"**{x}:** ")).otherwise(F.lit(f"### {x}: "))
    lv = F.when(F.pmod("qid", F.lit(5)) != 0, F.concat(mark("Level"), "level", F.lit("\n"))).otherwise("")
    answer = F.concat(mark("Reason"), "a", F.lit("\n"), lv, mark("Rewrite"), "b", F.lit("\n"), mark("Response"), "a", F.lit("\n"), "b")
    return parts(spark, d).select("qid", parsing.parse_judgement(answer).alias("x")).select("qid", "x.reason", "x.level", "x.rewrite", "x.response")


@query(f"WITH {PARTS} SELECT qid, CASE WHEN qid % 3 <> 0 THEN level END AS level, CASE WHEN qid % 3 <> 0 THEN a END AS reason FROM p")
def parse_level(spark, d):
    answer = F.when(F.pmod("qid", F.lit(3)) != 0, F.concat(F.lit("Level: "), "level", F.lit("\nReason: "), "a")).otherwise(F.concat(F.lit("Reason: "), "a"))
    return parts(spark, d).select("qid", parsing.parse_level(answer).alias("x")).select("qid", "x.level", "x.reason")


@query(f"WITH {PARTS} SELECT qid, CASE WHEN qid % 4 <> 3 THEN b END AS rewrite, CASE WHEN qid % 4 <> 3 THEN a || chr(10) || b END AS response, CASE WHEN qid % 4 = 1 THEN a END AS cot FROM p")
def parse_rewrite(spark, d):
    lead = F.when(F.pmod("qid", F.lit(4)) == 1, F.concat(F.lit("Rewrite: "), "a", F.lit("So the question should be rewritten as: "), "b")).when(F.pmod("qid", F.lit(4)) == 3, F.col("b")).otherwise(F.concat(F.lit("Rewrite: "), "b"))
    answer = F.concat(lead, F.lit("\nResponse: "), "a", F.lit("\n"), "b")
    return parts(spark, d).select("qid", parsing.parse_rewrite_response(answer).alias("x")).select("qid", "x.rewrite", "x.response", "x.cot")


@query(f"WITH {PARTS} SELECT qid, a AS rewrite, b AS response, level AS reason FROM p")
def parse_labelled(spark, d):
    answer = F.concat(F.lit("Rewrite: old\nRewrite: "), "a", F.lit("\nResponse: "), "b", F.lit("\nReason: "), "level")
    return parts(spark, d).select("qid", parsing.parse_labelled(answer).alias("x")).select("qid", "x.rewrite", "x.response", "x.reason")


@query(f"WITH {PARTS} SELECT qid, i::INT AS place, CASE i WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN level ELSE 'GG' END AS q FROM p, range(5) r(i) WHERE qid % 7 <> 0")
def parse_multi_query(spark, d):
    answer = F.concat(F.lit("1. "), "a", F.lit("\n- "), "b", F.lit('\n"'), "level", F.lit('"'), F.when(F.pmod("qid", F.lit(7)) == 0, F.lit("\n\nx")).otherwise(""))
    return parts(spark, d).select("qid", F.posexplode(parsing.pad_queries(parsing.parse_queries(answer), 5, "GG")).alias("place", "q"))


@query("""SELECT conv_id, turn, 'Rewrite the last turn.' || chr(10) || chr(10) || CASE WHEN len(c) > 0 THEN 'Conversation:' || chr(10) || array_to_string(c, chr(10)) || chr(10) || chr(10) ELSE '' END || 'Current turn: ' || text AS prompt
FROM (SELECT conv_id, turn, text, coalesce(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS c FROM conversations WHERE role = 'user')""")
def prompt_build(spark, d):
    t = conversation.with_context(talk(spark, d).filter("role = 'user'"), "conv_id", "turn", "text")
    return t.select("conv_id", "turn", parsing.prompt("Rewrite the last turn.", F.col("text"), F.col("context")).alias("prompt"))


# ---- reranking ----


@query(f"WITH {ITEMS} SELECT qid, array_to_string([(qid % 4 + 1)::VARCHAR] || list_transform(list_filter([3, 1, 2, 4], lambda x: x <> qid % 4 + 1), lambda x: x::VARCHAR), ',') AS places FROM items")
def permutation_repair(spark, d):
    answer = F.format_string("[%d] > [3] > [9] > [1] > [%d]", F.pmod("qid", F.lit(4)) + 1, F.pmod("qid", F.lit(4)) + 1)
    return items(spark, d).select("qid", F.array_join(parsing.repair_permutation(answer, F.lit(4)), ",").alias("places"))


OVERLAP = f"""{BASE}, sc AS (SELECT r.qid, r.docid, r.rank, round(len(list_intersect(list_distinct(i.words), l.words)) / nullif(len(list_distinct(i.words)), 0)::DOUBLE, 6) AS ms FROM runs r JOIN items i USING (qid) JOIN lists l USING (docid) WHERE list_id = 0)"""


@query(f"""WITH {OVERLAP}, n AS (SELECT qid, docid, CASE WHEN rank <= 20 THEN row_number() OVER (PARTITION BY qid, rank <= 20 ORDER BY CASE WHEN rank <= 20 THEN ms END DESC, rank) ELSE rank END::INT AS rank FROM sc)
SELECT qid, docid, round(1.0e0 / rank, 6) AS score, rank FROM n""")
def rerank_rescore(spark, d, k=DEPTH):
    run = kept(one_run(spark, d, k))
    found = read(spark, d, "documents").join(small(run.select(F.col("docid").alias("doc_id")).distinct()), "doc_id", "left_semi")
    words = lexical.term_lists(found, "doc_id", "text").select("docid", F.col("words").alias("dw"))
    r = run.join(items(spark, d).select("qid", "words"), "qid").join(words, "docid")
    return rerank.rescored(r.withColumn("model_score", rerank.overlap(F.col("words"), F.col("dw"))), "model_score", 20)


@query(r"SELECT doc_id, array_to_string(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[1:300], ' ') AS passage FROM documents")
def passage_truncate(spark, d):
    return read(spark, d, "documents").select("doc_id", text.truncate_words(F.col("text"), 300).alias("passage"))


def window_sql(source: str, start: int, end: int) -> str:
    """Passages at places start + 1 to end by length, longest first, ties as they were; the others stay."""
    inside = f"place > {start} AND place <= {end}"
    return f"SELECT qid, docid, n, CASE WHEN {inside} THEN {start} + row_number() OVER (PARTITION BY qid, {inside} ORDER BY CASE WHEN {inside} THEN n END DESC, place) ELSE place END AS place FROM {source}"


@query(f"""WITH {BASE}, r0 AS (SELECT r.qid, r.docid, r.rank AS place, length(array_to_string(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:300], ' ')) AS n
  FROM runs r JOIN documents ON doc_id = docid WHERE list_id = 0),
w1 AS ({window_sql('r0', 20, 40)}), w2 AS ({window_sql('w1', 10, 30)}), w3 AS ({window_sql('w2', 0, 20)})
SELECT w.qid, w.docid, r.score, r.rank FROM w3 w JOIN runs r ON r.list_id = 0 AND r.qid = w.qid AND r.rank = w.place""")
def listwise_rerank(spark, d):
    """Sliding windows over the first 40 of 50 with a stand-in for the model: longer passages first."""
    run = kept(one_run(spark, d))
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("docid"), text.truncate_words(F.col("text"), 300).alias("contents"))
    docs = docs.join(small(run.select("docid").distinct()), "docid", "left_semi")
    r = run.join(items(spark, d).select("qid", F.col("text").alias("query")), "qid").join(docs, "docid")
    return rerank.listwise(r, lambda q, c: [i + 1 for i in sorted(range(len(c)), key=lambda i: (-len(c[i]), i))], 20, 10, 40)


@query(SQL["listwise_rerank"])
def listwise_rounds(spark, d):
    """The same in rounds over all queries, whose answers are written."""
    run = kept(one_run(spark, d))
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("docid"), text.truncate_words(F.col("text"), 300).alias("contents"))
    asked = run.join(items(spark, d).select("qid", F.col("text").alias("query")), "qid")
    longest = lambda q, c: [[i + 1 for i in sorted(range(len(x)), key=lambda i: (-len(x[i]), i))] for x in c]
    return rerank.listwise_rounds(kept(passages.with_contents(asked, docs)), longest, scratch_path(spark), 20, 10, 40)


@query(f"""WITH {PARTS}, m AS (SELECT qid, a, b FROM p)
SELECT qid, 'system: You rank passages by how well they answer a query.' || chr(10) || 'user: There are 2 passages, each with a number in []. Rank them for the query: ' || a || chr(10) || 'assistant: Send the passages.' || chr(10)
  || 'user: [1] ' || array_to_string(string_split(a, ' ')[1:5], ' ') || chr(10) || 'assistant: Passage [1] received.' || chr(10) || 'user: [2] ' || array_to_string(string_split(b, ' ')[1:5], ' ') || chr(10) || 'assistant: Passage [2] received.' || chr(10)
  || 'user: Query: ' || a || '. Rank the 2 passages, best first, as numbers: [2] > [1]. Give the ranking only.' AS dialogue, 'query: ' || a AS query_side, 'document: ' || b AS document_side FROM m""")
def rerank_prompts(spark, d):
    p = parts(spark, d)
    messages = parsing.listwise_prompt(F.col("a"), F.array("a", F.concat(F.lit(" Title: Content:  "), "b")), 5)
    q, doc = rerank.encoder_pair(F.col("a"), F.col("b"))
    return p.select("qid", F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("dialogue"), q.alias("query_side"), doc.alias("document_side"))


# ---- files, names, blocks, experiments ----


@query(r"""WITH l AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ['p' || doc_id, lang, 'http://u'] WHEN 1 THEN ['p' || doc_id, lang, source, 'http://u'] WHEN 2 THEN ['p' || doc_id, lang] ELSE ['p' || doc_id, lang, 'ftp://u'] END AS p FROM documents)
SELECT p[1] AS docid, CASE WHEN ok THEN array_to_string(p[2:len(p) - 1], '    ') END AS contents, CASE WHEN ok THEN p[len(p)] END AS url, ok FROM (SELECT p, len(p) >= 3 AND starts_with(p[len(p)], 'http') AS ok FROM l)""")
def tsv_repair(spark, d):
    p, m = F.concat(F.lit("p"), F.col("doc_id").cast("string")), F.pmod("doc_id", F.lit(4))
    line = F.when(m == 0, F.concat_ws("\t", p, "lang", F.lit("http://u"))).when(m == 1, F.concat_ws("\t", p, "lang", "source", F.lit("http://u"))).when(m == 2, F.concat_ws("\t", p, "lang")).otherwise(F.concat_ws("\t", p, "lang", F.lit("ftp://u")))
    return passages.repaired_tsv(read(spark, d, "documents").select(line.alias("value")))


@query("SELECT doc_id, 'http://example.com/d' || doc_id AS url, 'd' || doc_id || chr(9) || lang || chr(9) || 'http://example.com/d' || doc_id AS line FROM documents")
def jsonl_to_tsv(spark, d):
    j = read(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("docid"), F.col("lang").alias("contents"))
    out = F.split("value", "\t")
    return passages.jsonl_to_tsv(passages.to_jsonl(j)).select(F.substring(out[0], F.lit(2), F.length(out[0])).cast("long").alias("doc_id"), out[2].alias("url"), F.col("value").alias("line"))


@query(r"""WITH t AS (SELECT doc_id, coalesce(source, '') AS source, 'p' || doc_id || chr(9) || coalesce(text, '') AS l FROM documents),
f AS (SELECT CASE doc_id % 4 WHEN 0 THEN l || chr(9) || 'http://u' WHEN 1 THEN l || chr(9) || source || chr(9) || 'http://u' WHEN 2 THEN l ELSE l || chr(9) || 'ftp://u' END AS l FROM t),
l AS (SELECT string_split(u, chr(9)) AS p FROM (SELECT unnest(string_split_regex(l, '\r\n|\r|\n')) AS u FROM f))
SELECT p[1] AS docid, CASE WHEN ok THEN array_to_string(p[2:len(p) - 1], '    ') END AS contents, CASE WHEN ok THEN p[len(p)] END AS url, ok FROM (SELECT p, len(p) >= 3 AND starts_with(p[len(p)], 'http') AS ok FROM l)""")
def tsv_repair_text(spark, d):
    """Whole texts as a file of lines gives them: a text with line breaks is several lines."""
    m, tab = F.pmod("doc_id", F.lit(4)), F.lit("\t")
    line = F.concat(F.lit("p"), F.col("doc_id").cast("string"), tab, F.coalesce("text", F.lit("")))
    line = F.when(m == 0, F.concat(line, F.lit("\thttp://u"))).when(m == 1, F.concat(line, tab, F.coalesce("source", F.lit("")), F.lit("\thttp://u"))).when(m == 2, line).otherwise(F.concat(line, F.lit("\tftp://u")))
    return passages.repaired_tsv(read(spark, d, "documents").select(F.explode(F.split(line, "\r\n|\r|\n")).alias("value")))


@query(r"""SELECT doc_id, 'http://example.com/d' || doc_id AS url, 'd' || doc_id || chr(9) || CASE WHEN regexp_matches(t, '[\t"\r\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END || chr(9) || 'http://example.com/d' || doc_id AS line
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def jsonl_to_tsv_text(spark, d):
    j = read(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("docid"), F.col("text").alias("contents"))
    out = F.split("value", "\t")
    return passages.jsonl_to_tsv(passages.to_jsonl(j)).select(F.substring(out[0], F.lit(2), F.length(out[0])).cast("long").alias("doc_id"), F.element_at(out, -1).alias("url"), F.col("value").alias("line"))


@query("SELECT doc_id, replace('q_' || (doc_id % 7) || '_1', '_', '-') || ' 0 doc_' || doc_id || ' ' || quality AS line, replace('q_' || (doc_id % 7) || '_1', '_', '-') AS qid, 'doc_' || doc_id AS docid, quality::INT AS rel FROM labels")
def qrel_normalize(spark, d):
    line = F.concat(F.lit("q_"), F.pmod("doc_id", F.lit(7)).cast("string"), F.lit("_1 0 doc_"), F.col("doc_id").cast("string"), F.lit(" "), F.col("quality").cast("string"))
    fixed = read(spark, d, "labels").select("doc_id", trec.hyphenated(line).alias("value"))
    q = trec.parse_qrels(fixed).withColumn("doc_id", F.regexp_extract("docid", r"(\d+)$", 1).cast("long"))
    return fixed.join(q, "doc_id").select("doc_id", F.col("value").alias("line"), "qid", "docid", "rel")


@query(f"WITH {BASE} SELECT qid::VARCHAR AS qid, docid::VARCHAR AS docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid::VARCHAR)::INT AS rank, 'bm25' AS tag FROM runs WHERE list_id = 0")
def run_round_trip(spark, d):
    return trec.parse_run(trec.run_lines(one_run(spark, d), "bm25"))


@query("SELECT doc_id, 'S1[' || source || ']-S2[' || lang || ']-g[none]-[BM25_rm3]-[rankgpt_4_2]-[s2_top50]' AS name, source AS retrieval, lang AS rerank, 'BM25_rm3' AS model FROM documents")
def run_name_parse(spark, d):
    name = F.concat(F.lit("S1["), "source", F.lit("]-S2["), "lang", F.lit(text.run_name("", "", "none", "BM25", "rankgpt", 50, feedback=True, window=(4, 2))[len("S1[]-S2[") :]))
    t = read(spark, d, "documents").select("doc_id", name.alias("name"))
    p = text.run_name_parts(F.col("name"))
    return t.select("doc_id", "name", p[0].alias("retrieval"), p[1].alias("rerank"), p[3].alias("model"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, (row_number() OVER (ORDER BY doc_id) - 1) // 128 AS block FROM documents")
def block_assign(spark, d):
    return passages.blocks(read(spark, d, "documents").select("doc_id"), "doc_id", 128)


@query(f"WITH {BASE} SELECT 'demo' AS run_name, qid::VARCHAR AS turn_id, rank, docid::VARCHAR AS id, score, rank <= 3 AS used FROM runs WHERE list_id = 0 AND rank <= 10")
def submission_nest(spark, d):
    answers = items(spark, d).select("qid", "text")
    s = turns.submission(one_run(spark, d, 10), answers, 3, "demo")
    flat = s.select("run_name", F.explode("turns").alias("t")).select("run_name", F.regexp_replace("t.turn_id", ".*_", "").alias("turn_id"), F.explode(F.element_at("t.responses", 1)["passage_provenance"]).alias("p", ))
    place = flat.select("run_name", "turn_id", "p.id", "p.score", "p.used")
    return ranked(place.withColumn("docid", F.col("id").cast("long")), ["turn_id"]).select("run_name", "turn_id", "rank", "id", "score", "used")


@query("""SELECT m AS model, l AS list, CASE WHEN m = 'BM25' THEN 1000 ELSE 500 END::INT AS k, CASE WHEN m = 'BM25' THEN 'yes' ELSE 'no' END AS feedback FROM (VALUES ('BM25'), ('dense')) a(m), (VALUES ('rw'), ('rwrs'), ('raw')) b(l)""")
def param_grid(spark, d):
    config = {"iterate": {"model": ["BM25", "dense"], "list": ["rw", "rwrs", "raw"]}, "param_mapping": {"model": {"BM25": {"k": 1000, "feedback": "yes"}}}, "fixed": {"k": 500, "feedback": "no"}}
    return spark.createDataFrame(experiments.combinations(config), "model string, list string, k int, feedback string")


# ---- lookups, write-back, generation, search ----


@query("""SELECT l.docid, d.text AS contents FROM (SELECT doc_id AS docid FROM labels UNION ALL SELECT doc_id + 1000000000 FROM labels WHERE doc_id % 10 = 0) l LEFT JOIN documents d ON d.doc_id = l.docid""")
def passage_lookup(spark, d):
    ids = read(spark, d, "labels").select(F.col("doc_id").alias("docid"))
    ids = ids.unionByName(ids.filter("docid % 10 = 0").select((F.col("docid") + 1000000000).alias("docid")))
    return passages.by_ids(read(spark, d, "documents").select(F.col("doc_id").alias("docid"), F.col("text").alias("contents")), ids)


@query("""WITH t AS (SELECT conv_id || '-' || turn AS turn_id, CASE WHEN turn % 3 = 2 THEN [] ELSE [conv_id + turn, 1000000000 + turn, conv_id] END AS p FROM conversations),
e AS (SELECT turn_id, unnest(p) AS docid, unnest(range(len(p))) AS pos FROM t), j AS (SELECT turn_id, pos, e.docid, text FROM e LEFT JOIN documents ON doc_id = e.docid),
g AS (SELECT turn_id, string_agg(docid::VARCHAR, ',' ORDER BY pos) AS docids, count(text) AS found, md5(string_agg(coalesce(text, ''), '|' ORDER BY pos)) AS contents FROM j GROUP BY turn_id)
SELECT t.turn_id, coalesce(docids, '') AS docids, coalesce(found, 0) AS found, coalesce(contents, md5('')) AS contents FROM t LEFT JOIN g USING (turn_id)""")
def gold_passages(spark, d):
    p = F.when(F.col("turn") % 3 == 2, F.array().cast("array<long>")).otherwise(F.array(F.col("conv_id") + F.col("turn"), F.lit(1000000000) + F.col("turn"), "conv_id"))
    t = talk(spark, d).select("turn_id", p.alias("response_provenance"))
    g = passages.gold_passages(t, read(spark, d, "documents").select(F.col("doc_id").alias("docid"), F.col("text").alias("contents")))
    column = lambda f, none: F.transform("gold", lambda x: F.coalesce(x[f].cast("string"), F.lit(none)))
    return g.select("turn_id", F.array_join(column("docid", ""), ",").alias("docids"), F.size(F.filter("gold", lambda x: x["contents"].isNotNull())).cast("long").alias("found"), F.md5(F.array_join(column("contents", ""), "|").cast("binary")).alias("contents"))


@query(f"WITH {ITEMS}, {LEVELS} SELECT level, count(*) AS n_queries FROM levels GROUP BY level")
def level_counts(spark, d):
    return conversation.level_counts(levels(spark, d))


@query(f"WITH {BASE} SELECT DISTINCT qid FROM runs WHERE list_id = 0 AND qid NOT IN (SELECT qid FROM runs WHERE list_id = 1 AND qid % 3 <> 0)")
def queries_lacking(spark, d, k=DEPTH):
    return fusion.queries_lacking(runs(spark, d, 2, k).filter("list_id = 0 OR qid % 3 <> 0"))


def reformulated(spark, d):
    """Conversation turns with two reformulations each, and for even turns a stored result."""
    one = lambda name, q, p: F.struct(F.lit(name).alias("reformulation_name"), q.alias("reformulated_query"), p.cast("array<int>").alias("ptkb_provenance"))
    t = talk(spark, d)
    r = F.array(one("x_rw", F.concat(F.lit("rw "), "text"), F.array("turn", F.lit(7))), one("x_rs", F.col("role"), F.array()))
    return t.withColumn("reformulations", r)


@query("SELECT conv_id || '-' || turn AS turn_id, 'rw ' || text AS rewrite, (turn || ',7') AS provenance, true AS none FROM conversations")
def find_reformulation(spark, d):
    t = reformulated(spark, d)
    return t.select("turn_id", conversation.reformulation("x_rw")["reformulated_query"].alias("rewrite"), F.array_join(conversation.provenance_of("x_rw").cast("array<string>"), ",").alias("provenance"), conversation.reformulation("other").isNull().alias("none"))


@query("SELECT conv_id || '-' || turn AS qid, role, length(text) AS n FROM conversations WHERE role = 'user'")
def turn_by_qid(spark, d):
    t = talk(spark, d)
    return conversation.turn_of(t, t.filter("role = 'user'").select(F.col("turn_id").alias("qid"))).select("qid", "role", F.length("text").cast("long").alias("n"))


@query("""SELECT c.conv_id || '-' || c.turn AS qid, f.turn_id, f.text FROM conversations c JOIN (SELECT conv_id, conv_id::VARCHAR AS turn_id, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1) f USING (conv_id)""")
def turn_of_repeated_id(spark, d):
    """All turns of a conversation under one id, of which a lookup gives the first."""
    t = talk(spark, d).withColumn("turn_id", F.col("conv_id").cast("string"))
    asked = talk(spark, d).select(F.col("turn_id").alias("asked"), F.col("conv_id").cast("string").alias("qid"))
    return asked.join(conversation.turn_of(t, t.select(F.col("turn_id").alias("qid")).distinct(), "turn"), "qid").select(F.col("asked").alias("qid"), "turn_id", "text")


@query("""WITH t AS (SELECT conv_id || '-' || turn AS turn_id, turn, role FROM conversations),
old AS (SELECT turn_id, 0 AS pos, 'c' AS collection, 'old' AS model, 0.5::DOUBLE AS map, 'kept' AS response FROM t WHERE turn % 2 = 0 UNION ALL SELECT turn_id, 1, 'c', 'BM25', 0.25::DOUBLE, 'stale' FROM t WHERE turn % 2 = 0),
new AS (SELECT turn_id, 'BM25' AS model, turn / 8.0::DOUBLE AS map, role AS response FROM t WHERE turn < 5 UNION ALL SELECT turn_id, 'dense', 1.0::DOUBLE, 'd' FROM t WHERE turn < 3),
merged AS (SELECT o.turn_id, o.pos, o.model, coalesce(n.map, o.map) AS map, coalesce(n.response, o.response) AS response FROM old o LEFT JOIN new n ON n.turn_id = o.turn_id AND n.model = o.model
  UNION ALL SELECT n.turn_id, (SELECT count(*) FROM old o WHERE o.turn_id = n.turn_id) + row_number() OVER (PARTITION BY n.turn_id ORDER BY n.model) - 1, n.model, n.map, n.response FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.turn_id = n.turn_id AND o.model = n.model))
SELECT turn_id, pos::INT AS pos, model, map, response FROM merged""")
def results_writeback(spark, d):
    """New results put over stored ones of their key, and after the others."""
    def entry(model, value, response):
        named = {c: F.lit("c" if c == "collection" else None).cast("string") for c in conversation.RESULT_KEY} | {"retrieval_model": F.lit(model)}
        return F.struct(*(v.alias(k) for k, v in named.items()), F.create_map(F.lit("map"), value).alias("metrics"), response.alias("response"))

    t = talk(spark, d)
    old = F.when(F.col("turn") % 2 == 0, F.array(entry("old", F.lit(0.5), F.lit("kept")), entry("BM25", F.lit(0.25), F.lit("stale"))))
    new = t.filter("turn < 5").select("turn_id", entry("BM25", F.col("turn") / 8.0, F.col("role")).alias("x")).unionByName(t.filter("turn < 3").select("turn_id", entry("dense", F.lit(1.0), F.lit("d")).alias("x"))).select("turn_id", "x.*")
    full = conversation.with_results(t.select("turn_id", old.alias("results")), new)
    return full.select("turn_id", F.posexplode("results").alias("pos", "x")).select("turn_id", "pos", F.col("x.retrieval_model").alias("model"), F.col("x.metrics")["map"].alias("map"), "x.response")


@query(f"WITH {PER_QUERY}, x AS (SELECT {MEANS} FROM m), s AS (SELECT 'map' AS measure, map AS value FROM x UNION ALL SELECT 'ndcg', ndcg FROM x UNION ALL SELECT 'recall_10', recall_10 FROM x) SELECT measure, value, n_queries, lines FROM s CROSS JOIN (SELECT count(*) AS n_queries, 1::BIGINT AS lines FROM m)")
def metrics_sink(spark, d, k=DEPTH):
    """Measures written to their files, and read back from there."""
    per, folder = kept(metrics.per_query(one_run(spark, d, k), qrels(spark, d))), scratch_path(spark)
    sinks.save_measures(per, metrics.mean(per), folder, "demo", ["map", "ndcg", "recall_10"], {"k": k})
    rows = spark.read.text(f"{folder}/measures").select("measure", F.regexp_extract("value", r"^demo-\[(.*)\]$", 1).cast("double").alias("value"))
    queries = spark.read.json(f"{folder}/queries/demo").agg(F.count("*").alias("n_queries"))
    return rows.groupBy("measure", "value").agg(F.count("*").alias("lines")).crossJoin(F.broadcast(queries))


def item_turns(spark, d):
    """Items as turns: a rewrite (first ten terms), a response (last ten), a judged rewrite (all terms) and a level."""
    w = F.col("words")
    one = lambda name, q: F.struct(F.lit(name).alias("reformulation_name"), q.alias("reformulated_query"), F.array().cast("array<int>").alias("ptkb_provenance"))
    r = F.array(one("gpt-4o_rar_rw", F.array_join(text.first_terms(w, 10), " ")), one("gpt-4o_rar_rs", F.array_join(text.last_terms(w, 10), " ")), one("gpt-4o_judge_and_rewrite_rw", F.array_join(w, " ")), one("gpt-4o_judge_and_rewrite_lv", level()))
    return items(spark, d).select(F.col("qid").cast("string").alias("turn_id"), F.col("text").alias("current_utterance"), F.lit(None).cast("string").alias("oracle_utterance"), F.array().cast("array<int>").alias("ptkb_provenance"), r.alias("reformulations"))


@query(f"""WITH {ITEMS}, {LEVELS}, t AS (SELECT qid::VARCHAR AS qid, level, text AS raw, array_to_string(words[1:10], ' ') AS rw, ' ' || array_to_string(words[greatest(len(words) - 9, 1):], ' ') AS rwrs, array_to_string(words, ' ') AS judged FROM items JOIN levels USING (qid) WHERE level = 'b')
SELECT list_id, qid, level, CASE list_id WHEN 0 THEN rw WHEN 1 THEN rwrs ELSE judged END AS text, raw AS retrieval, judged AS reranking, '' AS generation FROM t, range(3) r(list_id)""")
def query_list(spark, d):
    config = experiments.replace(experiments.PRESETS["by_level"], group="b")
    queries, texts = search.query_list(item_turns(spark, d), config)
    return texts.join(queries, "qid").select(F.col("list_id").cast("long").alias("list_id"), "qid", "level", "text", "retrieval", "reranking", "generation")


@query(f"""WITH {UNIT}, u AS (SELECT CASE list_id WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS list_id, qid, docid, rank, score FROM unit),
w AS (SELECT qid, l.list_id, 1.0::DOUBLE AS weight FROM items, (VALUES (0), (1), (2)) l(list_id)), f AS ({combination_sql('w', 'u')}),
n AS (SELECT f.qid, f.docid, CASE WHEN rank <= 20 THEN row_number() OVER (PARTITION BY qid, rank <= 20 ORDER BY CASE WHEN rank <= 20 THEN length(coalesce(text, '')) END DESC, rank) ELSE rank END::INT AS rank FROM f JOIN documents ON doc_id = docid)
SELECT qid::VARCHAR AS qid, docid, round(1.0e0 / rank, 6) AS score, rank FROM n""")
def search_end_to_end(spark, d, k=DEPTH):
    """Turns to a run: three texts a turn, BM25, fusion with equal weights, and a stand-in for a reranker: longer passages first."""
    config = experiments.replace(experiments.PRESETS["equal"], k=k, reranker="pointwise", rerank_k=20)
    queries, texts = search.query_list(item_turns(spark, d), config)
    collection = search.Collection(read(spark, d, "documents").select(F.col("doc_id").alias("docid"), F.col("text").alias("contents")), index(spark, d))
    return search.search(queries, texts, collection, config, search.Models(score=lambda q, c: [len(x) for x in c]))


def three_texts_sql(lists: str, scored: str) -> str:
    """Three texts an item, searched as `scored` (list_id, qid, docid, score) says, and summed with equal weights."""
    return f"""WITH {ITEMS}, t AS (SELECT qid, array_to_string(words[1:10], ' ') AS rw, ' ' || array_to_string(words[greatest(len(words) - 9, 1):], ' ') AS rwrs, array_to_string(words, ' ') AS judged FROM items),
q AS (SELECT 0 AS list_id, qid, rw AS text FROM t UNION ALL SELECT 1, qid, rwrs FROM t UNION ALL SELECT 2, qid, judged FROM t), {lists},
runs AS ({rank_sql(scored, DEPTH, 'list_id, qid')}), unit AS (SELECT list_id, qid, docid, rank, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0) AS score FROM runs WINDOW w AS (PARTITION BY list_id, qid)),
w AS (SELECT qid, l.list_id, 1.0::DOUBLE AS weight FROM items, (VALUES (0), (1), (2)) l(list_id)), f AS ({combination_sql('w')}) SELECT qid::VARCHAR AS qid, docid, score, rank FROM f"""


SIZES = "[(length({0}) % 7)::DOUBLE, (length({0}) % 5)::DOUBLE, (length({0}) % 3)::DOUBLE]"


@query(three_texts_sql(f"d AS (SELECT doc_id AS docid, {SIZES.format('text')} AS v FROM documents WHERE text IS NOT NULL), e AS (SELECT list_id, qid, {SIZES.format('text')} AS v FROM q)", "SELECT list_id, qid, docid, round(list_inner_product(e.v, d.v), 6) AS score FROM e CROSS JOIN d"))
def search_dense(spark, d):
    """Turns to a run by vectors, with a stand-in for the encoder: three remainders of the text's length."""
    config = experiments.replace(experiments.PRESETS["equal"], k=DEPTH, model="dense")
    queries, texts = search.query_list(item_turns(spark, d), config)
    n = F.length("text")
    stored = read(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("docid"), F.array(*((n % m).cast("double") for m in (7, 5, 3))).alias("embedding"))
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("docid"), F.col("text").alias("contents"))
    model = search.Models(encode=vectors.PerWorker(lambda: lambda xs: [[float(len(x) % m) for m in (7, 5, 3)] for x in xs]))
    return search.search(queries, texts, search.Collection(docs, vectors=stored), config, model).select("qid", "docid", "score", "rank")


@query(three_texts_sql(f"{CORPUS}, e AS (SELECT list_id, qid, term, count(*)::DOUBLE AS w FROM (SELECT list_id, qid, unnest(string_split(trim(text), ' ')) AS term FROM q) GROUP BY ALL)", "SELECT list_id, qid, docid, round(sum(w * tf), 6) AS score FROM e JOIN post USING (term) GROUP BY ALL"))
def search_sparse(spark, d):
    """Turns to a run by term weights, with a stand-in for the model: how often a term occurs."""
    config = experiments.replace(experiments.PRESETS["equal"], k=DEPTH, model="sparse")
    queries, texts = search.query_list(item_turns(spark, d), config)
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("docid"), F.col("text").alias("contents"))
    weights = index(spark, d).postings.select(F.col("term").alias("dim"), "docid", F.col("tf").cast("double").alias("value"))

    def counts(xs):
        return [{t: float(x.split().count(t)) for t in x.split()} for x in xs]

    return search.search(queries, texts, search.Collection(docs, weights=weights), config, search.Models(encode_terms=counts)).select("qid", "docid", "score", "rank")


@query(SQL["listwise_rerank"].replace("length(array_to_string(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:300], ' ')) AS n", "length(coalesce(text, '')) AS n").replace("SELECT w.qid, w.docid, r.score, r.rank FROM", "SELECT w.qid::VARCHAR AS qid, w.docid, r.score, r.rank FROM"))
def search_listwise(spark, d):
    """One text a turn, BM25, listwise windows over the first 40."""
    config = experiments.Config(retrieval_query="gpt-4o_judge_and_rewrite_rw", k=DEPTH, reranker="listwise", window=20, step=10, rerank_k=40)
    queries, texts = search.query_list(item_turns(spark, d), config)
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("docid"), F.col("text").alias("contents"))
    longest = lambda q, c: [i + 1 for i in sorted(range(len(c)), key=lambda i: (-len(c[i]), i))]
    return search.search(queries, texts, search.Collection(docs, index(spark, d)), config, search.Models(permute=longest))


@query(f"""WITH {BASE}, p AS (SELECT doc_id AS docid, CASE WHEN doc_id % 2 = 0 THEN 'Title: ' || coalesce(source, '') || ' Content: ' || coalesce(text, '') ELSE coalesce(text, '') END AS c FROM documents)
SELECT qid, docid, rank, score, trim(regexp_replace(c, '\\s+', ' ', 'g')) AS content FROM runs JOIN p USING (docid) WHERE list_id = 0 AND rank <= 10""")
def retrieved_passages(spark, d):
    t = read(spark, d, "documents").select(F.col("doc_id").alias("docid"), F.when(F.col("doc_id") % 2 == 0, F.coalesce("source", F.lit(""))).alias("title"), "text")
    return search.with_passages(kept(one_run(spark, d, 10)), t, 10)


@query(f"""WITH {UNIT}, l AS (SELECT list_id, qid::VARCHAR AS qid, docid::VARCHAR AS docid, score FROM unit), a AS (SELECT * FROM l WHERE list_id = 0), b AS (SELECT * FROM l WHERE list_id = 1), f AS ({pair_sql('a', 'b', 0.1)}) SELECT qid, docid, score, rank FROM f""")
def fuse_files(spark, d, k=DEPTH):
    """Two run files to a third."""
    r, folder = kept(runs(spark, d, 2, k)), scratch_path(spark)
    for i in (0, 1):
        trec.write_run(r.filter(F.col("list_id") == i), f"{folder}/{i}", "t")
    return search.fused_files(spark, f"{folder}/0", f"{folder}/1", f"{folder}/out", 0.1, k, "min-max").select("qid", "docid", "score", "rank")


@query((f"WITH {TUNE}, {objective_sql('cells', 'trials', 3, 'everyone')} SELECT grp, trial, w, objective FROM obj").replace("rr + coalesce(dcg / nullif(idcg_3, 0), 0) + coalesce(h10 / nullif(num_rel, 0), 0) + coalesce(h100 / nullif(num_rel, 0), 0)", "coalesce(dcg / nullif(idcg_3, 0), 0)"))
def tune_one_measure(spark, d, k=DEPTH):
    everyone = items(spark, d).select("qid", F.lit("all").alias("grp"))
    return tuning.supervised(unit_runs(spark, d, k=k), qrels(spark, d), everyone, 3, tuning.grid(3, STEPS), ("ndcg@3",))


@query(f"""WITH {TUNE}, {objective_sql('cells', 'trials', 3, 'groups')}, bw AS (SELECT qid, l.i - 1 AS list_id, w[l.i] AS weight FROM groups JOIN best USING (grp), range(1, 4) l(i)), f AS ({combination_sql('bw')}), {per_query_sql('f')}
SELECT grp, any_value(trial) AS trial, count(*) AS n_queries, round(avg(map), 6) AS map, round(avg(ndcg_cut_3), 6) AS ndcg_cut_3, round(avg(recall_50), 6) AS recall_50 FROM m JOIN groups USING (qid) JOIN best USING (grp) GROUP BY grp""")
def tuned_measures(spark, d, k=DEPTH):
    """What each level's chosen weights reach."""
    groups, r, judged = levels(spark, d).withColumnRenamed("level", "grp"), kept(unit_runs(spark, d, k=k)), qrels(spark, d)
    chosen = tuning.best(tuning.supervised(r, judged, groups, 3, tuning.grid(3, STEPS)), ["grp"])
    return tuning.measured(r, judged, chosen, groups, k).select("grp", "trial", "n_queries", "map", "ndcg_cut_3", "recall_50")


PROMPT = """prompts AS (SELECT conv_id || '-' || turn AS turn_id, 'Rewrite the last turn.' || chr(10) || chr(10) || CASE WHEN len(c) > 0 THEN 'Conversation:' || chr(10) || array_to_string(c, chr(10)) || chr(10) || chr(10) ELSE '' END || 'Current turn: ' || text AS prompt
FROM (SELECT conv_id, turn, text, coalesce(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS c FROM conversations WHERE role = 'user'))"""


@query(f"""WITH {PROMPT}, ok AS (SELECT turn_id, length(prompt) AS n FROM prompts WHERE length(prompt) % 4 <> 0)
SELECT turn_id, name, CASE WHEN ok.turn_id IS NULL THEN 'old' WHEN name = 'x_rw' THEN 'short ' || n ELSE 'long ' || n END AS query FROM prompts LEFT JOIN ok USING (turn_id), (VALUES ('x_rw'), ('x_rs')) s(name) WHERE ok.turn_id IS NOT NULL OR name = 'x_rw'""")
def rewrite_turns(spark, d):
    """Prompt, a stand-in for a model, parser, upsert; answers that break the contract leave what was there."""
    t = conversation.with_context(talk(spark, d).filter("role = 'user'"), "conv_id", "turn", "text")
    old = t.select("turn_id", F.lit("x_rw").alias("name"), F.lit("old").alias("query"), F.lit(0).alias("seq"))
    model = lambda prompts: [f"Rewrite: short {len(p)}\nResponse: long {len(p)}" if len(p) % 4 else "Sorry." for p in prompts]
    return generation.rewritten(t, parsing.prompt("Rewrite the last turn.", F.col("text"), F.col("context")), model, parsing.parse_rewrite_response, "x", old).select("turn_id", "name", "query")


@query(f"""WITH {BASE}, top AS (SELECT qid, string_agg(rank || '. ' || coalesce(text, ''), chr(10) ORDER BY rank) AS found FROM runs JOIN documents ON doc_id = docid WHERE list_id = 0 AND rank <= 3 GROUP BY qid),
p AS (SELECT qid, length('Passages:' || chr(10) || found || chr(10) || chr(10) || 'Answer.' || chr(10) || chr(10) || 'Profile:' || chr(10) || '1. likes lists' || chr(10) || chr(10) || 'Current turn: ' || text) AS n FROM top JOIN items USING (qid))
SELECT qid, CASE WHEN n % 3 > 0 THEN n::VARCHAR END AS response FROM p""")
def generate_responses(spark, d):
    i = items(spark, d)
    t = i.select("qid", F.array().cast("array<string>").alias("context"), F.array(F.lit("likes lists")).alias("profile"))
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("docid"), F.coalesce("text", F.lit("")).alias("contents"))
    model = lambda prompts: [f"Response: {len(p)}" if len(p) % 3 else "I cannot." for p in prompts]
    return generation.responses(t, i.select("qid", F.col("text").alias("generation")), kept(one_run(spark, d, 10)), docs, model, 3, instruction="Answer.")


@query(f"""WITH {PARTS} SELECT qid, a AS whole, a || '|' || b || '|' AS lines, CASE WHEN qid % 3 <> 0 THEN b END AS rewrite, CASE WHEN qid % 3 <> 0 THEN a || chr(10) || 'Reason: ' || level END AS response, CASE WHEN qid % 3 <> 0 THEN a END AS cot,
  CASE WHEN qid % 3 <> 0 THEN 'so ' || b END AS plain FROM p""")
def parse_plain(spark, d):
    """Answers that are text, lines, or an expansion with its reasons in the last line."""
    reason = F.when(F.pmod("qid", F.lit(3)) != 0, F.concat(F.lit("\nReason: "), "level")).otherwise(F.lit("\nno reason"))
    reasoned = F.concat(F.lit("Rewrite: "), "a", F.lit("hence "), "b", F.lit("\nResponse: "), "a", reason, F.lit("\n "))
    plain = F.concat(F.lit("Rewrite: so "), "b", F.lit("\nResponse: "), "a", reason)
    x, y = parsing.parse_expansion(reasoned, "hence "), parsing.parse_expansion(plain)
    return parts(spark, d).select("qid", parsing.parse_text(F.concat(F.lit(" \n"), "a", F.lit(" "))).alias("whole"), F.array_join(parsing.parse_lines(F.concat(F.lit(" "), "a", F.lit("  \n "), "b", F.lit(" \n."))), "|").alias("lines"), x.alias("x"), y.alias("y")).select("qid", "whole", F.regexp_replace("lines", r"\.$", "").alias("lines"), "x.rewrite", "x.response", "x.cot", F.col("y.rewrite").alias("plain"))


@query("""WITH c AS (SELECT conv_id, turn, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS words, coalesce(list(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS past FROM conversations),
s AS (SELECT conv_id, turn, text, past, words[1:8] AS own, list_reverse(list_transform(range(1, len(past) + 1), lambda i: past[i][1:(CASE WHEN i % 2 = 0 THEN 16 ELSE 8 END)])) AS parts FROM c),
p AS (SELECT *, list_transform(range(1, len(parts) + 1), lambda i: len(own) + coalesce(list_sum(list_transform(parts[1:i], lambda x: len(x))), 0)) AS ends FROM s),
k AS (SELECT *, len(list_filter(ends, lambda e: e <= 40)) AS whole FROM p),
f AS (SELECT *, len(own) + coalesce(list_sum(list_transform(parts[1:whole], lambda x: len(x))), 0) AS used, parts[(whole + 1)::BIGINT] AS cutpart FROM k)
SELECT conv_id, turn, array_to_string(list_concat(list_concat(own, flatten(parts[1:whole])), CASE WHEN cutpart IS NULL OR used >= 40 THEN [] ELSE list_concat(cutpart[1:(39 - used)::BIGINT], cutpart[len(cutpart):]) END), ' ') AS flat,
  '[Current question]: ' || text || CASE WHEN len(past) > 0 THEN ' [Context]: ' || array_to_string(list_transform(list_reverse(past), lambda x: array_to_string(x, ' ')), ' ') ELSE '' END AS labelled FROM f""")
def flatten_variants(spark, d):
    t = talk(spark, d).withColumn("words", text.terms(F.col("text")))
    t = conversation.with_context(t, "conv_id", "turn", "words")
    return t.select("conv_id", "turn", F.array_join(flattening.turn_text(F.col("words"), F.col("context"), 40, 8, 16), " ").alias("flat"), flattening.labelled(F.col("text"), F.transform("context", lambda x: F.array_join(x, " "))).alias("labelled"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE role END AS chosen, CASE WHEN turn % 3 = 0 THEN role ELSE text END AS filled, role || ' ' || text AS both, len(string_split(role || ' [SEP] ' || text, ' [SEP] ')) AS n_parts FROM conversations WHERE turn > 0""")
def field_choice(spark, d):
    t = talk(spark, d).withColumn("query", F.when(F.col("turn") % 2 == 0, F.col("text"))).withColumn("context_query", F.array(F.when(F.col("turn") % 2 == 1, F.col("role")))).withColumn("pos_docs", F.when(F.col("turn") > 0, F.array("turn")))
    t = flattening.with_positives(t, "pos_docs")
    return t.select("conv_id", "turn", flattening.first_field(t, ["absent", "context_query", "query"]).alias("chosen"), flattening.text_or(F.when(F.col("turn") % 3 != 0, F.col("text")).otherwise(""), F.col("role")).alias("filled"), flattening.rewrite_and_answer(F.col("role"), F.col("text")).alias("both"), F.size(flattening.split_context(F.concat("role", F.lit(" [SEP] "), "text"))).cast("long").alias("n_parts"))


@query("""WITH t AS (SELECT vec_id, list_transform(range(4), lambda i: embedding[i * 16 + 1:i * 16 + 16]::DOUBLE[]) AS r FROM embeddings),
c AS (SELECT vec_id, r, i, list_inner_product(r[1], r[i]) / (sqrt(list_inner_product(r[1], r[1])) * sqrt(list_inner_product(r[i], r[i]))) AS s FROM t, range(2, 5) x(i)),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) <= 2)
SELECT vec_id, round((any_value(r)[2][1] + any_value(r)[3][1]) / 2, 6) AS mean_1, round(any_value(r)[1][1], 6) AS first_1, string_agg((i - 1)::VARCHAR, ',' ORDER BY i) AS kept FROM b GROUP BY vec_id""")
def token_pooling(spark, d):
    rows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, F.lit(16)))
    t = read(spark, d, "embeddings").select("vec_id", rows.alias("r"))
    like = vectors.denoised(F.col("r"), 2)
    places = F.transform(like, lambda x: F.array_position("r", x) - 1)
    return t.select("vec_id", settled(F.get(vectors.mean_pooled(F.col("r"), F.array(*map(F.lit, (1, 1, 1, 0))), 1), F.lit(0))).alias("mean_1"), settled(F.get(vectors.first_pooled(F.col("r")), F.lit(0)).cast("double")).alias("first_1"), F.array_join(F.transform(places, lambda x: x.cast("string")), ",").alias("kept"))


@query("""WITH t AS (SELECT vec_id, list_transform(range(4), lambda i: embedding[i * 16 + 1:i * 16 + 16]::DOUBLE[]) AS r FROM embeddings),
f AS (SELECT vec_id, r, list_min(list_filter([1, 2, 3], lambda i: list_position(r[i], list_max(r[i])) <= 4)) AS p FROM t),
u AS (SELECT vec_id, v.i, r[p + 1][v.i] AS logit, CASE WHEN v.i <= 4 THEN ':' ELSE 't' || (v.i - 1) END AS token FROM f, range(1, 17) v(i) WHERE p IS NOT NULL)
SELECT vec_id, token, round(logit, 6) AS logit, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC)::INT - 1 AS place FROM u QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC) <= 3""")
def expansion_terms(spark, d):
    """The best tokens after the first position whose best token is the mark, which the first four of sixteen tokens are here."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, F.lit(16)).cast("array<double>"))
    words = F.array(*(F.lit(" :" if i < 4 else f"t{i} ") for i in range(16)))
    t = read(spark, d, "embeddings").select("vec_id", rows.alias("r")).withColumn("r", F.slice("r", 1, 4))
    last = F.transform(F.slice("r", 4, 1), lambda x: F.transform(x, lambda y, i: F.when(i < 4, F.lit(-1e9)).otherwise(y)))  # the last position is no mark
    found = parsing.expansion_terms(F.concat(F.slice("r", 1, 3), F.slice("r", 4, 1)), words, 3)
    ok = F.exists(F.slice("r", 1, 3), lambda x: F.array_position(x, F.array_max(x)) <= 4)
    return t.filter(ok).select("vec_id", F.posexplode(found).alias("place", "x")).select("vec_id", F.col("x.token").alias("token"), settled(F.col("x.logit")).alias("logit"), "place")


@query(f"WITH {CORPUS}, {QUERY3} SELECT qid, term, qtf FROM qw SEMI JOIN dfs USING (term) WHERE list_id = 0")
def vocabulary_filter(spark, d):
    q = lexical.query_terms(items(spark, d), ["qid"])
    return text.known_words(q, "term", index(spark, d).terms, "term")


@query("""SELECT '--model ' || m || ' --list ' || l || ' --k ' || CASE WHEN m = 'BM25' THEN '1000' ELSE '500' END || ' --weights 0.1 0.4 --rerank' AS line FROM (VALUES ('BM25'), ('dense')) a(m), (VALUES ('rw'), ('raw')) b(l)""")
def experiment_flags(spark, d):
    """Each combination's command line, made by the runner."""
    config = {"iterate": {"model": ["BM25", "dense"], "list": ["rw", "raw"]}, "param_mapping": {"model": {"BM25": {"k": 1000}}}, "fixed": {"k": 500, "weights": [0.1, 0.4], "rerank": True, "save": False}}
    order = ["model", "list", "k", "weights", "rerank", "save"]
    done = experiments.run_all(config, lambda c: " ".join(experiments.flags({k: c[k] for k in order})))
    return spark.createDataFrame([(line,) for _, line in done], "line string")


# ---- measures, fusion and tuning over whole runs ----


def whole(name: str) -> None:
    """Register name_1000: the query and its SQL over lists of FULL passages."""
    f = QUERIES[name]
    QUERIES[f"{name}_{FULL}"] = lambda spark, d: f(spark, d, k=FULL)
    SQL[f"{name}_{FULL}"] = SQL[name].replace(f"WHERE rank <= {DEPTH})", f"WHERE rank <= {FULL})")


WHOLE = """norm_minmax norm_max fuse_linear_weighted fuse_linear_fold3 fuse_linear_comb fuse_per_level fuse_rrf fuse_concat fuse_round_robin_short
tune_global tune_by_level tune_2plus1 tune_retrieval_score metrics_per_query metrics_mean metrics_by_level latex_row legacy_hit_rates
rerank_rescore tune_by_level_fine metrics_trec_ties bm25_topk rm3_topk top_p queries_lacking metrics_sink search_end_to_end fuse_files tune_one_measure"""
for _name in WHOLE.split():
    whole(_name)
