"""Conversations: turn identifiers, context, query resolution, upserts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import copies_for_weight


def turn_order(turn_id: Column) -> Column:
    """The number after the last hyphen."""
    return F.element_at(F.split(turn_id, "-"), -1).cast("int")


def conversation_of(turn_id: Column) -> Column:
    return F.regexp_replace(turn_id, "-[^-]*$", "")


def submission_id(turn_id: Column) -> Column:
    return F.concat_ws("_", conversation_of(turn_id), F.element_at(F.split(turn_id, "-"), -1))


def with_context(turns: DataFrame, conversation: str, order: str, text: str) -> DataFrame:
    """Add context: the texts of earlier turns of the conversation, oldest first."""
    w = W.partitionBy(conversation).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return turns.withColumn("context", F.collect_list(text).over(w))


def context_by_join(turns: DataFrame, conversation: str, order: str, text: str) -> DataFrame:
    """The same by a join on the conversation with earlier turns; turns without any have an empty context."""
    now = turns.select(conversation, order)
    past = turns.select(conversation, F.col(order).alias("_order"), F.col(text).alias("_text"))
    found = now.join(past, conversation).filter(F.col("_order") < F.col(order)).groupBy(conversation, order).agg(F.array_sort(F.collect_list(F.struct("_order", "_text"))).alias("_past"))
    return turns.join(found, [conversation, order], "left").withColumn("context", F.coalesce(F.transform("_past", lambda x: x["_text"]), F.array().cast("array<string>"))).drop("_past")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and new rows, of which new ones replace old ones of equal keys; among equal new rows that of the last seq."""
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    order = W.partitionBy(*keys).orderBy(F.col("_gen").desc(), F.col("seq").desc())
    return both.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_gen")


def named(reformulations: DataFrame) -> DataFrame:
    """turn_id, queries: a map of name to text."""
    return reformulations.groupBy("turn_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "query"))).alias("queries"))


def resolve(kind: str, nb_terms: int = 10, w: float = 0.0) -> Column:
    """The query text of one kind, over columns current, oracle, queries (map) and provenance (array). Rules in order:
    none, raw, oracle; parts joined by +; fusion; choice by manual provenance; expansion terms; rewrite with response;
    a reformulation by name. A kind that lacks its rewrite or response is null."""
    queries = F.col("queries")
    part = lambda name: F.try_element_at(queries, F.lit(name))
    n = copies_for_weight(w)
    if kind == "none":
        return F.lit("")
    if kind in ("raw", "oracle"):
        return F.col("current" if kind == "raw" else "oracle")
    if "+" in kind:
        return F.concat_ws(" ", *(resolve(x, nb_terms, 0.0) for x in kind.split("+")))
    if "fuse" in kind:
        return F.lit("ranking list fusion, no query needed")
    if "alter_selon_manual_ptkb" in kind:
        with_profile = resolve("gpt-4o_judge_and_rewrite_rwrs" if "rs" in kind else "gpt-4o_judge_and_rewrite_rw", nb_terms, 0.0)
        return F.when(F.size("provenance") > 0, with_profile).otherwise(resolve("gpt-4o_rar_rw", nb_terms, w))
    if "llm_rm" in kind:
        words = F.slice(F.array_distinct(F.split(F.lower(part(kind)), " ")), 1, nb_terms)
        return F.concat(F.repeat(part(kind.split("_")[0]), F.lit(n)), F.array_join(words, " "))
    if "rwrs" in kind:
        return F.concat(F.array_join(F.array_repeat(part(f"{kind[:-5]}_rw"), n), " "), F.lit(" "), part(f"{kind[:-5]}_rs"))
    return F.coalesce(part(kind), F.lit(""))


def level_of(level_type: str) -> Column:
    """First letter of the reformulation <level_type>_lv, null unless a to d."""
    level = F.substring(F.try_element_at(F.col("queries"), F.lit(f"{level_type}_lv")), 1, 1)
    return F.when(level.rlike("^[a-d]$"), level)


def better_rewrite(results: DataFrame, a: str, b: str, metric: str) -> DataFrame:
    """turn_id, a_wins: whether result a reaches at least b's value of the metric. results: turn_id, name, metrics (map)."""
    pick = lambda name, to: results.filter(F.col("name") == name).select("turn_id", F.try_element_at("metrics", F.lit(metric)).alias(to))
    return pick(a, "_a").join(pick(b, "_b"), "turn_id").select("turn_id", (F.col("_a") >= F.col("_b")).alias("a_wins"))


def evaluated(turns: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """The turns whose turn_id is among ids: a table (turn_id) of any size, or a short list."""
    if isinstance(ids, list):
        return turns.filter(F.col("turn_id").isin(ids))
    return turns.join(ids.select("turn_id").distinct(), "turn_id", "left_semi")


def of_level(turns: DataFrame, level: str) -> DataFrame:
    """The turns (with a column level) of one personalization level; "all" keeps every turn."""
    return turns if level == "all" else turns.filter(F.col("level") == level)


def level_counts(levels: DataFrame) -> DataFrame:
    """level, n_queries of (qid, level)."""
    return levels.groupBy("level").agg(F.count("*").alias("n_queries"))


def sole(entries: Column, matches, what: str) -> Column:
    """The one entry of an array that matches; null if there is none. It raises if there are several."""
    found = F.filter(entries, matches)
    return F.when(F.size(found) > 1, F.raise_error(F.lit(f"several of {what}"))).otherwise(F.get(found, F.lit(0)))


def reformulation(name: str) -> Column:
    """The entry of column reformulations with that name; null without one, and it raises if there are several."""
    return sole(F.col("reformulations"), lambda x: x["reformulation_name"] == name, f"reformulation {name}")


#: The fields that tell a turn's results apart.
RESULT_KEY = ("collection", "retrieval_model", "reranker", "generation_model", "retrieval_query_type", "reranking_query_type", "generation_query_type")


def result(key: dict[str, str]) -> Column:
    """The entry of column results with these values of RESULT_KEY; null without one, and it raises if there are several."""

    def matches(x: Column) -> Column:
        return reduce(and_, (x[c].eqNullSafe(F.lit(key.get(c))) for c in RESULT_KEY))

    return sole(F.col("results"), matches, "results of one key")


def provenance_of(name: str) -> Column:
    """ptkb_provenance of the reformulation of that name; it raises if there is none."""
    r = reformulation(name)
    return F.when(r.isNull(), F.raise_error(F.lit(f"no reformulation {name}"))).otherwise(r["ptkb_provenance"])


def turn_of(turns: DataFrame, qids: DataFrame, order: str | None = None) -> DataFrame:
    """qid and the columns of its turn, for every row of qids (qid); it raises for a qid that no turn has, whichever columns
    are read. Of several turns of one id the first by `order` (a column) is taken, without one the first by turn_id's
    whole row."""
    columns = turns.columns
    row = F.struct(*columns)
    key = F.col(order) if order else F.xxhash64(*[f.name for f in turns.schema if "map<" not in f.dataType.simpleString()])
    first = turns.groupBy(F.col("turn_id").cast("string").alias("_turn")).agg(F.min_by(row, key).alias("_row"))
    found = qids.select(F.col("qid").cast("string").alias("qid")).join(first, F.col("qid") == F.col("_turn"), "left")
    known = F.when(F.col("_turn").isNull(), F.raise_error(F.concat(F.lit("no turn "), F.coalesce("qid", F.lit("null"))))).otherwise(F.lit(True))
    return found.filter(known.cast("boolean")).select("qid", *(F.col("_row")[c].alias(c) for c in columns if c != "qid"))


def with_results(turns: DataFrame, results: DataFrame) -> DataFrame:
    """turns whose column results holds the entries of results (turn_id and RESULT_KEY, metrics, response), one a key: a new
    entry replaces an old one of its key, where it stands, and others follow in order of their keys. Of several new
    entries of a turn and key the greatest by response stays."""
    fields = [*RESULT_KEY, "metrics", "response"]
    new = results.groupBy("turn_id", *RESULT_KEY).agg(F.max_by("metrics", F.coalesce("response", F.lit(""))).alias("metrics"), F.max("response").alias("response"))
    # maps have no order, so entries are sorted by their key and carried with it
    entry = F.struct(F.struct(*RESULT_KEY).alias("k"), F.struct(*fields).alias("v"))
    by_key = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    new = new.groupBy("turn_id").agg(F.transform(F.array_sort(F.collect_list(entry), by_key), lambda x: x["v"]).alias("_new"))
    same = lambda a, b: reduce(and_, (a[c].eqNullSafe(b[c]) for c in RESULT_KEY))
    old = F.coalesce("results", F.array().cast(turns.schema["results"].dataType))
    fresh = F.coalesce("_new", F.array().cast(turns.schema["results"].dataType))
    put = F.transform(old, lambda x: F.coalesce(F.get(F.filter(fresh, lambda y: same(x, y)), F.lit(0)), x))
    rest = F.filter(fresh, lambda y: ~F.exists(old, lambda x: same(x, y)))
    return turns.join(new, "turn_id", "left").withColumn("results", F.concat(put, rest)).drop("_new")
