"""Conversation prefix trie: partial tries that are merged by the hash of a prefix, and sums that roll up from the leaves."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch, split_join, table

#: Turns of a conversation, and ids of conversations, that one group holds at most (as powers of 2).
BLOCK_BITS, ID_BITS = 10, 12
#: A prefix's key: two 64-bit hashes.
KEY = ["k1", "k2"]
PARENT = ["p1", "p2"]


def running(rows: DataFrame, key: str, place: Column, sums: dict[str, tuple]) -> DataFrame:
    """Add to rows, for each name of sums (column, aggregate), the aggregate of the column over the rows of the same key up to
    this place. place is a whole number, one a row and key. Places are dealt to blocks of 2 ** BLOCK_BITS, within which sums
    run, and the blocks before a block add their totals; so no task holds a whole key."""
    rows = rows.withColumns({"_at": place, "_block": F.shiftright(place, BLOCK_BITS)})
    within = W.partitionBy(key, "_block").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumns({name: agg(c).over(within) for name, (c, agg, _) in sums.items()})
    totals = rows.groupBy(key, "_block").agg(*(agg(c).alias(f"_t_{name}") for name, (c, agg, _) in sums.items()))
    before = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(key, "_block", *(agg(f"_t_{name}").over(before).alias(f"_b_{name}") for name, (_, agg, _) in sums.items()))
    totals = totals.filter(F.greatest(*(F.col(f"_b_{name}").isNotNull() for name in sums)))
    out = out.join(totals, [key, "_block"], "left")
    joined = {name: F.when(F.col(f"_b_{name}").isNull(), F.col(name)).otherwise(both(F.col(name), F.col(f"_b_{name}"))) for name, (_, _, both) in sums.items()}
    return out.withColumns(joined).drop("_at", "_block", *(f"_b_{name}" for name in sums))


def numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, pos, a, b, words of flat rows (conv_id, turn, role, text): a turn's place from 0 by turn (null first; ties by
    hash), two hashes of role and text, and the text's words. Texts go no further. Rows of a null conv_id are left out.

    All rows are dealt by ranges of (conv_id, turn, hash), however many one conversation has, and numbered within a
    range. Only conversations that lie in several ranges, two a range at most, need to know what is in those before.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = rows.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b")).alias("at"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    ranged = scratch.cut(slim.repartitionByRange("conv_id", "at").withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("first", "part").rowsBetween(W.unboundedPreceding, -1))
    carried = parts.withColumn("_before", before).filter("_before is not null").select("conv_id", "part", "_before")
    local = F.row_number().over(W.partitionBy("conv_id", "part").orderBy("at")) - 1
    out = ranged.withColumn("_local", local).join(carried, ["conv_id", "part"], "left")
    out = out.select("conv_id", (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("long").alias("pos"), F.col("at.a").alias("a"), F.col("at.b").alias("b"), "words")
    out = scratch.cut(out)
    scratch.drop(ranged)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations of the contract's query, from numbered turns: conversation c is the first h turns of c - c % 20 and its
    own after the first h, h = crc32(c) % 4. Returns (conv_id, pos, a, b, words) and (conv_id, length), also of length 0."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)).cast("long")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % 20
    bases = sizes.filter("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = sizes.withColumns({"h": h, "base": base}).join(bases, "base", "left").withColumn("lead", F.least("h", F.coalesce("n_base", F.lit(0))))
    heads = turns.filter("pos < 3 and conv_id % 20 = 0").select(F.col("conv_id").alias("base"), "pos", "a", "b", "words")
    led = convs.select("conv_id", "base", "lead").join(heads, "base").filter("pos < lead").select("conv_id", "pos", "a", "b", "words")
    own = split_join(turns, convs.select("conv_id", "h", "lead"), ["conv_id"]).filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "a", "b", "words")
    length = (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")
    return led.unionByName(own), convs.select("conv_id", length)


def digest_of_lists(batches):
    """Rows (k1, k2, bucket, ids), sorted, of one task -> the sha256 of each key's ids, which are never held together."""
    now, sha, out = None, None, ([], [], [])

    def close():
        if now is not None:
            for column, x in zip(out, (*now, sha.hexdigest())):
                column.append(x)

    for batch in batches:
        for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
            if (k1, k2) != now:
                close()
                now, sha = (k1, k2), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["k1", "k2", "ends_sha256"])
        out = ([], [], [])
    close()
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["k1", "k2", "ends_sha256"])


def trie(turns: DataFrame, conversations: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The nodes of the prefix trie of turns (conv_id, pos, a, b, words; pos from 0 without gaps) of conversations (conv_id,
    length): conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    1. A prefix's key is the exclusive or of its turns' hashes, each with its place, which blocks of a conversation compute
       apart. A conversation so has a row for each node on its path.
    2. Partial tries: tasks combine the rows they have; then partial tries of 4096 consecutive ids merge by key, members
       summed and the smallest kept, their end lists as sorted text; then these merge by key. A node's end lists are
       digested in order of ids, without being brought together.
    3. Rollup: nodes of one smallest member are a chain down its path, as a smallest member stays the smallest below. Leaves
       and saved tokens are summed up along each chain, and a chain's total is added to every node above its top, which
       are the rest of its conversation's path. So the number of exchanges doesn't depend on depth.

    No conversations give no nodes; conv_id isn't null; other columns are ignored.
    """
    scratch = scratch or Scratch(turns.sparkSession)
    t = turns.withColumns({"x1": F.xxhash64("pos", "a", "b"), "x2": F.xxhash64(F.lit(1), "pos", "a", "b")})
    xor = lambda a, b: a.bitwiseXOR(b)
    t = running(t, "conv_id", F.col("pos"), {"k1": ("x1", F.bit_xor, xor), "k2": ("x2", F.bit_xor, xor)})
    depth = (F.col("pos") + 1).alias("depth")
    above = [F.col(k).bitwiseXOR(F.col(x)).alias(p) for k, x, p in zip(KEY, ("x1", "x2"), PARENT)]
    none = F.lit(0).cast("long")
    roots = conversations.select("conv_id", none.alias("depth"), none.alias("k1"), none.alias("k2"), *(F.lit(None).cast("long").alias(p) for p in PARENT), none.alias("words"))
    paths = scratch.cut(t.select("conv_id", depth, *KEY, *above, "words").unionByName(roots))

    bucket = F.shiftright("conv_id", ID_BITS).alias("bucket")
    same = ["depth", *PARENT, "words"]
    part = paths.groupBy(*KEY, bucket).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.first(c).alias(c) for c in same))
    nodes = part.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), *(F.first(c).alias(c) for c in same))
    nodes = scratch.cut(nodes)
    children = nodes.filter("p1 is not null").groupBy(*PARENT).agg(F.count("*").alias("n_children")).select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children")
    own = nodes.join(children, KEY, "left").select(*KEY, *PARENT, "conv_id", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("n_children").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    own = scratch.cut(own)
    scratch.drop(nodes)

    last = split_join(paths.select("conv_id", "depth", *KEY), conversations.select("conv_id", "length"), ["conv_id"]).filter("depth = length")
    lists = last.groupBy(*KEY, bucket).agg(F.array_sort(F.collect_list("conv_id")).alias("ids")).select(*KEY, "bucket", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    ends = lists.repartition(*KEY).sortWithinPartitions(*KEY, "bucket").mapInArrow(digest_of_lists, "k1 long, k2 long, ends_sha256 string")

    chains = own.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    sent = split_join(paths.select("conv_id", "depth", *KEY), chains, ["conv_id"]).filter("depth < top")
    below = sent.groupBy(*KEY).agg(F.sum("leaves").alias("leaves_below"), F.sum("saved").alias("saved_below"))
    plus = lambda a, b: a + b
    out = running(own, "conv_id", -F.col("depth"), {"up_leaves": ("leaf", F.sum, plus), "up_saved": ("saved", F.sum, plus)})
    out = out.join(below, KEY, "left").join(ends, KEY, "left")
    parents = own.select(*(F.col(k).alias(p) for k, p in zip(KEY, PARENT)), F.col("conv_id").alias("parent_conv_id"))
    out = split_join(out, parents, PARENT, "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    with_below = lambda up, more: (F.col(up) + F.coalesce(more, F.lit(0))).cast("long")
    return out.select("conv_id", "depth", "parent_conv_id", F.col("n_convs").cast("long").alias("n_convs"), "n_children", with_below("up_leaves", "leaves_below").alias("n_leaves"), with_below("up_saved", "saved_below").alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt so that those of twenty neighbours begin alike.

    Null roles and texts are empty, null turns come first and ties go by a hash of role and text; rows of a null conv_id are
    left out; repeated rows are turns of their own; no rows give no nodes; other columns are ignored.
    """
    scratch = Scratch(spark)
    turns, conversations = rebuilt(numbered(table(spark, sf_dir, "conversations"), scratch))
    return trie(turns, conversations, scratch)


#: crc32 has no name in DuckDB: the register is shifted for the eight bits of each digit.
OP12_SQL = r"""
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda r, y: list_reduce(list_concat([xor(r, y)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda s, z: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END)), 4294967295) AS v FROM ids),
own AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
re AS (SELECT own.c, list_concat(coalesce(b.l[1:(v % 4)::INT], []), own.l[(v % 4 + 1)::INT:]) AS l FROM own JOIN crc USING (c) LEFT JOIN own b ON b.c = own.c - own.c % 20),
paths AS (SELECT c, d, l[1:d] AS p, len(l) = d AS ends, CASE WHEN d > 0 THEN len(regexp_extract_all(l[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS w FROM (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM re)),
nodes AS (SELECT p, d, min(c) AS c, count(*) AS n, any_value(w) AS w, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS e FROM paths GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids USING (p)),
up AS (SELECT p[1:a] AS p, sum((k = 0)::INT) AS leaves, sum((n - 1) * w) AS saved FROM (SELECT *, unnest(range(d + 1)) AS a FROM full_nodes) GROUP BY 1)
SELECT f.c AS conv_id, f.d AS depth, q.c AS parent_conv_id, f.n AS n_convs, f.k AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, f.e AS ends_sha256
FROM full_nodes f JOIN up USING (p) LEFT JOIN nodes q ON f.d > 0 AND q.d = f.d - 1 AND q.p = f.p[1:f.d - 1]
"""
