"""Document fingerprints by SpotSigs: chains of content words that follow common words. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: Very common words of the languages looked at; a chain starts after each of their occurrences.
ANCHORS = (
    "a an the of to in and is was for that it on with as by at from this be are or have not "
    "le la les un une des du de et est que qui dans pour pas sur au avec ce il elle "
    "der die das ein eine und ist von zu den mit sich auf für nicht als im dem des auch "
    "el los las una y es en por con para no su al lo se del"
).split()
#: Content words of a chain.
CHAIN = 3
MARK = "\u0001"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spots(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """Sorted distinct 32-bit signatures of a text. Common words are replaced by a mark on the content word that
    follows; each marked word opens a chain, and so does every word with no mark on it or on the chain - 1 words before it,
    which no marked chain holds. What opens a chain depends on these few words only, so one more common word changes
    the chains around it and no others. The mark itself, U+0001, counts as white space where a text has it. A text without
    a word has the signature of the text itself."""
    words = "|".join(sorted(set(anchors)))
    marked = F.regexp_replace(F.translate(F.lower(text), MARK, " "), rf"(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])[^\p{{L}}\p{{N}}]*", MARK)
    pieces = F.filter(F.split(marked, rf"[^\p{{L}}\p{{N}}{MARK}]+"), lambda w: F.length(F.translate(w, MARK, "")) > 0)

    def chains(w: Column) -> Column:
        plain = F.transform(w, lambda x: F.translate(x, MARK, ""))
        marked_ = lambda r, k: r[f"w{k}"].startswith(MARK)

        def signed(p: Column) -> Column:
            before = (F.concat(F.array_repeat(F.lit(""), k), w).alias(f"w{k}") for k in range(chain))
            rows = F.arrays_zip(*before, *(F.slice(p, k + 1, F.greatest(F.size(p) - k, F.lit(0))).alias(f"c{k}") for k in range(chain)))
            field = [f"c{k}" for k in range(chain)]
            near = lambda r: reduce(or_, (marked_(r, k) for k in range(1, chain)), F.lit(False))
            return F.transform(F.filter(rows, lambda r: r["w0"].isNotNull() & (marked_(r, 0) | ~near(r))), lambda r: F.hash(*(F.coalesce(r[f], F.lit("")) for f in field)))

        return let(plain, signed)

    found = F.array_sort(F.array_distinct(let(pieces, chains)))
    own = F.array(F.hash(text))
    return let(found, lambda s: F.when(F.size(s) > 0, s).otherwise(own))


def as_hex(spots: Column) -> Column:
    """Eight digits for each signature."""
    return F.array_join(F.transform(spots, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Of two signature arrays. Lengths bound it from above by min/max: pairs whose bound is under `least` get 0 unread."""
    bound = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b), F.lit(1))
    both = F.size(F.array_intersect(a, b))
    return F.when(bound < least, 0.0).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def length_class(size: Column, similarity: float) -> Column:
    """Sets at this similarity or more lie in one length class or in neighbouring ones."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / -F.log(F.lit(similarity))).cast("int")


def memberships(prints: DataFrame) -> DataFrame:
    """doc_id, same_as of rows of prints (doc_id, spots): the least doc_id with equal signatures."""
    sets = prints.groupBy("spots").agg(F.min("doc_id").alias("same_as"))
    return prints.join(sets, "spots").select("doc_id", "same_as")


def candidates(prints: DataFrame, similarity: float = 0.75) -> DataFrame:
    """Pairs (a, b, likeness) of rows of prints (doc_id, spots) whose signatures have at least this Jaccard similarity.

    Partitioned by set length: a row is posted under its length class with the rarest of its signatures, as many as two
    similar sets cannot all lack, and looked up there from its own class and the next. Equal sets meet as one row of
    the least doc_id (see memberships). Pairs are then compared whole, those whose lengths rule them out unread.
    A signature in very many prefixes still pairs all that hold it: use it on sets whose rare signatures are rare.
    """
    sets = prints.groupBy("spots").agg(F.min("doc_id").alias("doc_id"))
    sets = sets.withColumn("class", length_class(F.size("spots"), similarity))
    posts = sets.select("doc_id", "class", F.size("spots").alias("n"), F.explode("spots").alias("spot"))
    df = posts.groupBy("spot").agg(F.count("*").alias("df"))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("df", "spot"))
    posts = posts.join(df, "spot").withColumn("rank", rank)
    # the prefix: of n sorted signatures the first n - ceil(similarity * n) + 1
    posts = posts.filter((F.col("df") > 1) & (F.col("rank") <= F.col("n") - F.ceil(similarity * F.col("n")) + 1))
    left = posts.select(F.col("doc_id").alias("a"), "spot", "class", F.col("n").alias("na"))
    right = posts.select(F.col("doc_id").alias("b"), "spot", F.explode(F.array(F.col("class"), F.col("class") - 1)).alias("class"), F.col("n").alias("nb"))
    near = (F.col("a") != F.col("b")) & (F.least("na", "nb") >= similarity * F.greatest("na", "nb"))
    pairs = left.join(right, ["spot", "class"]).filter(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one, two = sets.select(F.col("doc_id").alias("a"), F.col("spots").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("spots").alias("sb"))
    return pairs.join(one, "a").join(two, "b").withColumn("likeness", jaccard(F.col("sa"), F.col("sb"), similarity)).filter(F.col("likeness") >= similarity).select("a", "b", "likeness")


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", quantiles: int = 4096, per_range: int = 4096, **derived: Column) -> DataFrame:
    """Add next_<column>, of the row that follows by descending key (the last row's is the first). Rows with equal keys
    follow each other by a hash of the columns; null keys come last, by that hash. derived columns, made of the others
    and computed once a row, are added likewise.

    No task sorts all rows: the keys' approximate quantiles cut them into ranges, and each of these is cut evenly into as
    many as leave about per_range rows in one, so that ranges grow in number and not in size; rows without key are
    dealt by their hash in the same way. The row after the last of a range is the first of the next one that has rows,
    and there is one such row a range.
    """
    ask = [F.percentile_approx(key, [i / quantiles for i in range(quantiles)], 10000).alias("q"), F.count("*").alias("n"), F.count(key).alias("known")]
    found = docs.agg(*ask).first()
    bounds = sorted(set(found["q"] or [0]))
    width = 64
    coarse = F.array(*(F.lit(b) for b in bounds[::width]))
    table_ = F.array(*map(F.lit, bounds))
    parts = max(1, -(-found["known"] // (per_range * len(bounds))))
    ends = {i: b for i, b in enumerate(bounds)}
    at = F.greatest(F.size(F.filter(coarse, lambda x: x <= F.col(key))) - 1, F.lit(0))
    place = let(at, lambda k: F.greatest(k * width + F.size(F.filter(F.slice(table_, k * width + 1, width), lambda x: x <= F.col(key))) - 1, F.lit(0)))
    share = lambda i: (F.col(key) - table_[i]) / F.greatest(F.coalesce(F.get(table_, i + 1), F.lit(ends[len(ends) - 1] + 1)) - table_[i], F.lit(1))
    fine = let(place, lambda i: i * parts + F.greatest(F.least(F.floor(share(i) * parts), F.lit(parts - 1)), F.lit(0)))
    row = F.struct(*(F.col(c) for c in columns))
    unknown = max(1, -(-(found["n"] - found["known"]) // per_range))
    d = docs.withColumn("_tie", F.xxhash64(*columns))
    by_hash = F.floor((F.col("_tie") / float(1 << 63) + 1) / 2 * unknown)
    d = d.withColumn("_range", F.when(F.col(key).isNotNull(), fine.cast("long")).otherwise(F.least(by_hash, F.lit(unknown - 1)) - unknown))
    heads = d.groupBy("_range").agg(F.max_by(row, F.struct(F.col(key), F.col("_tie"))).alias("_head"))
    ring, everything = W.orderBy(F.col("_range").asc()), W.partitionBy()
    above = F.coalesce(F.lead("_range").over(ring), F.min("_range").over(everything))
    above = d.select("_range").distinct().select("_range", above.alias("_above"))
    # the head of each range also stands, as a guard, behind the last row of the range above it
    guards = heads.join(above, "_range").select(F.col("_above").alias("_range"), F.lit(1).alias("_guard"), *(F.col("_head")[c].alias(c) for c in columns))
    d = d.withColumn("_guard", F.lit(0)).unionByName(guards, allowMissingColumns=True).withColumns(derived)
    columns = [*columns, *derived]
    row = F.struct(*(F.col(c) for c in columns))
    w = W.partitionBy("_range").orderBy("_guard", F.col(key).desc_nulls_last(), F.col("_tie").desc())
    return d.withColumn("_follow", F.lead(row).over(w)).filter("_guard = 0").select(*docs.columns, *derived, *(F.col("_follow")[c].alias(f"next_{c}") for c in columns))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    A fingerprint is the row's signatures, sorted and joined; likeness is the Jaccard similarity of two rows' sets.
    The edited text has the last floor(n_chars / 3) code points replaced by the first as many of the next document's.
    A null text is empty; empty texts have one fingerprint. A single row is its own next. Rows with null doc_id come
    last; rows with equal doc_id follow each other by a hash of the text. Other columns are ignored; no rows give no rows.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = with_next(d, ["text"], own=spots(F.col("text")))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.encode(edited, "UTF-8"), 256).alias("edited_sha256"), "own", spots(edited).alias("new"), F.col("next_own").alias("other"))
    return d.select("doc_id", "n_chars", "edited_sha256", as_hex(F.col("own")).alias("fingerprint"), as_hex(F.col("new")).alias("edited_fingerprint"), jaccard(F.col("own"), F.col("new")).alias("near_edited"), jaccard(F.col("own"), F.col("other")).alias("near_next"))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints(table(spark, sf_dir, "documents"))
