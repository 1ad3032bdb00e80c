"""MinHash near-dedup by an inverted join on signature coordinates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NODE, Scratch, forest, slices, split_join, table
from .repeats import keyed
from .rolling import BASES, Prefix, Text, mix

#: A signature has COORDINATES values, each made of JOINED minima, so that two sets agree in one with probability
#: similarity ** JOINED. Pairs that agree in fewer than MATCHES coordinates are no candidates: of pairs at similarity
#: 0.75 that loses 2 or 3 in 100,000, of closer pairs fewer; of pairs at 0.4 it lets 1 in 1,000 through.
COORDINATES, JOINED, MATCHES = 64, 4, 7
#: Documents that share a value are paired with each other if they are so few, else with the least of them.
FEW = 4
#: Documents compared with one representative in one task, and those of a value that are compared in one task.
CHUNK, BLOCK = 64, 256
SHINGLE = 5
_rng = np.random.default_rng(1729)
FACTORS = _rng.integers(0, 1 << 63, COORDINATES * JOINED // 2, np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _rng.integers(0, 1 << 63, COORDINATES * JOINED // 2, np.uint64)
#: Stands for a null doc_id, which comes after all others.
LAST = (1 << 63) - 1


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """Of each text, the sorted distinct hashes of its runs of `width` lower-cased words, or of all words if they are fewer."""
    t = Text(texts)
    w = t.words(fold=True)
    p = Prefix(w.hashes(), BASES[2])
    out = []
    for a, z in zip(w.first.tolist(), w.last.tolist()):
        start = np.arange(a, max(z - width + 1, a + 1) if z > a else a)
        out.append(np.unique(p.spans(start, np.minimum(start + width, z))))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row for each set that isn't empty. A product of 64 bits gives two hash values, its halves."""
    least = np.full((len(sets), COORDINATES * JOINED), np.iinfo(np.uint32).max, np.uint32)
    for i, values in enumerate(sets):
        for at in range(0, len(values), 512):
            h = values[at : at + 512, None] * FACTORS + ADDENDS
            np.minimum(least[i], h.view(np.uint32).min(0), out=least[i])
    parts = least.reshape(len(sets), COORDINATES, JOINED).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, COORDINATES + 1, dtype=np.uint64), (len(sets), COORDINATES))
    for k in range(JOINED):
        out = mix(out * np.uint64(31) + parts[:, :, k])
    return out.view(np.int64)


def signed(base: DataFrame) -> DataFrame:
    """node, n, s1, s2 (which tell equal sets), sig of every text; s1, s2 and sig are null if the set is empty."""

    def work(batches):
        for whole in batches:
            for batch in slices(whole, 1):
                sets = shingle_sets(batch.column(1).to_pylist())
                some = [i for i, x in enumerate(sets) if len(x)]
                s1 = [int(mix(x).sum(dtype=np.uint64).view(np.int64)) if len(x) else None for x in sets]
                s2 = [int(mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(x) else None for x in sets]
                sig: list = [None] * len(sets)
                for i, row in zip(some, signatures([sets[i] for i in some])):
                    sig[i] = row
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sig, pa.list_(pa.int64()))], names=["node", "n", "s1", "s2", "sig"])

    return base.mapInArrow(work, f"node {NODE}, n long, s1 long, s2 long, sig array<long>")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def posted(classes: DataFrame, matches: int) -> DataFrame:
    """key, node, df, n_hot: the inverted lists of signature values. Values met once are skipped. Of values that more than
    FEW classes share (hot ones) each class leaves out its matches - 1 most frequent (prefix): two classes that agree in
    `matches` hot values agree in one that is left. n_hot is the number of a class's hot values, those left out too."""
    posts = classes.select("node", F.explode("sig").alias("key"))
    df = posts.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    lists = split_join(posts, df, ["key"]).groupBy("node").agg(F.collect_list(F.struct("df", "key")).alias("x"))
    hot = F.sort_array(F.filter("x", lambda r: r["df"] > FEW), asc=False)
    kept = F.concat(F.filter("x", lambda r: r["df"] <= FEW), F.slice(hot, matches, COORDINATES))
    return lists.select("node", F.size(hot).alias("n_hot"), F.explode(kept).alias("x")).select("x.key", "node", "x.df", "n_hot")


def colliding(posts: DataFrame, matches: int) -> DataFrame:
    """Pairs (a, b), a the lesser, that may agree in `matches` values: collisions in values of few classes are counted for
    every pair, those in hot values for each class and the least of its list. A pair is kept if its count, and what hot
    values could add to it, reach the threshold; for classes without hot values the count is exact."""
    few = posts.filter(F.col("df") <= FEW)
    small = few.select("key", F.col("node").alias("a"), F.col("n_hot").alias("ha")).join(few.select("key", F.col("node").alias("b"), F.col("n_hot").alias("hb")), "key").filter("a < b")
    many = posts.filter(F.col("df") > FEW)
    least = many.groupBy("key").agg(F.min(F.struct("node", "n_hot")).alias("r"))
    star = split_join(many, least, ["key"]).filter("node <> r.node").select(F.col("r.node").alias("a"), F.col("r.n_hot").alias("ha"), F.col("node").alias("b"), F.col("n_hot").alias("hb"))
    both = small.select("a", "ha", "b", "hb", F.lit(1).alias("c")).unionByName(star.withColumn("c", F.lit(0)))
    pairs = both.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max(F.least("ha", "hb")).alias("h"))
    return pairs.filter(F.col("c") + F.col("h") >= matches).select("a", "b")


UNIT = f"unit long, a {NODE}, side int, node {NODE}, content binary"


def expand(batches):
    """Rows node, text, rows (unit, a, side) -> unit, a, side, node and the text's set, for each of rows."""
    for whole in batches:
        for batch in slices(whole, 1):
            sets = shingle_sets(batch.column(1).to_pylist())
            rows = batch.column(2)
            which = np.repeat(np.arange(batch.num_rows), rows.value_lengths().to_numpy(zero_copy_only=False))
            own, node = rows.flatten(), batch.column(0).take(pa.array(which))
            total = 0
            start = 0
            for i, w in enumerate(which.tolist()):  # a set may go to many units: batches stay small
                total += sets[w].nbytes
                if total > 1 << 22 or i + 1 == len(which):
                    part = slice(start, i + 1)
                    cut = own.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([cut.field("unit"), cut.field("a"), cut.field("side"), node.slice(start, i + 1 - start), pa.array([sets[x].tobytes() for x in which[part].tolist()], pa.binary())], names=["unit", "a", "side", "node", "content"])
                    start, total = i + 1, 0


def arrays(column: pa.BinaryArray):
    """The sets in a binary column, where they lie."""
    if len(column):
        _, places, data = column.buffers()
        at = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
        for a, z in zip(at[:-1], at[1:]):
            yield np.frombuffer(data, np.uint64, (z - a) // 8, a)


def compared(base: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs whose whole sets are similar. Pairs meet in units of one a and at most about CHUNK b, so that no
    task gets all partners of an a; a unit's rows are read one after the other, and only a's set is held."""
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    unit = lambda k: F.xxhash64("a", k)
    right = split_join(pairs, size, ["a"]).select(F.col("b").alias("node"), unit(F.pmod(F.xxhash64("b"), F.col("chunks"))).alias("unit"), "a", F.lit(1).alias("side"), F.lit(0).cast("long").alias("slot"))
    left = size.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("k")).select(F.col("a").alias("node"), unit(F.col("k")).alias("unit"), "a", F.lit(0).alias("side"), F.floor(F.col("k") / 256).alias("slot"))
    roles = right.unionByName(left).groupBy("node", "slot").agg(F.collect_list(F.struct("unit", "a", "side")).alias("rows"))
    texts = base.join(roles, "node").select("node", "text", "rows")

    def verify(batches):
        now, first = None, None
        for batch in batches:
            found = []
            for i, (a, side, x) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), arrays(batch.column(4)))):
                if side == 0:
                    now, first = a, x.copy()
                elif a == now and similar(first, x, percent):
                    found.append(i)
            at = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(3).take(at)], names=["a", "b"])

    units = texts.mapInArrow(expand, UNIT)
    return units.repartition("unit").sortWithinPartitions("unit", "a", "side").mapInArrow(verify, f"a {NODE}, b {NODE}")


class Union:
    """Which of n rows are joined; rows of one label are from the start."""

    def __init__(self, labels: np.ndarray):
        self.up = np.unique(labels, axis=0, return_index=True, return_inverse=True)
        self.up = self.up[1][self.up[2].ravel()]

    def roots(self) -> np.ndarray:
        while True:
            new = self.up[self.up]
            if np.array_equal(new, self.up):
                return new
            self.up = new

    def join(self, a: int, b: int) -> None:
        root = self.roots()
        self.up = np.where(root == max(root[a], root[b]), min(root[a], root[b]), root)


def links_of(sets: list[np.ndarray], labels: np.ndarray, side: np.ndarray, matches: int, percent: int):
    """Pairs of similar sets that join rows which aren't joined yet; with values 0 and 1 in side only pairs of either side.

    Rows go one by one against all others at once: coordinates in common are counted, then sizes compared, then whole
    sets of those that pass, best match first, and only while they are apart.
    """
    sigs, size, joined, two = signatures(sets), np.fromiter(map(len, sets), np.int64, len(sets)), Union(labels), bool(side.any())
    for a in range(len(sets) - 1):
        rest = np.arange(a + 1, len(sets))
        if two:
            rest = rest[side[rest] != side[a]]
        root = joined.roots()
        rest = rest[(root[rest] != root[a]) & (100 * np.minimum(size[rest], size[a]) >= percent * np.maximum(size[rest], size[a]))]
        n = (sigs[rest] == sigs[a]).sum(1)
        keep = n >= matches
        for b in rest[keep][np.argsort(-n[keep], kind="stable")].tolist():
            root = joined.roots()
            if root[a] != root[b] and similar(sets[a], sets[b], percent):
                joined.join(a, b)
                yield a, b


def left_over(base: DataFrame, posts: DataFrame, joined: DataFrame, matches: int, percent: int, scratch: Scratch) -> DataFrame | None:
    """Links that the least classes of hot values didn't show: between classes of different components that share a hot
    value. None if no hot value has classes of several components.

    Classes that such values connect make a group, each class in one only; a group is cut into blocks, and a pair of
    blocks is one unit of work, which holds the sets of both and gives at most one link for each of its rows.
    """
    label = scratch.cut(split_join(posts.filter(F.col("df") > FEW).select("key", "node"), joined, ["node"], "left").select("key", "node", F.coalesce("component", "node").alias("label")))
    apart = label.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("node").alias("least")).filter("l0 <> l1").select("key", "least")
    open_ = scratch.cut(split_join(label, apart, ["key"]).select("node", "label", "least"))
    scratch.drop(label)
    if open_.isEmpty():
        return None
    group = forest(open_.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")), scratch)
    nodes = open_.groupBy("node").agg(F.first("label").alias("label"))
    nodes = scratch.cut(split_join(nodes, group, ["node"], "left").select("node", "label", F.coalesce("component", "node").alias("group")))
    size = nodes.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    todo = split_join(nodes, size, ["group"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    roles = todo.select("node", "label", "group", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    # blocks x, y meet once, in unit (min, max); a block alone in (x, x)
    unit = F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("unit")
    roles = roles.select("node", "label", F.floor(F.col("other") / 256).alias("slot"), unit, (F.col("own") > F.col("other")).cast("int").alias("side"))
    roles = roles.groupBy("node", "slot").agg(F.collect_list(F.struct("unit", F.col("label").alias("a"), "side")).alias("rows"))
    units = base.join(roles, "node").select("node", "text", "rows").mapInArrow(expand, UNIT)

    def solve(batches):
        for t in runs(batches, "unit"):
            t = t.combine_chunks()
            pairs = lambda c: np.stack([t.column(c).combine_chunks().field(k).to_numpy() for k in (0, 1)], 1)
            sets = list(arrays(t.column("content").combine_chunks()))
            node = t.column("node").combine_chunks()
            found = list(links_of(sets, pairs("a"), t.column("side").to_numpy(), matches, percent))
            if found:
                yield pa.RecordBatch.from_arrays([node.take(pa.array(x)) for x in zip(*found)], names=["a", "b"])

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(solve, f"a {NODE}, b {NODE}")


def runs(batches, key: str):
    """Tables of the rows of one key each, from batches sorted by it."""
    held: list = []
    for batch in batches:
        at = batch.column(key).to_numpy() if batch.num_rows else np.zeros(0, np.int64)
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for a, z in zip(edges[:-1], edges[1:]):
            if z > a:
                if held and held[-1].column(key)[0].as_py() != at[a]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(docs: DataFrame, percent: int = 75, matches: int = MATCHES, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, th, n_shingles, component_id, component_th, kept of every row; th is the text's hash, (component_id,
    component_th) the row that stands for the group.

    1. Documents with equal shingle sets become one class; its node is the least doc_id with a hash of that text.
    2. Every class is posted under each coordinate's value; values met once are skipped, and each class leaves out its
       most frequent ones (see posted). Collisions are counted in the join of these lists (see colliding).
    3. Pairs that reach the threshold are compared on whole sets (see compared), and their links joined up (see forest).
    4. Frequent values whose classes are still apart are looked at once more, block by block, on signatures and then on
       whole sets (see left_over).

    Null text, or one without words, is an empty set: n_shingles 0, linked with nothing, kept. A null doc_id comes
    after all others, and a component of null doc_ids alone has component_id null and is kept. Rows with equal doc_id
    and unequal text are distinct documents; equal rows get equal results. A very long text is one set, which a task
    holds whole. Other columns are ignored; no rows give no rows. With scratch, its close() deletes what the result
    is read from.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    base = keyed(docs).select(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.coalesce("th", F.lit(0)).alias("s")).alias("node"), "text")
    every = scratch.cut(signed(base))
    members = scratch.cut(every.select("node", "n", "s1", "s2"))
    classes = every.filter("s1 is not null").groupBy("s1", "s2").agg(F.min("node").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = scratch.cut(classes)
    scratch.drop(every)
    posts = scratch.cut(posted(classes, matches))
    pairs = scratch.cut(colliding(posts, matches))
    links = scratch.cut(compared(base, pairs, percent))
    scratch.drop(pairs)
    joined = forest(links, scratch)
    scratch.drop(links)
    more = left_over(base, posts, joined, matches, percent, scratch)
    if more is not None:
        more = scratch.cut(more)
        if not more.isEmpty():
            both = joined.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more)
            joined = forest(both, scratch)
        scratch.drop(more)
    scratch.drop(posts)
    ids = split_join(classes.select("s1", "s2", "node"), joined, ["node"], "left").select("s1", "s2", F.coalesce("component", "node").alias("c"))
    out = split_join(members, ids, ["s1", "s2"], "left")
    known = lambda c: F.when(c != LAST, c)
    out = out.select(known(F.col("node.d")).alias("doc_id"), F.col("node.s").alias("th"), F.col("n").alias("n_shingles"), F.coalesce("c", "node").alias("c"))
    out = out.select("doc_id", "th", "n_shingles", known(F.col("c.d")).alias("component_id"), F.col("c.s").alias("component_th"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document, at a Jaccard similarity of 0.75 of five-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("th", "component_th")
