"""Centroid clustering: exact Lloyd rounds with Yinyang bounds, one lower bound a vector and group of centroids."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import spread
from .common import Scratch, table

#: Components are whole numbers of at most this size, so that a squared distance is a long.
MOST = 1 << 27
#: Centroids of a group on average; cells (centroids x dimensions) that may travel with every task.
GROUP, MOST_CELLS = 10, 1 << 22
#: Bounds are roots of exact sums; they are widened by more than rounding can amount to.
SLACK = 1e-9
STATE = "vec_id long, x array<int>, cluster int, upper double, lower array<double>, distance long, moved array<long>, n long"


def quantised(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id, x: the vectors of dim finite components, each component c as floor(256 * c), held within MOST."""
    good = (F.size("embedding") == dim) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.floor(F.greatest(F.least(256 * c.cast("double"), F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int")
    return vectors.filter(F.col("embedding").isNotNull()).filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("x"))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to c, a row or as many rows."""
    d = x - c
    if np.abs(d).max(initial=0) < 1 << 22 and x.shape[1] <= 256:  # then no sum of squares passes 2 ** 53
        d = d.astype(np.float64)
    return np.einsum("ij,ij->i", d, d).astype(np.int64)


def grouped(centroids: np.ndarray) -> np.ndarray:
    """The group of each centroid: a few Lloyd rounds over the centroids, once."""
    n = max(1, math.ceil(len(centroids) / GROUP))
    c = centroids.astype(np.float64)
    middle = c[:: max(1, len(c) // n)][:n]
    for _ in range(5):
        of = ((c[:, None, :] - middle[None, :, :]) ** 2).sum(2).argmin(1)
        middle = np.stack([c[of == g].mean(0) if (of == g).any() else middle[g] for g in range(n)])
    return np.unique(of, return_inverse=True)[1]


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray, group: np.ndarray):
    """One round for vectors x (longs): their clusters (-1 before the first), an upper bound on the distance to their own
    centroid and a lower bound to the others of each group, all as they were before centroids drifted. Returns
    cluster, upper, lower anew, and of how many pairs the distance was computed.

    A vector whose upper bound is below all lower bounds keeps its cluster, first with the old upper bound plus the drift,
    then with its exact distance. For the rest, groups whose bound lies above are passed over, and centroids of the
    other groups whose own bound (the group's before, minus their drift) does. What survives is scanned exactly;
    of equal distances the smaller number wins. A bound equal to the distance doesn't exclude.
    """
    k, groups = len(centroids), int(group.max()) + 1
    rows, first = np.arange(len(x)), cluster < 0
    own = np.where(first, 0, cluster)
    most = np.zeros(groups)
    np.maximum.at(most, group, drift)
    upper = np.where(first, np.inf, upper + drift[own])
    shrunk = lower - most
    todo = rows[upper >= shrunk.min(1)]
    known = squares(x[todo], centroids[own[todo]])
    pairs = len(todo)
    upper[todo] = np.where(first[todo], np.inf, np.sqrt(known) * (1 + SLACK))
    keep = upper[todo] >= shrunk[todo].min(1)
    todo, known = todo[keep], known[keep]
    cluster, out = own.copy(), shrunk.copy()
    for part in np.array_split(np.arange(len(todo)), len(todo) * k // (1 << 20) + 1):
        at = todo[part]
        each = np.arange(len(at))
        bound = lower[at][:, group] - drift
        scan = (upper[at][:, None] >= shrunk[at])[:, group] & (bound <= upper[at][:, None])
        scan[each, own[at]] = False
        found = np.full((len(at), k), np.iinfo(np.int64).max)
        found[each, own[at]] = known[part]
        for c in range(k):
            these = np.flatnonzero(scan[:, c])
            found[these, c] = squares(x[at[these]], centroids[c])
            pairs += len(these)
        best = found.argmin(1)
        scan[each, own[at]] = True
        bound = np.where(scan, np.sqrt(found.astype(np.float64)) * (1 - SLACK), bound)
        bound[each, best] = np.inf
        fresh = np.full((len(at), groups), np.inf)
        for c in range(k):
            fresh[:, group[c]] = np.minimum(fresh[:, group[c]], bound[:, c])
        # of groups passed over the bound stays, but for the centroid that a vector has just left
        passed = ~(upper[at][:, None] >= shrunk[at])
        left = np.where(best != own[at], np.sqrt(known[part]) * (1 - SLACK), np.inf)
        stay = shrunk[at].copy()
        stay[each, group[own[at]]] = np.minimum(stay[each, group[own[at]]], left)
        out[at] = np.where(passed, stay, fresh)
        cluster[at], upper[at] = best, np.sqrt(found[each, best]) * (1 + SLACK)
    return cluster, upper, out, pairs


def passed(state: DataFrame, centroids: np.ndarray, drift: np.ndarray, group: np.ndarray, last: bool) -> DataFrame:
    """All vectors assigned once. Beside them each task gives a row for every cluster whose members it has moved: the sum
    of vectors and their number that the cluster gained (x is null in these)."""
    k, dim, groups = *centroids.shape, int(group.max()) + 1

    def work(batches):
        gained, number = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(n, dim).astype(np.int64)
            old = batch.column(2).to_numpy()
            lower = batch.column(4).flatten().to_numpy().reshape(n, groups)
            cluster, upper, lower, _ = assign(x, old, batch.column(3).to_numpy(), lower, centroids, drift, group)
            for c in np.unique(np.concatenate([cluster[cluster != old], old[(cluster != old) & (old >= 0)]])).tolist():
                come, gone = (cluster == c) & (old != c), (old == c) & (cluster != c)
                gained[c] += x[come].sum(0) - x[gone].sum(0)
                number[c] += int(come.sum()) - int(gone.sum())
            distance = pa.array(squares(x, centroids[cluster])) if last else pa.nulls(n, pa.int64())
            bounds = pa.ListArray.from_arrays(pa.array(np.arange(0, n * groups + 1, groups, dtype=np.int32)), pa.array(lower.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(upper), bounds, distance, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())], names=names)
        at = np.flatnonzero((number != 0) | (gained != 0).any(1))
        m = len(at)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, m * dim + 1, dim, dtype=np.int32)), pa.array(gained[at].ravel()))
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int32())), pa.array(at.astype(np.int32)), pa.nulls(m, pa.float64()), pa.nulls(m, pa.list_(pa.float64())), pa.nulls(m, pa.int64()), rows, pa.array(number[at])], names=names)

    names = [f.split()[0] for f in STATE.split(", ")]
    return state.select(names[:5]).mapInArrow(work, STATE)


def cluster(points: DataFrame, seeds: np.ndarray, rounds: int, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance of points (vec_id, x) after `rounds` rounds from the seeds (centroids x dimensions, whole
    numbers) and a last assignment; and the final centroids.

    Every round replaces a centroid by the floor of its vectors' mean; empty ones stay. A round is one pass without an
    exchange: vectors carry their bounds from table to table, and only the sums of what moved are brought together,
    at most one row a task and cluster. Centroids go with the tasks: centroids x dimensions is at most MOST_CELLS.
    """
    k, dim = seeds.shape
    if k * dim > MOST_CELLS:
        raise ValueError(f"{k} centroids of {dim} dimensions are more than {MOST_CELLS} cells")
    group, centroids, drift = grouped(seeds), seeds.astype(np.int64), np.zeros(k)
    bounds = F.array(*[F.lit(float("-inf"))] * (int(group.max()) + 1))
    state, old = points.select("vec_id", "x", F.lit(-1).alias("cluster"), F.lit(float("inf")).alias("upper"), bounds.alias("lower")), None
    sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
    for r in range(rounds + 1):
        new = scratch.cut(passed(state, centroids, drift, group, r == rounds))
        scratch.drop(old)
        old, state = new, new.filter("x is not null")
        if r == rounds:
            break
        moved = new.filter("moved is not null").select("cluster", "n", F.posexplode("moved").alias("i", "v"))
        for c, i, v, n in moved.groupBy("cluster", "i").agg(F.sum("v"), F.sum("n")).collect():  # centroids x dimensions rows
            sums[c, i] += v
            counts[c] += n if i == 0 else 0
        fresh = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        drift = np.sqrt(squares(fresh, centroids).astype(np.float64)) * (1 + SLACK)
        centroids = fresh
    return state.select("vec_id", "cluster", "distance"), centroids


def first_by_hash(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in that order (equal ids by their vectors, null ids last)."""
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).asc_nulls_last(), F.col("x")]
    return np.array([r["x"] for r in points.orderBy(*order).limit(k).collect()], np.int64)


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the vectors (vec_id, embedding) of dim finite
    components; others are left out, and so are other columns. Components count as floor(256 * c), beyond 2 ** 27 as that.

    Fewer than k vectors give as many centroids. Repeated rows are vectors of their own; equal centroids leave all to the
    smaller number. A null vec_id is kept, but comes last among the first centroids. No vectors give no rows.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    points = quantised(spread(vectors.select("vec_id", "embedding")), dim)
    seeds = first_by_hash(points, k, seed)
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(seeds):
        return points.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).join(spark.createDataFrame([], schema), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    found, centroids = cluster(points, seeds, rounds, scratch)
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a centroid
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    per = spark.createDataFrame([(c, s, sum(inertia.values()), digest(c)) for c, s in inertia.items()], schema)
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 40 clusters after five rounds. See clustered for nulls, odd vectors, ties and empty tables."""
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 40, rounds: int = 5) -> str:
    dot = "list_inner_product({}::DOUBLE[], {}::DOUBLE[])"
    near = lambda r: f"""a{r} AS MATERIALIZED (SELECT r, vec_id, x, c, d FROM (SELECT v.r, v.vec_id, v.x, c, ({dot.format('v.x', 'v.x')} - 2 * {dot.format('v.x', 'm.x')} + {dot.format('m.x', 'm.x')})::BIGINT AS d FROM v, c{r} m)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""  # noqa: E731
    parts = ["""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""", f"c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT x, sha256('2:' || vec_id) AS h FROM v ORDER BY h NULLS LAST, x LIMIT {k}))"]
    for r in range(rounds):
        parts += [near(r), f"""s{r + 1} AS (SELECT c, i, sum(x[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{r}, range(1, 65) t(i) GROUP BY c, i),
m{r + 1} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{r + 1} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN m{r + 1} m ON m.c = o.c)"""]
    parts += [near(rounds)]
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} m ON m.c = a.c"""


OP11_SQL = _sql()
