"""Yinyang clustering against plain Lloyd rounds in whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from rankloom.llm import kmeans

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"


def lloyd(rows, k=40, rounds=5):
    kept = [(i, [min(max(math.floor(256.0 * c), -kmeans.MOST), kmeans.MOST) for c in map(float, v)]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [r[1] for r in order[:k]]
    x = np.array([v for _, v in kept], dtype=object).reshape(len(kept), 64)
    for r in range(rounds + 1):
        d = np.array([((x - np.array(c, dtype=object)) ** 2).sum(1) for c in centroids]).T
        of = [min(range(len(centroids)), key=lambda c: (row[c], c)) for row in d]
        if r < rounds:
            for c in range(len(centroids)):
                mine = [v for (_, v), o in zip(kept, of) if o == c]
                if mine:
                    centroids[c] = [sum(col) // len(mine) for col in zip(*mine)]
    dist = [int(row[o]) for row, o in zip(d, of)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i is None, i or 0), o, e, sum(e2 for o2, e2 in zip(of, dist) if o2 == o), sum(dist), sha[o]) for (i, _), o, e in zip(kept, of, dist))


def run(spark, tmp_path, rows):
    data = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], 1, "own") for i, v in rows]
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = kmeans.op11_yinyang(spark, str(tmp_path)).collect()
    return sorted(((r[0] is None, r[0] or 0), *tuple(r)[1:]) for r in got), [(i, v) for i, v, _, _ in data]


def test_odd_vectors(spark, tmp_path):
    """Groups of near copies, equal vectors under several ids and one id, nulls, other lengths, infinite and huge components."""
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(9, 64))
    rows = [(i, centers[i % 9] + rng.normal(size=64) * 0.05) for i in range(300)] + [(1000 + i, centers[0]) for i in range(150)] + [(7, centers[3])] * 5
    rows += [(None, centers[1]), (None, None), (2000, [1.0] * 63), (2001, [1.0] * 65), (2002, [float("nan")] + [0.0] * 63), (2003, [float("inf")] + [0.0] * 63), (2004, [None] + [0.0] * 63), (2005, []), (2006, [1e30] * 64), (2007, [-1e30] * 64), (2008, [0.0] * 64), (2009, [0.0] * 64)]
    rows = [(i, None if v is None else list(v)) for i, v in rows]
    got, given = run(spark, tmp_path, rows)
    assert got == lloyd(given)


@pytest.mark.parametrize("n", [0, 1, 6])
def test_fewer_than_centroids(spark, tmp_path, n):
    rng = np.random.default_rng(2)
    got, given = run(spark, tmp_path, [(i, list(rng.normal(size=64))) for i in range(n)])
    assert got == lloyd(given)


def test_bounds_leave_out_most_pairs():
    """Over the rounds clusters are those of full scans, and far fewer distances are computed."""
    rng = np.random.default_rng(3)
    x = (np.repeat(rng.normal(size=(40, 64)), 100, 0) * 256 + rng.normal(size=(4000, 64)) * 20).astype(np.int64)
    centroids = x[rng.permutation(4000)[:40]]
    group, drift = kmeans.grouped(centroids), np.zeros(40)
    assert group.max() + 1 == 4
    state = np.full(4000, -1), np.full(4000, np.inf), np.full((4000, 4), -np.inf)
    pairs = 0
    for _ in range(8):
        *state, n = kmeans.assign(x, *state, centroids, drift, group)
        full = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
        assert (state[0] == full.argmin(1)).all()
        assert (state[1] ** 2 >= full[np.arange(4000), state[0]]).all()
        for g in range(4):
            others = np.where((group == g) & (np.arange(40) != state[0][:, None]), full, np.iinfo(np.int64).max).min(1)
            assert (np.maximum(state[2][:, g], 0) ** 2 <= others).all()
        pairs += n
        fresh = np.stack([x[state[0] == c].sum(0) // max(1, (state[0] == c).sum()) if (state[0] == c).any() else centroids[c] for c in range(40)])
        drift = np.sqrt(kmeans.squares(fresh, centroids).astype(float)) * (1 + kmeans.SLACK)
        centroids = fresh
    assert pairs < 0.35 * 8 * 4000 * 40


def test_too_many_cells(spark):
    with pytest.raises(ValueError):
        kmeans.cluster(None, np.zeros((1 << 17, 64), np.int64), 1, None)
