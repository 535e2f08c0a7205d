"""Clustering and hard negatives against plain Python."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import centroids, hard_negatives
from touchline.llm.vectors import LARGEST

SCHEMA = "vec_id long, embedding array<float>, label int"


def random_rows(n, size, seed, groups=6, labels=3):
    """Vectors around a few centres, with repeated vectors, ties and useless rows."""
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(groups)]
    rows = []
    for i in range(n):
        middle = middles[0] if i % 3 == 0 else rng.choice(middles)
        rows.append((i, [float(np.float32(x + rng.gauss(0, 0.2))) for x in middle], rng.randrange(labels)))
    rows += [(i, rows[1][1], rows[1][2]) for i in range(n, n + 20)]  # one vector under many ids
    rows += [rows[2], rows[2]]  # whole rows repeated
    rows += [(5, [0.0] * size, 1), (None, rows[3][1], 0), (n + 30, [1.0] * size, None)]
    rows += [
        (900, None, 1), (901, [1.0] * (size - 1) + [None], 1), (902, [float("nan")] + [0.0] * (size - 1), 1),
        (903, [float("inf")] * size, 1),
    ]
    return rows


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# --- clustering -------------------------------------------------------------------


def plain_clusters(rows, k, rounds, size, scale):
    vectors = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows if usable(v) and len(v) == size]
    digest = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    centers = [v for _, v in sorted(vectors, key=lambda r: (*digest(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(centers)), key=lambda j: (far(v, centers[j]), j))
    for _ in range(rounds):
        groups = {}
        for _, v in vectors:
            groups.setdefault(nearest(v), []).append(v)
        centers = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centers)]
    return sorted(((i, nearest(v), far(v, centers[nearest(v)])) for i, v in vectors), key=str), centers


@pytest.mark.parametrize("n,k,size,rounds", [(300, 16, 8, 3), (60, 5, 4, 6), (3, 40, 4, 2)])
def test_clusters(spark, n, k, size, rounds):
    rows = random_rows(n, size, n) + [(777, [0.5] * (size + 1), 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as id", "'x' as v", "'x' as cluster", "'x' as known").repartition(3)
    found, model = centroids.clustered(df, k=k, rounds=rounds, size=size, scale=64)
    want, centers = plain_clusters(rows, k, rounds, size, 64)
    got = centroids.with_totals(found, model).collect()
    assert sorted(((r.id, r.cluster, r.distance) for r in got), key=str) == want
    assert model.now.tolist() == centers and len(model.history) == rounds + 1
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    for r in got:
        assert r.centroid_sha256 == digests[r.cluster]
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.inertia == sum(d for _, _, d in want)


def test_bounds_save_distances_and_use_the_whole_way():
    """A centroid that went there and back again is as near as it was, so nothing is
    computed but the own distances; summed steps would open every row."""
    rng = np.random.default_rng(1)
    centers = rng.integers(-50, 50, (6, 5))
    points = np.repeat(centers, 40, 0) + rng.integers(-2, 3, (240, 5))
    known = centroids._distances(points, centers)
    cluster, seen = known.argmin(1), np.zeros_like(known)
    there = centroids.Centroids([centers, centers + 400, centers])
    assert centroids.assign(points, cluster.copy(), known.copy(), seen.copy(), there) == len(points)
    moved = centroids.Centroids([centers, centers + rng.integers(-9, 10, centers.shape)])
    computed = centroids.assign(points, cluster, known, seen, moved)
    exact = centroids._distances(points, moved.now)
    assert cluster.tolist() == exact.argmin(1).tolist()
    assert known[np.arange(240), cluster].tolist() == exact.min(1).tolist()
    assert computed < exact.size / 2
    # a stored distance is from the round it says
    for j in range(6):
        assert (known[:, j] == np.where(seen[:, j] == 1, exact[:, j], centroids._distances(points, centers)[:, j])).all()


def test_clusters_of_nothing_and_of_large_components(spark):
    empty, model = centroids.clustered(spark.createDataFrame([(1, None, 1), (2, [1.0], 1)], SCHEMA))
    assert empty.collect() == [] and len(model.now) == 0
    assert centroids.with_totals(empty, model).collect() == []
    with pytest.raises(Exception, match=str(LARGEST)):
        centroids.clustered(spark.createDataFrame([(1, [3e37] * 64, 1)], SCHEMA))


# --- hard negatives -----------------------------------------------------------------


def plain_negatives(rows, every, scale, n_pos, n_neg, window):
    kept = {(i, l, tuple(math.floor(scale * x) for x in v)) for i, v, l in rows if l is not None and v and usable(v)}
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    first = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for i, label, v in kept:
        if i is None or i % every:
            continue
        others = [(score(v, w), j, l) for j, l, w in kept]
        positives = sorted([(s, j) for s, j, l in others if l == label and j != i], key=first)[:n_pos]
        for s, j in positives:
            inside = [(t, m) for t, m, l in others if l != label and window[0] * s <= 100 * t <= window[1] * s]
            out += [(i, j, rank, m, s, t) for rank, (t, m) in enumerate(sorted(inside, key=first)[:n_neg], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_per_block,anchors_per_block", [(1 << 16, 1 << 14), (50, 3)])
@pytest.mark.parametrize("size,seed,window", [(8, 1, (50, 95)), (24, 2, (90, 100)), (3, 3, (0, 100))])
def test_hard_negatives(spark, monkeypatch, rows_per_block, anchors_per_block, size, seed, window):
    monkeypatch.setattr(hard_negatives, "ROWS_PER_BLOCK", rows_per_block)
    monkeypatch.setattr(hard_negatives, "ANCHORS_PER_BLOCK", anchors_per_block)
    rows = random_rows(260, size, seed)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as id", "'x' as v", "'x' as anchor", "'x' as score").repartition(3)
    got = hard_negatives.hard_negatives(df, F.col("id") % 9 == 0, scale=32, n_positives=4, n_negatives=3, window=window)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got.columns == names
    want = plain_negatives(rows, 9, 32, 4, 3, window)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and len(want) > 50


def test_surviving_pairs_lose_none():
    rng = np.random.default_rng(3)
    rows = (rng.normal(size=(5000, 20)) * 40 * rng.random((5000, 1)) * 0.8 ** np.arange(20)).astype(np.int64)
    anchors = (rng.normal(size=(300, 20)) * 40 * 0.8 ** np.arange(20)).astype(np.int64)
    anchors[7] = 0
    scores = rows @ anchors.T
    for limit in (np.quantile(scores, 0.999), np.quantile(scores, 0.7), 1, 0, -(2**62)):
        at_least = np.full(300, int(limit)) + rng.integers(0, 20, 300)
        r, a, s = hard_negatives.surviving_pairs(rows, anchors, at_least)
        assert sorted(zip(r.tolist(), a.tolist(), s.tolist())) == [
            (i, j, int(scores[i, j])) for i, j in zip(*(x.tolist() for x in np.nonzero(scores >= at_least)))
        ]


def test_hard_negatives_of_little(spark):
    run = lambda rows: hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") % 50 == 0).collect()
    assert run([]) == [] and run([(50, [1.0, 0.0], 1)]) == [] and run([(50, [], 1), (51, [], 1)]) == []
    # no other label, then one in the window; a zero anchor has a window of scores of zero
    assert run([(50, [1.0, 0.0], 1), (51, [1.0, 0.0], 1)]) == []
    assert [tuple(r) for r in run([(50, [1.0, 0.0], 1), (51, [1.0, 0.0], 1), (52, [0.5, 0.0], 0)])] == [(50, 51, 1, 52, 65536, 32768)]
    assert [tuple(r) for r in run([(50, [0.0], 1), (51, [1.0], 1), (52, [0.5], 0)])] == [(50, 51, 1, 52, 0, 0)]
    with pytest.raises(ValueError, match="components"):
        run([(50, [1.0, 0.0], 1), (51, [1.0], 1)])
