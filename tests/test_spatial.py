import time

import numpy as np
import pytest

from roadweave.operators import spatial


def by_hand(xy, eps, least):
    """Density clusters of a few points by all pairs, numbered by their lowest core point."""
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(2)
    near = d2 <= eps * eps
    core = near.sum(1) >= least
    label = np.full(len(xy), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            label[i], todo = i, [i]
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core):
                    if label[j] < 0:
                        label[j] = i
                        todo.append(j)
    number = {c: n for n, c in enumerate(sorted(set(label[core].tolist())))}
    out = [number[label[i]] if core[i] else min([number[label[j]] for j in np.flatnonzero(near[i] & core)], default=-1) for i in range(len(xy))]
    return dict(enumerate(out))


@pytest.mark.parametrize("leaf", [4096, 1])
def test_clusters_equal_all_pairs(spark, monkeypatch, leaf):
    """Groups, chains, repeated points and noise; with leaves of one pair every border is split down to points."""
    monkeypatch.setattr(spatial, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    xy = np.concatenate([rng.normal(c, 1.2, (60, 2)) for c in ((0, 0), (6, 1), (30, 30))] + [np.stack([np.arange(0, 12, 0.7), np.full(18, 12.0)], 1), np.repeat([[20.0, 5.0]], 9, 0), rng.uniform(-20, 40, (40, 2))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    got = {r.id: r.cluster for r in spatial.dbscan(df, 1.0, 4).collect()}
    assert got == by_hand(xy, 1.0, 4)


def test_two_dense_cells(spark):
    """Neighbouring cells of 30,000 points each: 9e8 pairs, which are never made. Once they touch, once they just don't."""
    rng = np.random.default_rng(3)
    side = 1.0 / np.sqrt(2)
    for gap, clusters in ((0.2, 1), (1.0 + 1e-6, 2)):
        left = np.stack([side - 1e-3 - rng.uniform(0, 0.3, 30_000) ** 2, rng.uniform(0.0, 0.7, 30_000)], 1)
        right = left * [-1, 1] + [2 * left[:, 0].max() + gap, 0.0]
        xy = np.concatenate([left, right])
        df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double").repartition(4)
        began = time.time()
        assert spatial.dbscan(df, 1.0, 4).select("cluster").distinct().count() == clusters
        assert time.time() - began < 100
