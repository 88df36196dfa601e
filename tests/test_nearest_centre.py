"""Nearest centres in bounded memory: the rows of a plain loop, whatever the number of centres."""

import tracemalloc

import numpy as np

from routelake.operators import clustering


def test_memory_does_not_grow_with_the_centres():
    rng = np.random.default_rng(5)
    m, centres = rng.normal(size=(256, 32)), rng.normal(size=(4000, 32))
    tracemalloc.start()
    near, apart = clustering.nearest_centre(m, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20  # 262 MB for all differences at once
    plain = [((x - centres) ** 2).sum(axis=1) for x in m]
    assert near.tolist() == [int(p.argmin()) for p in plain] and np.allclose(apart, [p.min() for p in plain])


def test_portions_and_ties(spark, monkeypatch):
    monkeypatch.setattr(clustering, "PORTION", 7)
    rng = np.random.default_rng(6)
    places = rng.integers(0, 3, size=(30, 3)).astype(float) + 1e6  # many equal, far from the origin
    m = rng.integers(0, 3, size=(200, 3)).astype(float) + 1e6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(200, None)], "id long, v array<double>").repartition(3)
    centres = spark.createDataFrame([(2 * i, v.tolist()) for i, v in enumerate(places)], "cluster_id int, centre array<double>")
    got = {r["id"]: r["cluster_id"] for r in clustering.assigned(df, "v", centres).collect()}
    assert got == {i: 2 * int(((x - places) ** 2).sum(axis=1).argmin()) for i, x in enumerate(m)} | {200: None}
    assert clustering.assigned(df, "v", centres.limit(0)).where("cluster_id is null").count() == 201
