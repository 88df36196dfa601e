"""Embedding near-duplicates and whitening against plain numpy."""

import math

import numpy as np
import pytest

from routelake.llm import embedding_dedup, whitening
from routelake.llm.embedding_dedup import Index

SCHEMA = "vec_id long, embedding array<float>, label int, key string, node long, shard int, id string"


def table(spark, rows):
    """Rows of (vec_id, embedding) beside columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, 1, "k", 7, 3, "x") for i, v in rows], SCHEMA)


def clumps(seed: int, dims: int = 16) -> list[tuple[int, list[float]]]:
    """Random vectors, chains of neighbours and groups of near copies of two to hundreds, under shuffled ids."""
    rng = np.random.default_rng(seed)
    found = [rng.normal(size=dims) for _ in range(150)]
    for size, noise in ((2, 0.05), (5, 0.08), (40, 0.1), (220, 0.07)):
        middle = rng.normal(size=dims)
        middle /= np.linalg.norm(middle)
        found += [(middle + noise * rng.normal(size=dims) / math.sqrt(dims)) * rng.uniform(0.1, 9) for _ in range(size)]
    a, b = np.linalg.qr(rng.normal(size=(dims, 2)))[0].T
    found += [math.cos(t * 0.2) * a + math.sin(t * 0.2) * b for t in range(12)]
    found += [found[3].copy() for _ in range(60)]
    ids = rng.permutation(len(found)) + 100
    return [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(ids, found, strict=True)]


def plain(rows, threshold=0.95):
    """vec_id -> (n_links, component) by comparing all pairs."""
    ids = [i for i, _ in rows]
    unit = []
    for _, v in rows:
        good = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, dtype=float) / np.linalg.norm(v) if good else None)
    links = [[j for j in range(len(rows)) if j != i and u is not None and unit[j] is not None and len(u) == len(unit[j]) and u @ unit[j] >= threshold] for i, u in enumerate(unit)]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, others in enumerate(links):
        for j in others:
            label[root(i)] = root(j)
    smallest = {}
    for i in range(len(rows)):
        smallest[root(i)] = min(smallest.get(root(i), ids[i]), ids[i])
    return sorted((ids[i], len(links[i]), smallest[root(i)], smallest[root(i)] == ids[i]) for i in range(len(rows)))


def found(spark, rows, index=None):
    got = embedding_dedup.near_duplicates(table(spark, rows), "vec_id", "embedding", index)
    return sorted((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in got.collect())


@pytest.mark.parametrize("index", [Index(), Index(rows=60), Index(rows=100, part=80, overlap=4)])
def test_links_as_all_pairs(spark, index):
    rows = clumps(5)
    assert found(spark, rows, index) == plain(rows)


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0, 0.0, 0.0]), (10, [-0.0, 3.0]), (11, [0.0, 3.0]), (12, [-1.0, 0.0]), (13, [1e-30, 0.0])]
    assert found(spark, rows) == plain(rows)
    assert found(spark, [*rows, (1, [1.0, 0.0])]) == plain([*rows, (1, [1.0, 0.0])])


def test_empty_and_unusable(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, [0.0])]) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert found(spark, [(5, [1.0, 2.0])]) == [(5, 0, 5, True)]


def test_null_ids(spark):
    got = embedding_dedup.near_duplicates(table(spark, [(None, [1.0, 0.0]), (4, [1.0, 0.0])]), "vec_id", "embedding").collect()
    assert sorted(((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str) == [(4, 0, 4, True), (None, 0, None, True)]


def test_audit_tells_what_is_missing(spark):
    rows = clumps(6)
    classes = embedding_dedup.classes_of(table(spark, rows), "vec_id", "embedding")
    none = spark.createDataFrame([], "node long, links long")
    assert embedding_dedup.audit(classes, none, Index()) == 0.0
    counted, _ = embedding_dedup.links(classes, Index(rows=60))
    assert embedding_dedup.audit(classes, counted, Index()) == 1.0


def test_hub_keeps_all_in_reach():
    rng = np.random.default_rng(1)
    hub = np.eye(32)[0]
    m = np.array([hub, *[hub + 0.1 * x / np.linalg.norm(x) for x in rng.normal(size=(400, 32))]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    graph = embedding_dedup.pruned_graph(m, Index())
    q, node = embedding_dedup._found_by_search(m, np.arange(len(m)), m, graph, 0, Index())
    want = np.argwhere((m @ m.T >= 0.95) & ~np.eye(len(m), dtype=bool)).tolist()
    assert sorted([i, j] for i, j in zip(q.tolist(), node.tolist(), strict=True) if i != j) == want


# ---------------------------------------------------------------- whitening


def whitened(spark, rows, components=32):
    ready = whitening._ready(table(spark, rows), "vec_id", "embedding")
    return whitening.whiten(ready, whitening.fit(ready, components)).collect()


def grid(rows):
    return [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]


@pytest.mark.parametrize("dims,rows,components", [(8, 300, 8), (40, 200, 32), (3, 50, 2)])
def test_whitening_as_numpy(spark, dims, rows, components):
    rng = np.random.default_rng(dims)
    own = [(i, [float(x) for x in v]) for i, v in enumerate((rng.normal(size=(rows, dims)) @ rng.normal(size=(dims, dims))).astype(np.float32))]
    got = whitened(spark, own, components)
    x = np.array(grid(own), dtype=float)
    v = np.cov(x.T, bias=True)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    want = (x - x.mean(axis=0)) @ u / np.sqrt(e)
    mine = np.zeros_like(want)
    sums, n = [sum(c) for c in zip(*grid(own), strict=True)], len(own)
    for r in got:
        mine[r["id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["identity_error"] < 1e-6
        assert r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(grid(own)[r["id"]], sums, strict=True))
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / np.trace(v), rel=1e-9)
    assert len(got) == rows * components
    assert np.abs(mine * np.sign((mine * want).sum(axis=0)) - want).max() < 1e-7


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0]), (None, [0.5, -3.0])]
    bad = [(7, None), (8, [nan, 1.0]), (9, [1.0, inf]), (10, [1.0, None])]
    got = whitened(spark, good + bad)
    assert sorted(((r["id"], r["component"]) for r in got), key=str) == sorted([(1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2), (None, 1), (None, 2)], key=str)
    assert {r["n"] for r in got} == {4}
    assert len(whitened(spark, [(1, [1.0, 2.0]), (2, [2.0]), (3, [])])) == 6
    assert whitened(spark, [(1, [1e30, 0.0]), (2, [-1e30, 0.0])])


def test_whitening_without_variance(spark):
    assert whitened(spark, []) == []
    assert whitened(spark, [(1, None)]) == []
    assert whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    assert whitened(spark, [(1, [])]) == []
