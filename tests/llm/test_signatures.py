"""Bounds of the n-gram join's signatures, and its large regions of documents put together from common passages."""

import random

import numpy as np
from pyspark.sql import functions as F

from routelake.llm import jaccard_join
from tests.llm.test_llm import brute_components, rows_of, words


def test_signatures_never_rule_out_what_two_sets_share():
    rng = np.random.default_rng(4)
    for n in (1, 3, 60, 64, 65, 700, 5000):
        for kept in (0.0, 0.5, 0.8, 0.9, 1.0):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[: int(len(a) * kept)], rng.integers(0, 1 << 63, max(1, int(n * (1 - kept)))).astype(np.uint64)]))
            x, y = (np.frombuffer(jaccard_join.signature(s), dtype="<u8").reshape(1, -1) for s in (a, b))
            if max(x.shape[1], y.shape[1]) > 2 * min(x.shape[1], y.shape[1]):
                continue
            common = min(x.shape[1], y.shape[1])
            most = jaccard_join.most_shared(jaccard_join.folded(x, common), np.array([len(a)]), jaccard_join.folded(y, common)[0], len(b))[0]
            shared = len(np.intersect1d(a, b))
            assert shared <= most <= min(len(a), len(b))
            if kept == 0.0 and n >= 700:
                assert not jaccard_join.may_link(int(most), len(a), len(b))


def test_large_regions_of_common_passages(spark, monkeypatch):
    """Regions over a leaf, nested ones among them: components as by all pairs, and unlinked classes are not fetched whole."""
    monkeypatch.setattr(jaccard_join, "LEAF", 8)
    fetched = []
    connect = jaccard_join.Space.sets

    def sets(self, sids):
        fetched.append(sids.distinct().count())
        return connect(self, sids)

    monkeypatch.setattr(jaccard_join.Space, "sets", sets)
    rng = random.Random(9)
    passages = [words(30, 300 + i, f"q{i}x").split() for i in range(12)]
    rows = []
    for i in range(160):
        body = [w for p in rng.choices(passages, k=4) for w in p] + words(6, 5000 + i, f"own{i}x").split()
        rows.append((i, " ".join(body)))
    for i in range(160, 172):  # links of some of these, by one word or two, that a region's pivot need not find
        body = rows[rng.randrange(160)][1].split()
        body[-rng.randrange(1, 6)] = f"edit{i}"
        rows.append((i, " ".join(body)))
    docs = rows_of(spark, [(i, t, "en", "s") for i, t in rows]).repartition(3)
    space = jaccard_join.Space(docs)
    regions, _ = space.regions()
    label = regions.select("region", "sid", "n", F.col("sid").alias("component"))
    large = label.join(label.groupBy("region").count().where("count > 8").select("region"), "region")
    assert large.select("sid").distinct().count() > 100
    fetched.clear()
    links = jaccard_join.within(space, large)
    assert links.distinct().count() >= 12 and fetched[-1] <= len(rows) // 3
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs).collect()}
    assert got == brute_components(rows)
