"""Groups that fit a shard stay whole, however few rows are left to swap with."""

from collections import Counter, defaultdict

import pytest

from routelake.llm import sharding

HOT = [(i, "hot") for i in range(800)] + [(800 + i, f"g{n}-{i // n}") for n in (2, 3, 4, 5) for i in range(200 // n * n)]
HOT = [(i, t) for i, (_, t) in enumerate(HOT)]
HOT += [(i, f"own {i}") for i in range(len(HOT), 2400)]
PAIRS = [(i, f"p{i // 2}") for i in range(1200)] + [(1200 + i, f"t{i // 3}") for i in range(960)] + [(i, f"own {i}") for i in range(2160, 2400)]
#: 20 groups of three fifths of a shard and 12 of two fifths, pairs, and no row without links.
FULL = [(i, f"l{i // 60}") for i in range(1200)] + [(1200 + i, f"m{i // 40}") for i in range(480)] + [(1680 + i, f"p{i // 2}") for i in range(720)]
#: 30 groups of three fifths of a shard: 24 fit, 6 must be cut.
OVER = [(i, f"l{i // 60}") for i in range(1800)] + [(1800 + i, f"p{i // 2}") for i in range(600)]


@pytest.mark.parametrize("rows, cut", [(HOT, 0), (PAIRS, 0), (FULL, 0), (OVER, 6)])
def test_groups_that_fit_stay_whole(spark, rows, cut):
    texts = dict(rows)
    out = sharding.propagate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    shards, where = defaultdict(list), defaultdict(Counter)
    for r in out:
        shards[r["shard"]].append(r["slot"])
        where[texts[r["doc_id"]]][r["shard"]] += 1
    assert [sorted(shards[s]) for s in range(sharding.SHARDS)] == [list(range(100))] * sharding.SHARDS
    assert sum(len(s) > 1 for t, s in where.items() if t != "hot") == cut
    assert len(where["hot"]) in (0, 8)  # as many shards as it fills


def test_plan_fills_rooms_exactly():
    room = {0: 5, 1: 5, 2: 4}
    whole, parts = sharding._plan([(3, 0, 4), (2, 1, 1)], room)
    assert sum((last - first + 1) * size for size, _, first, last, _ in whole) + sum(last - first + 1 for *_, first, last, _ in parts) == 14
    assert not any(room.values()) and len({p[:3] for p in parts}) == 1
