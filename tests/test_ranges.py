"""Places, running sums, quantiles and batches over ranges, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from routelake.operators import ranges, relational


def skewed(spark, n=600):
    """A hot key with two thirds of the rows, a null key, and small ones; values repeat."""
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.66 else rng.choice(["a", "b", None]), rng.randrange(40), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, v long, i long").repartition(5)


def test_places_and_sums(spark):
    rows, df = skewed(spark)
    out = ranges.placed(ranges.running(df, ["g"], ["v", "i"], F.col("v"), "upto"), ["g"], [F.desc("v"), "i"], "place")
    got = {r["i"]: (r["upto"], r["place"]) for r in out.collect()}
    for g in {r[0] for r in rows}:
        mine = sorted((v, i) for k, v, i in rows if k == g)
        upto, down = np.cumsum([v for v, _ in mine]), sorted(mine, key=lambda x: (-x[0], x[1]))
        assert [got[i][0] for _, i in mine] == upto.tolist()
        assert [got[i][1] for _, i in down] == list(range(1, len(mine) + 1))


def test_places_of_a_whole_table(spark):
    rows, df = skewed(spark)
    got = [r["i"] for r in ranges.placed(df, [], ["i"], "place").orderBy("place").collect()]
    assert got == list(range(600))
    assert ranges.placed(df.limit(0), [], ["i"], "place").count() == 0


def test_a_hot_key_lies_in_many_ranges(spark):
    _, df = skewed(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        before = df.repartitionByRange(16, "g", "v", "i").withColumn("p", F.spark_partition_id())
        most = before.where("g = 'hot'").groupBy("p").count()
        assert most.count() >= 8 and most.agg(F.max("count")).first()[0] <= 100
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("shares", [[0.25, 0.5, 0.75], [0.0, 1.0, 0.1, 0.333]])
def test_quantiles(spark, shares):
    rows, df = skewed(spark)
    df = df.unionByName(spark.createDataFrame([("one", 5, 0), ("hot", None, 0), ("none", None, 0)], df.schema))
    got = {r["g"]: (r["rows"], r["quantiles"]) for r in ranges.quantiles(df, "g", "v", shares).collect()}
    assert set(got) == {"hot", "a", "b", None, "one"}
    for g in {r[0] for r in rows}:
        mine = [v for k, v, _ in rows if k == g]
        assert got[g][0] == len(mine)
        assert got[g][1] == pytest.approx(np.quantile(mine, shares).tolist())
    assert got["one"][1] == [5.0] * len(shares)


def test_stratified_sample_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", rng.randrange(1, 900), f"{rng.getrandbits(64):016x}") for i in range(500)]
    df = spark.createDataFrame(rows, "i long, g string, n long, h string").repartition(6)
    limit = 200
    got = sorted(r["i"] for r in relational.stratified_sample(df, "g", "n", "h", limit).collect())
    sizes = df.groupBy("g").agg(F.count("*").alias("s"))
    allocation = {r["g"]: r["allocation"] for r in relational.quota(sizes, "g", "s", limit).collect()}
    want = []
    for g, share in allocation.items():
        mine = [r for r in rows if r[1] == g]
        q = np.quantile([r[2] for r in mine], [0.25, 0.5, 0.75])
        bins = [sorted((r[3], r[0]) for r in mine if (0 if len(mine) < 4 else sum(r[2] > x for x in q)) == b) for b in range(4)]
        turns = [(k, b, i) for b, rows_ in enumerate(bins) for k, (_, i) in enumerate(rows_)]
        want += [i for _, _, i in sorted(turns)[:share]]
    assert got == sorted(want)


@pytest.mark.parametrize("size,wide", [(24, 3), (50, 2), (4096, 4096)])
def test_batches_in_ranges_of_bounded_size(spark, monkeypatch, size, wide):
    monkeypatch.setattr(relational, "RANGE", size)
    monkeypatch.setattr(relational, "WIDE", wide)
    rng = random.Random(size)
    lengths = [rng.choice([1, 10, 500, 5000, 30000]) for _ in range(500)]
    batch, count, total, expected = 0, 0, 0, []
    for n in lengths:
        if count and (count >= 24 or total + n > 20_000):
            batch, count, total = batch + 1, 0, 0
        expected.append(batch)
        count, total = count + 1, total + n
    df = spark.createDataFrame([(i * 3, n) for i, n in enumerate(lengths)], "i int, n int").repartition(7)
    assert [r["batch"] for r in relational.greedy_batches(df, "i", "n").orderBy("i").collect()] == expected
