"""Logs, streams, exports and clusters against plain Python."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from routelake.functions import text
from routelake.operators import clustering, history
from routelake.sources import files
from routelake.streaming import feedback, logs


def test_a_batch_is_added_once(spark, tmp_path):
    path, df = f"file://{tmp_path}/log", spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert files.append_jsonl(df, path, 1) and not files.append_jsonl(df, path, 1)
    assert files.append_jsonl(df.limit(1), path, 2)
    assert files.batches_of(spark, path) == [1, 2]
    assert sorted((r["k"], r["batch_seq"]) for r in files.read_batches(spark, path, "k int, v string, batch_seq long").collect()) == [(1, 1), (1, 2), (2, 1)]
    assert files.read_batches(spark, f"{path}-none", "k int").count() == 0


def test_a_failed_batch_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    bad = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("down"))).otherwise(F.col("id")).alias("k"))
    with pytest.raises(Exception):
        files.append_jsonl(bad, path, 1)
    assert files.batches_of(spark, path) == [] and files.append_jsonl(spark.range(3).toDF("k"), path, 1)


def test_unfinished_lines_wait(spark, tmp_path):
    (tmp_path / "in").mkdir()
    a, b = tmp_path / "in/a.log", tmp_path / "in/b.log"
    source, out, plans = f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/plans"
    whole = "".join(json.dumps({"i": i, "s": "é€" * (i % 5)}, ensure_ascii=False) + "\n" for i in range(40)).encode()
    lines = lambda: sorted(r["line"] for r in files.read_batches(spark, out, "path string, line string").collect())
    told = [x for x in whole.decode().split("\n") if x]
    a.write_bytes(whole[:301])
    assert logs.follow_lines(spark, source, out, plans) == 1
    assert lines() == sorted(whole[:301].decode(errors="ignore").split("\n")[:-1])
    assert logs.follow_lines(spark, source, out, plans) is None
    a.write_bytes(whole[:302])
    assert logs.follow_lines(spark, source, out, plans) is None
    a.write_bytes(whole)
    b.write_bytes(b"no end yet")
    assert logs.follow_lines(spark, source, out, plans) == 2
    assert lines() == sorted(told)
    b.write_bytes(b"no end yet\r\n\n")
    assert logs.follow_lines(spark, source, out, plans) == 3
    assert lines() == sorted([*told, "no end yet"])


def test_a_failed_step_is_read_again(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("one\ntwo\nthr")
    source, out, plans = f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/plans"
    write = logs._write_lines
    monkeypatch.setattr(logs, "_write_lines", lambda *a: (_ for _ in ()).throw(OSError("down")))
    with pytest.raises(OSError):
        logs.follow_lines(spark, source, out, plans)
    monkeypatch.setattr(logs, "_write_lines", write)
    (tmp_path / "in/a.log").write_text("one\ntwo\nthree\n")
    assert logs.follow_lines(spark, source, out, plans) == 2
    assert sorted((r["line"], r["batch_seq"]) for r in files.read_batches(spark, out, "line string, batch_seq long").collect()) == [("one", 1), ("three", 2), ("two", 1)]


def test_feedback_stream_is_the_batch_fold_after_two_restarts(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.randrange(12), i, rng.choice(["positive", "negative", "correct"]), f"m{i % 3}", f"c{i % 4}") for i in range(300)]
    schema = "user long, at long, kind string, selected string, choice string"
    df = spark.createDataFrame(rows, schema)
    log, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("clicks", "folded", "state"))
    for batch, (low, high) in enumerate(((0, 90), (90, 91), (91, 300)), 1):
        files.append_jsonl(df.where(f"at >= {low} and at < {high}"), log, batch)
        feedback.start(logs.read_log(spark, log, schema), "user", "at", out, checkpoint).awaitTermination(120)
    last = files.read_batches(spark, out, "user long, rating string, expected string, batch_seq long")
    got = {r["user"]: (r["rating"], r["expected"]) for r in sorted(last.collect(), key=lambda r: r["batch_seq"])}
    assert got == {r["user"]: (r["rating"], r["expected"]) for r in history.fold_feedback(df, "user", "at").collect()}


def test_export_in_parts(spark, tmp_path):
    examples = spark.createDataFrame([(3, "é\n\"x\""), (1, None), (2, ",a")], "i int, t string").repartition(3)
    decisions = examples.limit(0)
    history.feedback_document(examples, decisions, "now", f"file://{tmp_path}/doc", (["i"], ["i"]))
    found = "".join(p.read_text() for d in sorted((tmp_path / "doc").iterdir()) for p in sorted(d.glob("part-*")))
    assert json.loads(found) == {"schema_version": 1, "exported_at": "now", "training_examples": [{"i": 1, "t": None}, {"i": 2, "t": ",a"}, {"i": 3, "t": "é\n\"x\""}], "route_decisions": []}
    back = files.read_part(spark, f"file://{tmp_path}/doc", "training_examples", 0, "i int, t string")
    assert sorted(map(tuple, back.collect())) == [(1, None), (2, ",a"), (3, "é\n\"x\"")]


def plain_flagged(value):
    if isinstance(value, bool) or value is None:
        return bool(value)
    if isinstance(value, dict):
        categories = value.get("categories")
        return value.get("flagged") is True or isinstance(categories, dict) and any(v is True for v in categories.values())
    return isinstance(value, list) and any(plain_flagged(v) for v in value)


def test_moderation_at_any_depth(spark):
    rng = random.Random(2)

    def value(depth):
        kind = rng.randrange(9)
        if depth and kind < 6:
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        return [True, False, None, "true", "a,[true]{\"", 1.5, {"flagged": rng.random() < 0.3}, {"categories": {"x": rng.random() < 0.3, "flagged": "true"}}, {"other": [True, {"flagged": True}]}, {"flagged": "true", "categories": [True]}, {"flagged": None}][rng.randrange(1, 11)]

    values = [value(rng.randrange(12)) for _ in range(300)]
    for depth in (9, 40):
        for own in (True, False, {"flagged": True}, {"x": {"flagged": True}}, {"categories": {"a": True}}):
            for _ in range(depth):
                own = [own]
            values.append([[], own])
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string")
    got = {r["i"]: r["f"] for r in df.select("i", text.moderation_flagged(F.parse_json("j")).alias("f")).collect()}
    assert got == {i: plain_flagged(v) for i, v in enumerate(values)}
    assert spark.sql("select 1").select(text.moderation_flagged(F.parse_json(F.lit(None).cast("string")))).first()[0] is False


def test_mini_batches(spark):
    rng = np.random.default_rng(0)
    middle = rng.normal(size=(6, 5)) * 8
    m = middle[rng.integers(6, size=900)] + rng.normal(size=(900, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>").repartition(3)
    centres = clustering.mini_batch_kmeans(df, "id", "v", clusters=6, batch=300, rounds=5)
    places = np.array([r["centre"] for r in centres.orderBy("cluster_id").collect()])
    rows = {r["id"]: r["cluster_id"] for r in clustering.assigned(df, "v", centres).collect()}
    near, apart = clustering.nearest_centre(m, places)
    assert [rows[i] for i in range(900)] == near.tolist()
    assert [r["rows"] for r in centres.orderBy("cluster_id").collect()] == np.bincount(near, minlength=6).tolist()
    best = ((m - middle[((m[:, None] - middle) ** 2).sum(axis=2).argmin(axis=1)]) ** 2).sum()
    assert apart.sum() < 1.5 * best or len(places) == 6 and apart.sum() < 4 * best
    assert [tuple(r) for r in clustering.mini_batch_kmeans(df, "id", "v", clusters=6, batch=300, rounds=5).collect()] == [tuple(r) for r in centres.collect()]


def test_one_round_of_mini_batches_by_hand(spark, monkeypatch):
    """Two batches, once each: centres move by counts and rates."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(200, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    got = np.array([r["centre"] for r in clustering.mini_batch_kmeans(df, "id", "v", clusters=4, batch=100, rounds=1).orderBy("cluster_id").collect()])
    seed = clustering.SEED
    batch = np.array([r["b"] for r in df.orderBy("id").select(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(2)).alias("b")).collect()])
    order = [r["id"] for r in df.orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id").collect()]
    centres, had = clustering.first_centres(m[order[: 4 * clustering.SAMPLE]], 4, seed), [0] * 4
    for turn in range(2):
        own = m[batch == turn]
        near = [min(range(4), key=lambda c: ((x - centres[c]) ** 2).sum()) for x in own]
        for c in range(4):
            mine = own[[n == c for n in near]]
            had[c] += len(mine)
            if len(mine):
                centres[c] += len(mine) / had[c] * (mine.mean(axis=0) - centres[c])
    assert np.abs(got - centres).max() < 1e-9


def test_clusters_of_little(spark):
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert clustering.mini_batch_kmeans(empty, "id", "v").count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id long, v array<double>")
    centres = clustering.mini_batch_kmeans(one, "id", "v")
    assert {r["id"]: r["cluster_id"] for r in clustering.assigned(one, "v", centres).collect()} == {1: 0, 2: None}
