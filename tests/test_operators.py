import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from routelake.functions import rules, text
from routelake.operators import relational, similarity
from routelake.operators.components import connected_components
from routelake.plans import curation
from routelake.sources import files, models
from routelake.streaming import logs

# prompt, privacy score and level, difficulty score and level, factual, task, final difficulty
GOLDEN = [
    ("What is the capital of France?", 0, "low", 0, "easy", True, "simple_qa", "easy"),
    ("Write a Python function that merges two sorted lists.", 0, "low", 0, "easy", False, "coding", "easy"),
    ("Summarize this confidential legal agreement for client Jane Doe.", 6, "high", 0, "easy", False, "summarization", "easy"),
    ("Translate this contract to Spanish.", 5, "high", 0, "easy", False, "translation", "easy"),
    ("my email is a@b.com", 7, "high", 0, "easy", False, "unknown", "easy"),
    ("Use sk-abcdefghijklmnop for the api", 5, "high", 0, "easy", False, "unknown", "easy"),
    ("Design a scalable distributed architecture with root cause analysis across multiple regions.", 0, "low", 7, "hard", False, "unknown", "hard"),
    ("Put lunch on the calendar", 3, "medium", 0, "easy", False, "unknown", "easy"),
    ("Explain syntax", 3, "medium", 0, "easy", True, "simple_qa", "easy"),
    ("Plan a short trip", 0, "low", -2, "easy", False, "planning", "easy"),
    ("SSN 123-45-6789", 8, "high", 0, "easy", False, "unknown", "easy"),
    ("Card 4111 1111 1111 1111 ok", 5, "high", 0, "easy", False, "unknown", "easy"),
    ("hello there", 0, "low", 0, "easy", False, "unknown", "easy"),
]


def test_rule_scores(spark):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "i int, p string")
    df, facts = rules.bind(df, "p")
    signals = rules.analyze_rules(facts)
    out = df.select("i", rules.privacy_score(facts), signals["privacy"], rules.difficulty_score(facts), rules.difficulty_level(rules.difficulty_score(facts)), signals["factual_question"], signals["task_type"], signals["difficulty"])
    assert [tuple(r)[1:] for r in sorted(out.collect())] == [g[1:] for g in GOLDEN]


def test_sanitise(spark):
    cases = {"system:\nhello": "", "hi\n\nSystem: x\nbye": "hi bye", "system:\n\n\nkeep?\nnext": "next", "the system: x": "the system: x", "a b\0c": "a b c", " user": "user"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", text.sanitize_prompt(F.col("t"))).collect()} == cases


@pytest.mark.parametrize(
    "sizes, limit, expected",
    [
        ({"a": 10, "b": 10, "c": 80}, 40, {"a": 2, "b": 2, "c": 2}),
        ({"c00": 20} | {f"c{i:02}": 4 for i in range(1, 21)}, 60, {f"c{i:02}": 3 if i <= 17 else 2 for i in range(21)}),
        ({f"c{i:02}": 4 for i in range(25)}, 50, {f"c{i:02}": 2 for i in range(25)}),
    ],
)
def test_quota(spark, sizes, limit, expected):
    out = relational.quota(spark.createDataFrame(list(sizes.items()), "g string, size long"), "g", "size", limit)
    assert {r["g"]: r["allocation"] for r in out.collect()} == expected


def test_greedy_batches_match_a_loop(spark):
    for seed in range(3):
        rng = random.Random(seed)
        lengths = [rng.choice([1, 10, 500, 5000, 30000]) for _ in range(400)]
        batch, count, size, expected = 0, 0, 0, []
        for n in lengths:
            if count and (count >= 24 or size + n > 20_000):
                batch, count, size = batch + 1, 0, 0
            expected.append(batch)
            count, size = count + 1, size + n
        df = spark.createDataFrame(list(enumerate(lengths)), "i int, n int").repartition(7)
        assert [r["batch"] for r in relational.greedy_batches(df, "i", "n").orderBy("i").collect()] == expected
    assert relational.greedy_batches(df.limit(0), "i", "n").count() == 0


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    out = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in out.collect()} == {n: find(n) for n in parent}


def test_similarity_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    v = np.random.default_rng(3).normal(size=(70, 8))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<double>")
    pairs = {(r["a"], r["b"]) for r in similarity.similar_pairs(df, "id", "v", 0.6).collect()}
    s = unit @ unit.T
    assert pairs == {(i, j) for i in range(70) for j in range(i + 1, 70) if s[i, j] > 0.6}
    best = {r["id"]: r["best"] for r in similarity.best_match(df.where("id < 30"), df.where("id >= 30"), "id", "v").collect()}
    assert all(abs(best[i] - s[i, 30:].max()) < 1e-9 for i in range(30))
    assert similarity.without_matches(df, df.limit(0), "id", "v").count() == 70


def test_jsonl(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    assert files.write_jsonl(df, path) == 2
    assert sorted(map(tuple, files.read_jsonl(spark, path, "n int, s string").collect())) == [(1, "a"), (2, None)]
    assert files.read_jsonl(spark, path + "-none", "n int, s string").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.json").write_text('{"n":1,"s":"a"}\nnot json\n\n{"n":2,"s":"b"}')
    assert files.read_jsonl(spark, f"file://{tmp_path}/bad", "n int, s string", lenient=True).count() == 2
    with pytest.raises(Exception):
        files.read_jsonl(spark, f"file://{tmp_path}/bad", "n int, s string").collect()
    files.write_document(spark, {"a": 1}, f"file://{tmp_path}/doc")
    assert files.read_document(spark, f"file://{tmp_path}/doc") == {"a": 1}
    assert files.read_document(spark, f"file://{tmp_path}/nodoc") is None


def test_embedding_cache_and_retries(spark, tmp_path):
    calls = []

    def embed(df):
        calls.append(df.count())
        return df.select("prompt_hash", F.array(F.lit(1.0).cast("float")).alias("embedding"))

    own = spark.createDataFrame([("a",), ("b",)], "prompt_hash string")
    more = spark.createDataFrame([("a",), ("c",)], "prompt_hash string")
    assert files.cached_embeddings(own, f"file://{tmp_path}/cache", embed).count() == 2
    assert files.cached_embeddings(more, f"file://{tmp_path}/cache", embed).count() == 2
    assert calls == [2, 1]

    def only_short(items):
        if len(items) > 2:
            raise ValueError("too many")
        return [x.upper() for x in items]

    assert models.with_bisection(only_short, list("abcde"), pause=0) == list("ABCDE")
    out = models.embed(spark.createDataFrame([(1, "x"), (2, "yy")], "i long, t string"), "i", "t", lambda ts: [[3.0 * len(t), 4.0 * len(t)] for t in ts])
    assert all(abs(r["embedding"][0] - 0.6) < 1e-6 for r in out.collect())


def test_failed_labelling_is_retried_later(spark):
    df = spark.createDataFrame([(1, "x")], "i long, t string")

    def fail(texts, which):
        raise RuntimeError("down")

    row = models.label_twice(df, "i", "t", fail).first()
    assert row["answer_a"] is None and row["answer_b"] is None and "down" in row["error"]


def test_streams(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.json").write_text('{"k":"x","seq":1,"v":1}\n{"k":"y","seq":2,"v":2}\n')
    (tmp_path / "log/b.json").write_text('{"k":"x","seq":3,"v":3}')
    stream = logs.read_log(spark, f"file://{tmp_path}/log", "k string, seq int, v int")
    q = logs.latest_by_key(stream, "k", "seq").writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.sql("select k, v from latest").collect()} == {("x", 3), ("y", 2)}
    q = logs.append_batches(logs.read_log(spark, f"file://{tmp_path}/log", "k string, seq int, v int"), f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
    q.awaitTermination(60)
    assert spark.read.json(f"file://{tmp_path}/out/*").count() == 3


def test_final_stage(spark):
    rows = [(i, [1.0, 0.0] if i == 0 else [0.0, 1.0], "low") for i in range(3)]
    agreed = spark.createDataFrame(rows, "id long, v array<double>, privacy string")
    arena = spark.createDataFrame([(9, [1.0, 0.01])], "id long, v array<double>")
    more = spark.createDataFrame([(7, "high")], "id long, privacy string")
    assert sorted(r["id"] for r in curation.finalize(agreed, arena, more, "id", "v").collect()) == [1, 2, 7]
    assert curation.augmentation_needed(spark.createDataFrame([("low",)] * 95 + [("high",)] * 5, "privacy string")) == 6
    kept = curation.deduplicate_by_similarity(agreed, "id", "v", 0.95)
    assert sorted(r["id"] for r in kept.collect()) == [0, 1]
