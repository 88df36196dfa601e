"""Stages, sources and sinks on small rows."""

import json
import re

import pytest
from pyspark.sql import functions as F

from routelake import session
from routelake.functions import text
from routelake.operators import history, reports, routing, scoring
from routelake.plans import analysis, stages
from routelake.sources import files, models


def test_labels_go_by_batches_and_fail_by_batches(spark):
    rows = [(i, "x" * (9000 if i in (30, 31, 32) else 10)) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, t string").repartition(5)

    def labeller(texts, which):
        if any(len(t) > 100 for t in texts):
            raise RuntimeError("too long")
        return [f"{which}{len(texts)}" for _ in texts]

    out = {r["i"]: r for r in models.label_twice(df, "i", "t", labeller, attempts=2, pause=0).collect()}
    assert len(out) == 60
    assert {out[i]["answer_a"] for i in range(24)} == {"a24"} and {out[i]["answer_b"] for i in range(24)} == {"b24"}
    # The second batch holds 24..31 (two long prompts), the third 32..55, the last 56..59.
    assert all(out[i]["answer_a"] is None and "too long" in out[i]["error"] for i in range(24, 56))
    assert {out[i]["answer_a"] for i in range(56, 60)} == {"a4"}


def test_a_call_is_tried_again(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "i long, t string").coalesce(1)
    mark = str(tmp_path / "tried")

    def flaky(texts, which):
        import os

        if not os.path.exists(f"{mark}-{which}"):
            open(f"{mark}-{which}", "w").close()
            raise RuntimeError("once")
        return [which] * len(texts)

    row = models.label_twice(df, "i", "t", flaky, pause=0).first()
    assert (row["answer_a"], row["answer_b"], row["error"]) == ("a", "b", None)


def test_label_stage_resumes(spark):
    rows = spark.createDataFrame([(i, f"prompt {i}") for i in range(10)], "i long, prompt string")
    none = spark.createDataFrame([], "i long, seq long, label_a struct<task_type:string,difficulty:string,privacy:string>, label_b struct<task_type:string,difficulty:string,privacy:string>")
    good = json.dumps({"task_type": "coding", "difficulty": "easy", "privacy": "low"})
    first = stages.label(rows, none, "i", lambda texts, which: [good] * len(texts), limit=4)
    assert sorted(r["i"] for r in first.rows.collect()) == [0, 1, 2, 3]
    done = first.more["written"].drop("error")
    second = stages.label(rows, done, "i", lambda texts, which: [good if which == "a" else "no label"] * len(texts))
    assert sorted(r["i"] for r in second.rows.collect()) == [0, 1, 2, 3]
    assert {r["i"]: r["seq"] for r in second.more["written"].collect()} == {i: 2 for i in range(4, 10)}
    told = {r["counter"]: r["rows"] for r in second.counters.collect()}
    assert told["label_attempts_completed"] == 10 and told["accepted_labels"] == 4 and told["rejected_task_disagreement_or_invalid"] == 6
    assert stages.label(rows, done, "i", lambda texts, which: [good] * len(texts)).rows.count() == 10


def test_augmentation_labels_no_more_than_it_needs(spark, tmp_path):
    asked = str(tmp_path / "asked")
    open(asked, "w").close()

    def labeller(texts, which):
        with open(asked, "a") as out:
            out.write(which * len(texts))
        return [json.dumps({"task_type": "coding", "difficulty": "easy", "privacy": "high" if int(t) % 3 == 0 else "low"}) for t in texts]

    candidates = spark.createDataFrame([(i, str(i)) for i in range(1000)], "i long, prompt string")
    found = sorted(r["i"] for r in stages.augment(candidates, 7, "i", labeller).collect())
    assert found == [0, 3, 6, 9, 12, 15, 18]
    assert len(open(asked).read()) <= 2 * (stages.AHEAD * 7)
    assert stages.augment(candidates.limit(0), 3, "i", labeller).count() == 0


def test_summary(spark):
    arena = spark.createDataFrame([(True,), (False,), (False,), (False,)], "strong_wins boolean")
    final = spark.createDataFrame([("coding", "easy", "low")] * 3 + [("math", "hard", "high")], "task_type string, difficulty string, privacy string")
    funnel = spark.createDataFrame([("rows_scanned", 12345)], "counter string, rows long")
    told = reports.summary("2026-01-01", arena, final, {"Arena funnel": funnel}, floor=2)
    assert "- Combined records: 8" in told and "- rows_scanned: 12,345" in told and "25.00% — FLAG" in told
    assert "- coding: 3 (75.00%)" in told and "- math: 1 records" in told and "**FLAG:**" not in told


def test_json_lines_survive_a_failed_write(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    files.write_jsonl(spark.range(3), path)
    with pytest.raises(Exception):
        files.write_jsonl(spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("id")), path)
    kept = files.read_jsonl(spark, path, "id long")
    assert kept.count() == 3
    assert files.write_jsonl(kept.unionByName(spark.range(5, 6)), path) == 4
    assert files.read_jsonl(spark, path, "id long").count() == 4


def test_saved_conversations(spark):
    rows = ['{"conversations":[{"id":"a","title":"t","updatedAt":"1","messages":[{"role":"assistant","content":"<think>x</think> y"},{"id":"m","role":"user","content":"<think>u"}]},{"id":5,"messages":[]},{"id":"b","messages":{}},null,{"id":"c","messages":[]}]}', "not json", '{"conversations":7}', "null"]
    saved = history.saved_conversations(spark.createDataFrame([(r,) for r in rows], "json string"), "json")
    got = {r["id"]: [(m["id"], m["content"]) for m in r["messages"]] for r in history.stored_conversations(saved).collect()}
    assert set(got) == {"a", "c"} and got["c"] == []
    assert got["a"][0][1] == "y" and got["a"][0][0].startswith("message-") and got["a"][1] == ("m", "<think>u")


def inline(source):
    """Inline Markdown by a plain reading of the rules."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        source = source.replace(a, b)
    codes = []
    source = re.sub("`([^`]+)`", lambda m: codes.append(f"<code>{m[1]}</code>") or f"\0{len(codes) - 1}\0", source)
    source = re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", source)
    source = re.sub(r"\*([^*]+)\*", r"<em>\1</em>", source)
    source = re.sub(r"\[([^\]]+)\]\((https?://[^)\s]+)\)", r'<a href="\2" target="_blank" rel="noreferrer">\1</a>', source)
    return re.sub("\0(\\d+)\0", lambda m: codes[int(m[1])], source)


def test_inline_markdown(spark):
    import random

    rng = random.Random(6)
    marks = ["a", "b c", "*", "**", "`", "``", "[x](https://e.org/`q`)", "[", "](http://e.org)", '"', "'", "<", "&", "$1", "\\", "", "\n"]
    cases = ["".join(rng.choice(marks) for _ in range(rng.randrange(12))) for _ in range(500)]
    out = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", text.render_inline(F.col("t")).alias("h")).collect()
    assert {r["i"]: r["h"] for r in out} == {i: inline(c) for i, c in enumerate(cases)}


def test_router_model_may_be_missing(spark, tmp_path):
    prompts = spark.createDataFrame([(1, "write code"), (2, "")], "id long, text string")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x").write_text('{"targets":')
    for path in (f"file://{tmp_path}/none", f"file://{tmp_path}/bad"):
        model = scoring.load_router_model(spark, path)
        assert model is None
        assert scoring.predict_with_model(prompts, "id", "text", model).columns == ["id", "text"]
    model = {"targets": ["task_type"], "preprocessing": {"char_ngrams": [2, 3]}, "classifiers": {"task_type": {"labels": ["coding", "math"], "classes": {
        "coding": {"log_prior": -1.0, "unknown_log_likelihood": -5.0, "token_log_likelihoods": {"char:cod": -1.0}}, "math": {"log_prior": -0.5, "unknown_log_likelihood": -5.0, "token_log_likelihoods": {}}}}}}
    got = {r["id"]: r["task_type_label"] for r in scoring.predict_with_model(prompts, "id", "text", model).collect()}
    assert got == {1: "coding", 2: "math"}


def test_without_a_shared_folder_a_cluster_is_refused(monkeypatch):
    class Fake:
        master = "spark://host:7077"
        sparkContext = property(lambda self: self)
        conf = property(lambda self: self)
        get = lambda self, *a: None
        getCheckpointDir = lambda self: None

    with pytest.raises(ValueError):
        session.scratch_dir(Fake())


def test_rules_alone_without_a_prediction(spark):
    empty = {k: F.lit(None).cast("double") for t in ("task", "difficulty") for k in (f"{t}_confidence", f"{t}_margin", f"{t}_coverage", f"{t}_entropy")}
    empty |= {k: F.lit(None).cast("string") for k in ("task_label", "difficulty_label", "privacy_label", "semantic_task", "semantic_difficulty")}
    empty |= {k: F.lit(None).cast("double") for k in ("privacy_confidence", "max_similarity", "strong_win_probability", "semantic_task_share", "semantic_difficulty_share")}
    prompts = spark.createDataFrame([("What is the capital of France?",), (None,)], "prompt string")
    row = next(r for r in analysis.analyze(prompts.withColumns(empty)).collect() if r["prompt"])
    assert row["source"] == "rules" and row["difficulty"] == "easy" and row["complexity_score"] is None and not row["uncertain"]


def test_a_huge_catalog_is_refused(spark, monkeypatch):
    monkeypatch.setattr(routing, "MOST_MODELS", 3)
    with pytest.raises(ValueError):
        routing.listed(spark.range(4))
