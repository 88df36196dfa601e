"""Signals of prompts: rules, predictions and neighbours put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.functions import rules
from routelake.operators.relational import small
from routelake.operators.similarity import knn_votes


def with_rules(prompts: DataFrame, prompt: str = "prompt") -> DataFrame:
    """``prompts`` with the rule signals."""
    bound, facts = rules.bind(prompts, prompt)
    return rules.unbind(bound.withColumns(rules.analyze_rules(facts)))


def semantic_signals(neighbours: DataFrame, examples: DataFrame, example_id: str) -> DataFrame:
    """query, max_similarity, strong_win_probability, semantic task and difficulty with their shares.

    ``neighbours`` has query, example, similarity, rank; ``examples`` route_class, task_type, difficulty.
    """
    near = neighbours.join(small(examples.withColumnRenamed(example_id, "example")), "example")
    usable = near.where("similarity > 0.2").withColumn("_w", F.pow("similarity", F.lit(3)))
    strong = F.sum(F.when(F.col("route_class").startswith("cloud_"), F.col("_w")).otherwise(0.0)) / F.sum("_w")
    facts = usable.groupBy("query").agg(F.max("similarity").alias("max_similarity"), strong.alias("strong_win_probability"))
    task = knn_votes(near, "task_type").select("query", F.col("task_type").alias("semantic_task"), F.col("share").alias("semantic_task_share"))
    difficulty = knn_votes(near, "difficulty").select("query", F.col("difficulty").alias("semantic_difficulty"), F.col("share").alias("semantic_difficulty_share"))
    return facts.join(task, "query").join(difficulty, "query")


def analyze(prompts: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Fuse rule signals with predictions and semantic signals that stand beside each prompt.

    Reads task_*, difficulty_* and privacy_* (label, confidence, margin, coverage, entropy) and the
    semantic columns; rows without a task prediction keep the rules alone.  Every pass over a
    prompt's text is a column of its own, so that no output repeats one.
    """
    bound, facts = rules.bind(prompts, prompt)
    signals = rules.analyze_rules(facts)
    bound = bound.withColumns({f"_signal_{k}": v for k, v in signals.items()})
    r = {k: F.col(f"_signal_{k}") for k in signals}
    c = F.col
    selected = F.when(r["factual_question"] & ~r["coding"], "simple_qa").otherwise(rules.select_task_type(r["task_type"], c("task_label"), c("task_confidence"), c("task_margin"), c("task_coverage")))
    told = F.coalesce((r["task_type"] == "unknown") & (c("max_similarity") >= 0.68) & (c("semantic_task_share") >= 0.52), F.lit(False))
    with_task = bound.withColumn("_task", F.when(told, c("semantic_task")).otherwise(selected))
    ml = rules.difficulty_evidence(c("difficulty_label"), c("difficulty_confidence"), c("difficulty_margin"), c("difficulty_coverage"))
    semantic = rules.semantic_evidence(c("max_similarity"), c("strong_win_probability"), c("semantic_difficulty"), c("semantic_difficulty_share"))
    with_task = with_task.withColumns({"_ml": ml, "_semantic": semantic})
    scored = rules.complexity(facts, c("_task"), c("_ml"), c("_semantic"))
    with_task = with_task.withColumns({f"_deep_{k}": v for k, v in scored.items()})
    deep = {k: c(f"_deep_{k}") for k in scored}
    privacy = rules.stronger_privacy(r["privacy"], c("privacy_label"))
    learned = c("task_label").isNotNull()
    either = lambda a, b: F.when(learned, a).otherwise(b)
    long_prompt = r["long_prompt"]
    fused = with_task.withColumns(
        {
            "difficulty_evidence": either(c("_ml"), F.lit(None)),
            "semantic_evidence": either(c("_semantic"), F.lit(None)),
            "complexity_score": either(deep["score"], F.lit(None)),
            "private": either(privacy == "high", r["private"]),
            "coding": either((c("_task") == "coding") | r["coding"], r["coding"]),
            "complex": either((deep["label"] == "hard") | long_prompt, r["complex"]),
            "simple": either((deep["label"] == "easy") & ~long_prompt, r["simple"]),
            "long_prompt": long_prompt,
            "task_type": either(c("_task"), r["task_type"]),
            "difficulty": either(deep["label"], r["difficulty"]),
            "privacy": either(privacy, r["privacy"]),
            "requires_long_context": either(deep["long_context"] > 0, F.lit(False)),
            "confidence": either(rules.routing_confidence(c("task_confidence"), c("privacy_confidence"), c("difficulty_confidence"), deep["score"]), F.lit(None)),
            "uncertain": either(rules.is_uncertain(*[(c(f"{t}_coverage"), c(f"{t}_margin"), c(f"{t}_entropy")) for t in ("task", "difficulty")]), F.lit(False)),
            "source": either(F.lit("ml"), F.lit("rules")),
        }
    )
    own = [n for n in fused.columns if n in ("_task", "_ml", "_semantic") or n.startswith(("_signal_", "_deep_"))]
    return rules.unbind(fused.drop(*own))
