"""The curation stages: battles to preferences, chats to a sample, a sample to labels, labels to a final set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelake.functions import lexicon as lx
from routelake.functions.labels import resolve_labels
from routelake.functions.text import is_english, model_tier, prompt_hash
from routelake.operators import relational as rel
from routelake.operators.clustering import SEED, assigned, mini_batch_kmeans
from routelake.operators.similarity import near_duplicates, without_matches
from routelake.session import staged


def deduplicate_by_similarity(df: DataFrame, id_col: str, vector: str, threshold: float = 0.95) -> DataFrame:
    """The rows whose id is the smallest of their component of pairs over the threshold."""
    kept = near_duplicates(df, id_col, vector, threshold).where(F.col(id_col) == F.col("component")).select(id_col)
    return df.join(kept, id_col, "left_semi")


def battle_reasons(battles: DataFrame) -> DataFrame:
    """Battles (seq, model_a, model_b, win_a, win_b, tie, prompt already sanitised) with tiers and the first reason to drop."""
    won = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    tiers = battles.withColumn("tier_a", model_tier(F.col("model_a"))).withColumn("tier_b", model_tier(F.col("model_b")))
    skip = (F.col("tier_a") == "skip") | (F.col("tier_b") == "skip")
    checks = [("dropped_skip_model", skip), ("dropped_same_tier", F.col("tier_a") == F.col("tier_b")), ("dropped_unclear_winner", ~won("tie") & (won("win_a") == won("win_b"))), ("dropped_empty_prompt", F.length("prompt") == 0)]
    reason = tiers.withColumn("reason", rel.first_reason(checks)).withColumn("prompt_hash", prompt_hash(F.col("prompt")))
    return mark_repeats(reason, "prompt_hash", "seq", "dropped_exact_duplicate")


def mark_repeats(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Rows that pass so far and repeat a key that an earlier passing row has get the reason ``name``.

    The rows are staged, so that texts are cleaned and hashed once; only keys that occur more
    than once meet them again.
    """
    held = staged(df, "reasons")
    first = held.where("reason = 'kept'").groupBy(F.col(key).alias("_k")).agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    late = (F.col("reason") == "kept") & (F.col(order) > F.col("_first"))
    known = held.join(rel.small(staged(first, "repeated")), F.col(key) == F.col("_k"), "left")
    return known.withColumn("reason", F.when(F.coalesce(late, F.lit(False)), name).otherwise(F.col("reason"))).drop("_k", "_first")


def preferences(reasoned: DataFrame) -> DataFrame:
    """Kept battles as seq, prompt, strong_wins (a tie: no), source, language."""
    won = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    strong = F.when(won("tie"), F.lit(False)).otherwise(F.when(F.col("tier_a") == "strong", won("win_a")).otherwise(won("win_b")))
    return reasoned.where("reason = 'kept'").select("seq", "prompt", strong.alias("strong_wins"), F.lit("arena_55k").alias("source"), F.lit("en").alias("language"))


def model_appearances(battles: DataFrame) -> DataFrame:
    """model, tier, appearances over both sides of all battles."""
    both = battles.select(F.explode(F.array("model_a", "model_b")).alias("model"))
    return both.groupBy("model").agg(F.count("*").alias("appearances")).withColumn("tier", model_tier(F.col("model")))


def eligibility(chats: DataFrame, prompt: Column, language: Column, order: str, flagged: Column | None = None) -> DataFrame:
    """Chats with sanitised ``prompt``, ``prompt_hash`` and ``reason``: language, length, moderation, then repeats."""
    checks = [("dropped_under_20_chars", F.length("prompt") < 20), ("dropped_over_2000_chars", F.length("prompt") > 2000), ("dropped_non_english", ~is_english(language))]
    if flagged is not None:
        checks.append(("dropped_moderation", flagged))
    own = chats.withColumn("prompt", prompt)
    return mark_repeats(own.withColumn("reason", rel.first_reason(checks)).withColumn("prompt_hash", prompt_hash(F.col("prompt"))), "prompt_hash", order, "dropped_exact_duplicate")


def pending(sample: DataFrame, checkpoint: DataFrame, key: str, order: str) -> DataFrame:
    """Sample rows without a latest checkpoint row that has both labels."""
    done = rel.latest(checkpoint, key, order).where("label_a is not null and label_b is not null").select(key)
    return sample.join(done, key, "left_anti")


def accepted_labels(sample: DataFrame, checkpoint: DataFrame, key: str) -> DataFrame:
    """Sample rows whose two labels resolve, with the resolved label."""
    both = sample.join(checkpoint.select(key, "label_a", "label_b"), key).withColumn("label", resolve_labels(F.col("label_a"), F.col("label_b")))
    return both.where("label is not null").withColumn("label_agreement", F.col("label_a") == F.col("label_b"))


def privacy_candidates(chats: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Kept chats with a privacy term whose hash is not in ``existing`` (prompt_hash), the first of each hash."""
    named = F.col("prompt").rlike(rf"(?iuU)\b({lx.PRIVATE_PROMPT})\b")
    found = chats.where("reason = 'kept'").where(named).join(existing.select("prompt_hash").distinct(), "prompt_hash", "left_anti")
    return rel.keep_first(found, ["prompt_hash"], [order])


def augmentation_needed(final: DataFrame, already: int = 0) -> int:
    """How many high-privacy rows to add so that, from under 8 %, they come to a tenth."""
    n, high = final.agg(F.count("*"), F.count_if(F.col("privacy") == "high")).first()
    return max(0, -(-(n - high) // 9) - high - already) if n and high / n < 0.08 else 0


def take_needed(candidates: DataFrame, needed: int, order: str) -> DataFrame:
    """The first candidates on which both passes agree in all fields and say high privacy."""
    agreed = candidates.where("label_a = label_b and label_a.privacy = 'high'")
    return agreed.orderBy(order).limit(needed)


def finalize(agreed: DataFrame, arena: DataFrame, augmented: DataFrame, id_col: str, vector: str, threshold: float = 0.92) -> DataFrame:
    """Agreed rows without a match among the battles, and all augmented rows."""
    return without_matches(agreed, arena, id_col, vector, threshold).unionByName(augmented, allowMissingColumns=True)


def kmeans_clusters(df: DataFrame, id_col: str, vector: str, clusters: int = 200, seed: int = SEED) -> DataFrame:
    """``df`` with cluster_id of a fitted mini-batch k-means with min(clusters, max(2, rows // 50)) centres."""
    return assigned(df, vector, mini_batch_kmeans(df, id_col, vector, clusters, seed))
