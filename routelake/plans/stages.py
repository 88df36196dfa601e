"""The four curation stages as a whole.  Each takes tables and returns tables; what to embed, cluster or
label with is handed in, so that a stage runs the same over a model, a cache or a table of answers.

Counters come as short tables (counter, rows), one row for each; together they account for every row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelake.functions.labels import parse_label, resolve_labels
from routelake.functions.text import model_reason, prompt_hash
from routelake.operators import relational as rel
from routelake.operators.reports import agreement
from routelake.operators.similarity import without_matches
from routelake.plans import curation
from routelake.session import staged
from routelake.sources.models import Labeller, label_twice

#: Adds ``embedding`` to rows that have ``prompt`` and ``prompt_hash``.
Embed = Callable[[DataFrame], DataFrame]


@dataclass
class Stage:
    """A stage's rows, its counters, and further tables by name."""

    rows: DataFrame
    counters: DataFrame
    more: dict[str, DataFrame] = field(default_factory=dict)


def counted(df: DataFrame, **counts: Column) -> DataFrame:
    """counter, rows: the named aggregates of a table, in one pass."""
    told = df.agg(*[value.alias(name) for name, value in counts.items()])
    each = F.array(*[F.struct(F.lit(name).alias("counter"), F.coalesce(F.col(name).cast("long"), F.lit(0)).alias("rows")) for name in counts])
    return told.select(F.explode(each).alias("_c")).select("_c.*")


def dropped(reasoned: DataFrame, **more: Column) -> DataFrame:
    """The rows by reason, and the named aggregates over all of them."""
    return rel.funnel(reasoned.where("reason <> 'kept'"), "reason").select(F.col("reason").alias("counter"), "rows").unionByName(counted(reasoned, **more))


def arena(battles: DataFrame, embed: Embed, threshold: float = 0.95) -> Stage:
    """Battles (seq, model_a, model_b, win_a, win_b, tie, prompt) to preferences without near copies; ``tiers`` maps the models seen."""
    reasoned = curation.battle_reasons(battles)
    tie = F.coalesce(F.col("tie").cast("boolean"), F.lit(False))
    kept = F.col("reason") == "kept"
    own = reasoned.where(kept).select("seq", "prompt_hash", F.when(tie, "tie_as_weak_win").otherwise("observed_winner").alias("label_origin"))
    rows = staged(embed(curation.preferences(reasoned).join(own, "seq")), "arena-embedded")
    final = staged(curation.deduplicate_by_similarity(rows, "seq", "embedding", threshold), "arena-final")
    tied = F.count_if(F.col("label_origin") == "tie_as_weak_win")
    counters = dropped(reasoned, total_battles=F.count("*"), ties_labeled_weak_win=F.count_if(kept & tie), after_filter_and_exact_dedup=F.count_if(kept))
    last = final.agg(F.count("*").alias("n"), tied.alias("t")).crossJoin(F.broadcast(rows.agg(F.count("*").alias("all"))))
    counters = counters.unionByName(counted(last, final_records=F.sum("n"), final_ties_labeled_weak_win=F.sum("t"), dropped_near_duplicate=F.sum(F.col("all") - F.col("n"))))
    tiers = curation.model_appearances(battles).withColumn("reason", model_reason(F.col("model")))
    return Stage(final, counters, {"tiers": tiers})


def sample(chats: DataFrame, prompt: Column, language: Column, order: str, cluster: Callable[[DataFrame], DataFrame], target: int = 30_000, pool: int = 60_000, flagged: Column | None = None) -> Stage:
    """Chats to a sample for labelling: eligible prompts, the pool of those with the smallest hashes, clusters
    (``cluster`` adds cluster_id), quotas, and from each cluster its length bins in turn; numbered by hash."""
    reasoned = curation.eligibility(chats, prompt, language, order, flagged)
    drawn = rel.hash_reservoir(reasoned.where("reason = 'kept'").drop("reason"), "prompt_hash", pool, order)
    clustered = staged(cluster(drawn).withColumn("_length", F.length("prompt")), "sample-clustered")
    sizes = clustered.groupBy("cluster_id").agg(F.count("*").alias("size"))
    chosen = staged(rel.hash_order(rel.stratified_sample(clustered, "cluster_id", "_length", "prompt_hash", target), "prompt_hash", order).drop("_length", "length_bin"), "sample-chosen")
    picked = chosen.groupBy("cluster_id").agg(F.count("*").alias("selected"))
    clusters = sizes.join(picked, "cluster_id", "left").select("cluster_id", "size", F.coalesce("selected", F.lit(0)).alias("selected"))
    counters = dropped(reasoned, rows_scanned=F.count("*"), eligible_unique=F.count_if(F.col("reason") == "kept"))
    told = counted(clusters, candidate_pool=F.sum("size"), sampled_for_labeling=F.sum("selected"), clusters=F.count("*"), largest_cluster_contribution=F.max("selected"))
    return Stage(chosen, counters.unionByName(told), {"clusters": clusters})


def label(rows: DataFrame, checkpoint: DataFrame, key: str, labeller: Labeller, limit: int = 0, order: str | None = None) -> Stage:
    """A sample (key, prompt) to rows whose two labels resolve.  ``checkpoint`` (key, seq, label_a, label_b) tells what was
    labelled before; rows that lack a label, the first ``limit`` of them, are labelled in batches.  ``written`` is to be appended to it."""
    order = order or key
    pending = rel.scan_limit(curation.pending(rows, checkpoint, key, "seq"), limit, order)
    answers = label_twice(pending, key, "prompt", labeller, order)
    turn = checkpoint.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).cast(checkpoint.schema["seq"].dataType).alias("seq"))
    written = answers.crossJoin(F.broadcast(turn)).select(key, "seq", parse_label(F.col("answer_a")).alias("label_a"), parse_label(F.col("answer_b")).alias("label_b"), "error")
    written = staged(written, "label-written")
    done = rel.latest(checkpoint.select(key, "seq", "label_a", "label_b").unionByName(written.drop("error")), key, "seq")
    own = staged(rows.join(done.drop("seq"), key, "left").withColumn("label", resolve_labels(F.col("label_a"), F.col("label_b"))), "label-done")
    accepted = own.where("label is not null").withColumns({"label_agreement": F.col("label_a") == F.col("label_b"), "task_type_agreement": F.lit(True), "label_resolution": F.lit("lower_difficulty_higher_privacy")})
    tried = counted(done, label_attempts_completed=F.count("*"))
    found = counted(own, sampled_for_labeling=F.count("*"), exact_label_agreements=F.count_if(F.col("label").isNotNull() & (F.col("label_a") == F.col("label_b"))), task_type_agreements=F.count("label"), accepted_labels=F.count("label"))
    left = counted(done.withColumn("_l", resolve_labels(F.col("label_a"), F.col("label_b"))), rejected_task_disagreement_or_invalid=F.count_if(F.col("_l").isNull()))
    kept = accepted.select(*rows.columns, "label.*", "label_agreement", "task_type_agreement", "label_resolution")
    return Stage(kept, tried.unionByName(found).unionByName(left), {"written": written, "agreement": agreement(done)})


#: Candidates labelled in one round of the augmentation, as a multiple of what is still needed.
AHEAD = 4


def augment(candidates: DataFrame, needed: int, key: str, labeller: Labeller) -> DataFrame:
    """The first candidates (key, prompt, ...) by key on which both passes agree and say high privacy, ``needed`` of them.

    Walks the candidates in rounds, each labelling a few times what is still needed, so no more are labelled than that.
    """
    found, last, left = None, None, needed
    while left > 0:
        rest = candidates if last is None else candidates.where(F.col(key) > F.lit(last))
        part = staged(rel.scan_limit(rest, AHEAD * left, key), "augment-round")
        end = part.agg(F.max(key)).first()[0]
        if end is None:
            break
        answers = label_twice(part, key, "prompt", labeller)
        both = part.join(answers, key).select(*part.columns, parse_label(F.col("answer_a")).alias("label_a"), parse_label(F.col("answer_b")).alias("label_b"))
        taken = staged(curation.take_needed(both, left, key).select(*part.columns, "label_a.*"), "augment-taken")
        found = taken if found is None else found.unionByName(taken)
        left, last = left - taken.count(), end
    empty = "task_type string, difficulty string, privacy string"
    return found if found is not None else candidates.limit(0).select("*", *[F.lit(None).cast("string").alias(c.split()[0]) for c in empty.split(", ")])


def finalize(agreed: DataFrame, arena_rows: DataFrame, candidates: DataFrame, key: str, embed: Embed, labeller: Labeller, threshold: float = 0.92) -> Stage:
    """Agreed rows (key, prompt, task_type, difficulty, privacy, label_agreement) without a match among the battles, and, where
    under 8 % of them are of high privacy, further candidates (key, prompt) that bring these to a tenth."""
    columns = [key, "prompt", "task_type", "difficulty", "privacy", "label_agreement", "privacy_augmented"]
    hashed = lambda rows: rows.withColumn("prompt_hash", prompt_hash(F.col("prompt")))
    first = staged(embed(hashed(agreed)), "final-agreed")
    kept = staged(without_matches(first, arena_rows, key, "embedding", threshold), "final-kept")
    needed = curation.augmentation_needed(kept)
    fresh = hashed(candidates).join(kept.select("prompt_hash"), "prompt_hash", "left_anti") if needed else candidates.limit(0)
    more = augment(fresh.select(key, "prompt"), needed, key, labeller).withColumn("label_agreement", F.lit(True))
    added = staged(embed(hashed(more)), "final-added")
    passed = without_matches(added, arena_rows, key, "embedding", threshold)
    rows = staged(kept.withColumn("privacy_augmented", F.lit(False)).select(*columns).unionByName(passed.withColumn("privacy_augmented", F.lit(True)).select(*columns)), "final-rows")
    before = first.select(F.lit(1).alias("_n")).unionByName(added.select(F.lit(1).alias("_n"))).agg(F.count("*").alias("all"))
    removed = before.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))
    counters = counted(removed, removed_by_arena_similarity=F.sum(F.col("all") - F.col("n")), final_records=F.sum("n"))
    return Stage(rows, counters)
