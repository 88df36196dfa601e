"""Catalog filters, model ranking and route decisions.  Catalogs and profiles are broadcast up to a size that is checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelake.functions import lexicon as lx
from routelake.functions.rules import rank_of
from routelake.operators.relational import keep_first, small


def attach_profiles(catalog: DataFrame, profiles: DataFrame, id_col: str = "id") -> DataFrame:
    """Every model, with its routing profile where there is one."""
    return catalog.join(small(profiles), id_col, "left")


def compatible_lenient(ram: Column, min_ram: Column, gpu_required: Column, gpu: Column) -> Column:
    """Unknown memory passes; a needed graphics card must be detected."""
    return ~(F.coalesce(F.coalesce(min_ram, F.lit(0)) > ram, F.lit(False)) | (F.coalesce(gpu_required, F.lit(False)) & ~F.coalesce(gpu, F.lit(False))))


def compatible_strict(known: Column, ram: Column, min_ram: Column, gpu_required: Column, gpu: Column) -> Column:
    """The model must state its needs; unknown memory is none."""
    return F.coalesce(known, F.lit(False)) & (F.coalesce(min_ram, F.lit(0)) <= F.coalesce(ram, F.lit(0))) & (~F.coalesce(gpu_required, F.lit(False)) | F.coalesce(gpu, F.lit(False)))


def best_local(models: DataFrame, group: list[str]) -> DataFrame:
    """The model of each group with the highest local priority, then the largest memory need, then the first in the catalog."""
    ordered = models.withColumn("_first", F.struct(-F.col("local_priority"), -F.col("min_ram_gb"), F.col("pos")))
    return keep_first(ordered, group, ["_first"]).drop("_first")


def available(models: DataFrame, installed: DataFrame, auto: bool = False) -> DataFrame:
    """Cloud models that are enabled, and local ones installed (or, automatically, enabled)."""
    has = models.join(small(installed.select(F.col("id").alias("_i")).distinct()), F.col("id") == F.col("_i"), "left")
    local = F.col("enabled") if auto else F.col("_i").isNotNull()
    return has.where(F.when(F.col("local"), local).otherwise(F.col("enabled"))).drop("_i")


def installed_matches(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """Names wanted that are installed: equal, or equal up to the colon."""
    a = wanted.select(F.col("name"), F.explode(F.array_distinct(F.array("name", F.substring_index("name", ":", 1)))).alias("_k"))
    b = installed.select(F.explode(F.array_distinct(F.array("name", F.substring_index("name", ":", 1)))).alias("_k")).distinct()
    return a.join(small(b), "_k", "left_semi").select("name").distinct()


#: Models of a catalog at most; each prompt meets all of them.
MOST_MODELS = 10_000


def listed(models: DataFrame) -> DataFrame:
    """A catalog, whose size is checked since every prompt meets every model of it."""
    if (n := models.limit(MOST_MODELS + 1).count()) > MOST_MODELS:
        raise ValueError(f"a catalog of over {MOST_MODELS} models ({n} read)")
    return models


def rank_models(prompts: DataFrame, models: DataFrame, id_col: str) -> DataFrame:
    """id, model, score, rank for each prompt and eligible model; catalog order settles ties.

    Prompts have difficulty, task_type, long_prompt, requires_long_context, uncertain.
    """
    met = prompts.crossJoin(F.broadcast(listed(models)))
    need = rank_of(F.col("difficulty"), lx.DIFFICULTIES)
    fit = F.coalesce(F.try_element_at("tasks", F.col("task_type")), F.lit(1))
    context = F.col("context") * F.when(F.coalesce(F.col("long_prompt"), F.lit(False)) | F.coalesce(F.col("requires_long_context"), F.lit(False)), 12).otherwise(2)
    doubt = F.when(F.coalesce(F.col("uncertain"), F.lit(False)) & (F.col("quality") > need), 8).otherwise(0)
    score = fit * 20 + F.col("speed") * 4 + F.col("economy") * 3 + context + doubt - (F.col("quality") - need) * 6
    ranked = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "pos"))
    return met.where(F.col("quality") >= need).withColumn("score", score.cast("long")).withColumn("rank", ranked)


def auto_route(prompts: DataFrame, models: DataFrame, id_col: str) -> DataFrame:
    """id, model, outcome and reason of the automatic choice among available models.

    Prompts carry, beside the ranking signals, private, max_similarity and strong_win_probability,
    and ``told``, what is said of their signals.
    """
    best = rank_models(prompts, models, id_col)
    pick = lambda local, name: best.where(F.col("local") == local).groupBy(id_col).agg(F.min_by("id", "rank").alias(name))
    facts = prompts.join(pick(True, "_local"), id_col, "left").join(pick(False, "_cloud"), id_col, "left")
    strong = F.coalesce((F.col("max_similarity") >= lx.MIN_SIMILARITY) & (F.col("strong_win_probability") >= lx.STRONG_SEMANTIC), F.lit(False))
    light = F.col("difficulty").isin("easy", "medium")
    outcome = (
        F.when(F.col("private") & ((F.col("difficulty") == "hard") | strong), "error: hard private task")
        .when(~strong & light & F.col("_local").isNotNull(), "local")
        .when(F.col("private"), "error: no compatible local model")
        .when(F.col("_cloud").isNotNull(), "cloud")
        .otherwise("error: no route")
    )
    level = F.col("difficulty")
    local = F.when(level == "medium", lx.LOCAL_MEDIUM).otherwise(lx.LOCAL_EASY)
    cloud = F.when(strong, lx.CLOUD_STRONG).when(level == "easy", lx.CLOUD_EASY).otherwise(F.format_string(lx.CLOUD_POLICY, F.initcap(level)))
    none = F.when(light, lx.ERROR_NO_ROUTE).otherwise(F.format_string(lx.ERROR_NO_CLOUD, level))
    said = lambda text: F.concat_ws(" ", F.col("told"), text)
    reasons = {"local": said(local), "cloud": said(cloud), "error: hard private task": F.lit(lx.ERROR_HARD_PRIVATE), "error: no compatible local model": F.lit(lx.ERROR_PRIVATE)}
    reason = none
    for name, text in reasons.items():
        reason = F.when(F.col("outcome") == name, text).otherwise(reason)
    return facts.withColumn("outcome", outcome).withColumn("reason", reason).withColumn("model", F.when(F.col("outcome") == "local", F.col("_local")).when(F.col("outcome") == "cloud", F.col("_cloud"))).drop("_local", "_cloud")


def resolve_route(manual: Column, chosen: Column) -> Column:
    """A manual choice passes every rule."""
    return F.coalesce(manual, chosen)
