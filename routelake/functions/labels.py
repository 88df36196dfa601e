"""Parsing and reconciling labels that a model wrote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from routelake.functions import lexicon as lx

LABEL = "struct<task_type:string,difficulty:string,privacy:string>"
FIELDS = {"task_type": lx.TASK_TYPES, "difficulty": lx.DIFFICULTIES, "privacy": lx.PRIVACY_LEVELS}


def _object(json: Column) -> Column:
    """The text if it is a JSON object."""
    return F.when(F.json_object_keys(json).isNotNull() & F.try_parse_json(json).isNotNull(), json)


def _checked(json: Column, clean) -> Column:
    keys = F.array_sort(F.json_object_keys(json))
    values = {name: clean(F.get_json_object(json, f"$.{name}")) for name in FIELDS}
    good = keys == F.array(*[F.lit(k) for k in sorted(FIELDS)])
    for name, allowed in FIELDS.items():
        good = good & values[name].isin(allowed)
    return F.when(F.coalesce(good, F.lit(False)), F.struct(*[v.alias(k) for k, v in values.items()]))


def parse_label(answer: Column) -> Column:
    """A label from JSON, or from what lies between the first and last brace: exactly the three keys, known values, else null."""
    between = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    return _checked(F.coalesce(_object(answer), _object(between)), lambda v: v)


def parse_label_lenient(answer: Column) -> Column:
    """As the notebook reads it: fences cut, the first braces without inner ones, values trimmed and lower-cased."""
    bare = F.regexp_replace(answer, r"```(?:json)?", "")
    return _checked(_object(F.regexp_extract(bare, r"(?s)\{[^{}]*\}", 0)), lambda v: F.lower(F.trim(v)))


def parse_label_batch(answer: Column, size: Column) -> Column:
    """Map from item id to label of an answer for ``size`` prompts; null unless it has that many items.

    Items out of range or with other keys have no entry; of items that repeat an id the last one counts.
    """
    items = F.from_json(answer, "array<struct<id:long,t:int,d:int,p:int>>")
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), i + 1)
    inside = lambda x: x["id"].between(0, size - 1) & x["t"].between(0, 8) & x["d"].between(0, 2) & x["p"].between(0, 2)
    good = F.filter(items, lambda x: F.coalesce(inside(x), F.lit(False)))
    last = F.filter(good, lambda x, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda y: y["id"] == x["id"]))
    label = lambda x: F.struct(pick(lx.TASK_TYPES, x["t"]).alias("task_type"), pick(lx.DIFFICULTIES, x["d"]).alias("difficulty"), pick(lx.PRIVACY_LEVELS, x["p"]).alias("privacy"))
    return F.when(F.size(items) == size, F.map_from_entries(F.transform(last, lambda x: F.struct(x["id"], label(x)))))


def resolve_labels(a: Column, b: Column) -> Column:
    """Null if a pass is missing or tasks differ; else the lower difficulty and the higher privacy."""
    order = lambda names, v: F.array_position(F.array(*[F.lit(n) for n in names]), v).cast("int")
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), i)
    easier = pick(lx.DIFFICULTIES, F.least(order(lx.DIFFICULTIES, a["difficulty"]), order(lx.DIFFICULTIES, b["difficulty"])))
    closer = pick(lx.PRIVACY_LEVELS, F.greatest(order(lx.PRIVACY_LEVELS, a["privacy"]), order(lx.PRIVACY_LEVELS, b["privacy"])))
    same = F.coalesce(a["task_type"] == b["task_type"], F.lit(False))
    return F.when(same, F.struct(a["task_type"].alias("task_type"), easier.alias("difficulty"), closer.alias("privacy")))
