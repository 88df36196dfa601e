"""Mixing sources to target weights by weighted fair queueing.

Each source has a target of words.  Its documents, in an order that a hash of their id
shuffles, and then once more for a second round, get virtual finish times: the source's
words up to and with the document, divided by the source's target.  All documents are
ranged by finish time over all sources and cut off where the total budget is used up, so
that every source is served in proportion to its weight to within one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routelake.llm.common import SPACE, documents, few, packed, running, spread, unpacked
from routelake.session import staged

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: The budget as a share of all words, and how often a document may be taken.
BUDGET, ROUNDS = 1.5, 2
#: Parts of the finish times that one pass of the cut-off search tells apart, and rows it settles at once.
PARTS, SETTLED = 4096, 4096


def word_count(text):
    """Words between ASCII white space; splitting is far cheaper than matching a negated class."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")).cast("long")


def weighted(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """``sources`` (one row for each, with ``source``) with ``weight``: in the order of their names, null last, weights repeat.

    Names are ranged, so that their numbers need no task to see them all.
    """
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = staged(sources.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "mixing-sources")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as there are ranges
    starts = ranged.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + F.col("_start") - 1
    listed = F.array(*[F.lit(w) for w in weights])
    return ranged.join(F.broadcast(starts), "_p").withColumn("weight", F.element_at(listed, (place % len(weights) + 1).cast("int"))).drop("_p", "_start")


def with_targets(sources: DataFrame, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``: shares by weight; those above ``rounds`` times a source's size are cut to it, and the excess reshared.

    The share of a unit of weight grows from pass to pass until no further source is above.
    """
    size, weight = F.col("source_size"), F.col("weight")
    total = sources.agg(F.sum(size)).first()[0] or 0
    share = -1.0
    while True:
        full = F.lit(share) * weight > rounds * size
        sums = sources.agg(F.sum(F.when(full, rounds * size)).alias("full"), F.sum(F.when(~full, weight)).alias("open")).first()
        if not sums["open"]:
            share = float("inf")
            break
        found = (budget * total - (sums["full"] or 0)) / sums["open"]
        if found <= share:
            break
        share = found
    target = F.when(F.lit(share) * weight > rounds * size, (rounds * size).cast("double")).otherwise(F.lit(share) * weight)
    return sources.withColumn("target", target)


def order_of(docs: DataFrame):
    """The shuffled order of documents: by a hash of their id, and without one by a hash of their text."""
    return F.when(F.col("doc_id").isNull(), spread(F.xxhash64("text"))).otherwise(spread(F.col("doc_id")))


def queue(docs: DataFrame) -> tuple[DataFrame, float]:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, order, served; and the budget.

    ``served`` are the source's words up to and with the document (and those that agree with it in
    id and size), in its order.
    """
    sized = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order_of(docs).alias("order")), "mixing-sizes")
    sources = staged(weighted(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))), "mixing-weights")
    totals = sources.agg(F.sum("source_size").alias("size"), F.sum("n").alias("n")).first()
    table = with_targets(sources).select(F.col("source").alias("name"), "source_size", "target")
    served = running(sized, ["source"], "order", ["size"], F.col("size"), "served", totals["n"] or 0, together=True)
    joined = served.join(few(table), served["source"].eqNullSafe(table["name"])).drop("name")
    return staged(joined, "mixing-queue"), BUDGET * (totals["size"] or 0)


def _finish(turn):
    return F.when(F.col("target") > 0, (turn * F.col("source_size") + F.col("served")) / F.col("target")).otherwise(F.lit(0.0))


def turns(queued: DataFrame) -> DataFrame:
    """The queue with a row for each round, and that round's finish time."""
    return queued.withColumn("round", F.explode(F.array(*[F.lit(i) for i in range(ROUNDS)]))).withColumn("finish", _finish(F.col("round")))


def cut_off(queued: DataFrame, budget: float) -> tuple[float, str, int]:
    """The last turn (finish, order, round) within the budget; every turn up to it is taken.

    Narrows the range of times that holds the cut with one aggregation a pass, and where very
    many turns have one time the range of their orders, until few enough turns are left to be
    looked at one by one.
    """
    here = turns(queued).where("size > 0").withColumn("_digits", F.conv(F.substring("order", 1, 12), 16, 10).cast("double"))
    used = 0
    for key in ("finish", "_digits"):
        ends = here.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
        if ends["hi"] is None:
            return -1.0, "", 0
        low, high = ends["lo"], ends["hi"]
        while True:
            inside = here.where(F.col(key).between(F.lit(low), F.lit(high)))
            width = (high - low) / PARTS
            part = F.least(F.floor((F.col(key) - low) / F.lit(width)), F.lit(PARTS - 1)) if width > 0 else F.lit(0)
            parts = inside.groupBy(part.alias("part")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy("part").collect()
            for row in parts:
                if used + row["size"] > budget:
                    break
                used += row["size"]
            else:
                return float("inf"), "", 0
            low, high = row["lo"], row["hi"]
            if row["n"] <= SETTLED or low == high:
                break
        here = here.where(F.col(key).between(F.lit(low), F.lit(high)))
        if row["n"] <= SETTLED:
            break
    # What still ties has one time and one id, and goes together.
    rest = here.groupBy("finish", "order", "round").agg(F.sum("size").alias("size")).orderBy("finish", "order", "round").collect()
    last = (rest[0]["finish"], "", -1)
    for turn in rest:
        used += turn["size"]
        if used > budget:
            break
        last = (turn["finish"], turn["order"], turn["round"])
    return last


def _within(turn, last: tuple[float, str, int]):
    own = F.struct(_finish(turn).alias("finish"), F.col("order"), turn.alias("round"))
    return own <= F.struct(F.lit(last[0]).alias("finish"), F.lit(last[1]).alias("order"), F.lit(last[2]).alias("round"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows taken, each as often as it is, with doc_id, round, size, finish; ranged by finish time over the partitions.

    A null text has no words; a null source is a source of its own, the last in order.
    Rows that repeat an id are documents of their own; those that also agree in source and size
    are taken alike.  Texts without a word cost nothing,
    have the time of what precedes them, and are taken by the same rule.
    """
    queued, budget = queue(docs)
    taken = turns(queued).where(_within(F.col("round"), cut_off(queued, budget)))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return taken.select("doc_id", "source", "round", "size", "finish", "order").repartitionByRange(n, "finish", "order").sortWithinPartitions("finish", "order", "round")


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, 0 to ROUNDS times; its columns as they were.

    In each round a source's documents are taken from the first of its order up to some last one,
    so a table of these last ones, a row for each source, settles every document where it is:
    texts are not shuffled.  Rows that agree in id, source and size are taken alike.
    """
    queued, budget = queue(docs)
    last = cut_off(queued, budget)
    ends = [F.max(F.when(_within(F.lit(i), last), F.struct("order", "size"))).alias(f"_end{i}") for i in range(ROUNDS)]
    cuts = staged(queued.groupBy(F.col("source").alias("_source")).agg(*ends), "mixing-cuts")
    own = packed(docs, _from=F.col("source"), _place=F.struct(order_of(docs).alias("order"), word_count(F.col("text")).alias("size")))
    joined = own.join(few(cuts), F.col("_from").eqNullSafe(F.col("_source")))
    times = sum((F.when(F.col("_place") <= F.col(f"_end{i}"), 1).otherwise(0) for i in range(ROUNDS)), F.lit(0))
    return unpacked(joined.withColumn("_times", times).where("_times > 0").select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_times")))))


def account(docs: DataFrame, repeats: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken; and source and repeats if asked for."""
    queued, budget = queue(docs)
    last = cut_off(queued, budget)
    times = sum((F.when(_within(F.lit(i), last), 1).otherwise(0) for i in range(ROUNDS)), F.lit(0)).cast("long")
    own = queued.withColumn("repeats", times)
    found = own.select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"), "source", "repeats")
    return found if repeats else found.drop("source", "repeats")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: what the mix takes of every row of documents."""
    return account(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS ord
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget, 2.0::DOUBLE * source_size / weight AS stops,
         coalesce(sum(2 * source_size) OVER earlier, 0) AS full_before, sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS weight_left
  FROM sources WINDOW earlier AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT (budget - full_before) / weight_left AS share FROM ranked WHERE (budget - full_before) / weight_left <= stops ORDER BY stops LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN share * weight > 2 * source_size THEN CAST(2 * source_size AS DOUBLE) ELSE share * weight END AS target, budget
  FROM ranked, level),
queued AS (
  SELECT doc_id, ord, size, t.source_size, target, budget,
         sum(size) OVER (PARTITION BY s.source ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) AS served
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
turns AS (
  SELECT *, CASE WHEN target > 0 THEN CAST(round * source_size + served AS DOUBLE) / target ELSE 0 END AS finish FROM queued, (VALUES (0), (1)) AS r(round)),
cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, ord, round, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM turns)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN used <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM cut GROUP BY doc_id, size, source_size, target
"""
