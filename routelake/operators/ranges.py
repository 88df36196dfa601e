"""Places and running sums in an order, dealt by ranges: no key and no whole table is sorted in one task.

Rows are dealt to ranges of their keys and order together, so a key with many rows lies in many
ranges.  A range's sums by key are run up in a table with a row for each key in each range, and
only the rows of one key in one range are sorted with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelake.session import staged


def running(df: DataFrame, keys: list[str], order: list[Column | str], value: Column, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the same keys before and with this one.

    Without keys the whole table is one run.  Null keys are a key of their own.  Rows that agree
    in keys and order follow each other in no fixed way.  The table is staged once, so that all
    that follows sees the same ranges.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k) for k in keys]
    dealt = df.withColumn("_key", F.struct(F.lit(0).alias("_"), *by)).withColumn("_value", value)
    dealt = staged(dealt.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range", "_key").agg(F.sum("_value").alias("_sum"))
    ahead = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_range", "_key", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_range", "_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = dealt.withColumn("_own", F.sum("_value").over(within)).join(before, ["_range", "_key"])
    return run.withColumn(out, F.col("_before") + F.col("_own")).drop("_range", "_key", "_value", "_own", "_before")


def placed(df: DataFrame, keys: list[str], order: list[Column | str], out: str) -> DataFrame:
    """``df`` with its place, from 1, among the rows of the same keys."""
    return running(df, keys, order, F.lit(1).cast("long"), out)


def quantiles(df: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """group, rows, quantiles: exact, with linear interpolation between the two rows next to a share; nulls do not count.

    Equal values are counted before anything is sorted, and the counts run up in ranges.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    upto = running(counts, [group], [value], F.col("_n"), "_upto")
    totals = counts.groupBy(group).agg(F.sum("_n").alias("_rows")).select(F.col(group).alias("_group"), "_rows")
    known = upto.join(totals, F.col(group).eqNullSafe(F.col("_group")))
    at = [(F.col("_rows") - 1) * F.lit(float(s)) for s in shares]
    reach = lambda place: F.min(F.when(F.col("_upto") > place, F.col(value)))
    ends = [c for i, p in enumerate(at) for c in (reach(F.floor(p)).alias(f"_low{i}"), reach(F.ceil(p)).alias(f"_high{i}"))]
    found = known.groupBy(group).agg(F.max("_rows").alias("rows"), *ends)
    part = lambda i, s: (F.col("rows") - 1) * F.lit(float(s)) - F.floor((F.col("rows") - 1) * F.lit(float(s)))
    return found.select(group, "rows", F.array(*[F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * part(i, s) for i, s in enumerate(shares)]).alias("quantiles"))
