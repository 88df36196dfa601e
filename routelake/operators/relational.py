"""Order-explicit relational operators: funnels, keep-first, latest, limits, quotas, batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelake.operators.ranges import placed, quantiles
from routelake.session import staged

#: Rows of a table that are broadcast at most; larger tables are joined by a shuffle.
SMALL = 200_000


def small(table: DataFrame) -> DataFrame:
    """``table``, to be broadcast if it has at most SMALL rows."""
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table


def first_reason(checks: list[tuple[str, Column]], otherwise: str = "kept") -> Column:
    """The name of the first check that a row fails (checks are true where it does)."""
    out = None
    for name, failed in checks:
        condition = F.coalesce(failed, F.lit(False))
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def funnel(df: DataFrame, reason: str) -> DataFrame:
    """Rows by reason; they add up to the input."""
    return df.groupBy(reason).agg(F.count("*").alias("rows"))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, whose values must tell a key's rows apart.  Aggregates before it shuffles, so a hot key moves one row from each task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row written of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*").select(*df.columns)


def hash_reservoir(df: DataFrame, hashed: str, k: int, order: str) -> DataFrame:
    """The k rows with the smallest first 16 hex digits, ascending; partial top-k in each task."""
    return df.orderBy(F.substring(hashed, 1, 16), order).limit(k)


def scan_limit(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows in order; 0 is no limit."""
    return df.orderBy(order).limit(n) if n else df


def tail(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= n).drop("_n")


def length_bins(df: DataFrame, group: str, length: str, out: str = "length_bin") -> DataFrame:
    """How many of a group's quartiles (linear interpolation) lie strictly below; groups under four rows have bin 0."""
    quartiles = quantiles(df, group, length, [0.25, 0.5, 0.75]).select(F.col(group).alias("_group"), F.col("rows").alias("_n"), F.col("quantiles").alias("_q"))
    inside = sum((F.when(F.col(length) > F.col("_q")[i], 1).otherwise(0) for i in range(3)), F.lit(0))
    known = df.join(small(staged(quartiles, "quartiles")), F.col(group).eqNullSafe(F.col("_group")), "left")
    return known.withColumn(out, F.when(F.coalesce("_n", F.lit(0)) < 4, 0).otherwise(inside)).drop("_group", "_n", "_q")


def quota(sizes: DataFrame, group: str, size: str, limit: int) -> DataFrame:
    """group, size, allocation: proportional shares under a cap of 5 % of the target, the rest dealt in rounds.

    The table has one row for each group.  What is left after the floors goes one at a time to
    groups below the cap, larger ones first, in rounds; if all are full it stays undealt.
    """
    total = sizes.agg(F.sum(size).alias("_total"))
    facts = sizes.join(F.broadcast(total), F.lit(True)).withColumn("_target", F.least(F.lit(limit).cast("long"), F.col("_total")))
    facts = facts.withColumn("_most", F.least(F.greatest(F.lit(1).cast("long"), F.floor(F.col("_target") * 5 / 100)), F.col(size)))
    facts = facts.withColumn("_base", F.least(F.col("_most"), F.expr(f"_target * {size} div _total")))
    left = facts.agg((F.max("_target") - F.sum("_base")).alias("_left"))
    slots = facts.where("_most > _base").select(group, size, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_most") - F.col("_base") - 1)).alias("_turn"))
    dealt = slots.withColumn("_place", F.row_number().over(Window.orderBy("_turn", F.desc(size), group))).join(F.broadcast(left), F.col("_place") <= F.col("_left"))
    extra = dealt.groupBy(group).agg(F.count("*").alias("_extra"))
    return facts.join(extra, group, "left").select(group, size, (F.col("_base") + F.coalesce("_extra", F.lit(0))).alias("allocation"))


def stratified_sample(df: DataFrame, group: str, length: str, hashed: str, limit: int) -> DataFrame:
    """Rows picked by quota in each group, its length bins in turn, each bin by hash; with length_bin.

    A bin's first rows are found in ranges; only those that the group's allocation can reach,
    so 5 % of the limit from each bin at most, are put in turn.
    """
    binned = length_bins(df, group, length)
    shares = quota(df.groupBy(group).agg(F.count("*").alias("_size")), group, "_size", limit).select(F.col(group).alias("_group"), "allocation")
    shares = small(staged(shares, "allocations"))
    first = placed(binned, [group, "length_bin"], [hashed], "_turn").join(shares, F.col(group).eqNullSafe(F.col("_group"))).where("_turn <= allocation")
    place = F.row_number().over(Window.partitionBy(group).orderBy("_turn", "length_bin"))
    return first.withColumn("_place", place).where("_place <= allocation").drop("_turn", "_place", "_group", "allocation")


def _starts_after(lengths: list[int], ahead: list[int], rows: int, chars: int) -> list[int]:
    """For a batch that opens at each row of a range, where the next one opens (past the end: rows into what follows)."""
    every, out, end, size = [*lengths, *ahead], [], 0, 0
    for start in range(len(lengths)):
        end = max(end, start)
        while end < len(every) and end - start < rows and (end == start or size + every[end] <= chars):
            size, end = size + every[end], end + 1
        out.append(end)
        size -= every[start]
    return out


#: Rows of a range of ``greedy_batches``, and ranges whose tables are put together in one task.
RANGE, WIDE = 4096, 4096


def _starts(tables: DataFrame) -> DataFrame:
    """r, entry, first: where each range's first batch opens, and its number, of the ranges' tables (r, entry, exit, batches).

    A stretch of WIDE ranges is put together to one table; these are ranges of a coarser
    kind, and so on, until one stretch is left.  From there the openings are handed down.
    """
    last = tables.agg(F.max("r")).first()[0]
    if last is None:
        return tables.select("r", "entry", F.col("batches").alias("first"))
    grouped = tables.withColumn("g", F.floor(F.col("r") / WIDE).cast("long"))

    def walked(part: pd.DataFrame, entry: int, first: int) -> tuple[list[tuple[int, int, int]], int, int]:
        way = {(r, e): (x, n) for r, e, x, n in zip(part["r"], part["entry"], part["exit"], part["batches"], strict=True)}
        out = []
        for r in sorted(set(part["r"])):
            out.append((r, entry, first))
            entry, batches = way[r, entry]
            first += batches
        return out, entry, first

    def together(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ends = [(key[0], entry, *walked(part, entry, 0)[1:]) for entry in sorted(set(part["entry"]))]
        return pd.DataFrame(ends, columns=["r", "entry", "exit", "batches"])

    def opened(key: tuple, part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({"r": [], "entry": [], "first": []}).astype("int64")
        start = above.iloc[0] if len(above) else {"entry": 0, "first": 0}
        return pd.DataFrame(walked(part, int(start["entry"]), int(start["first"]))[0], columns=["r", "entry", "first"])

    if last < WIDE:
        above = tables.sparkSession.createDataFrame([(0, 0, 0)], "g long, entry int, first long")
    else:
        coarse = staged(grouped.groupBy("g").applyInPandas(together, "r long, entry int, exit int, batches long"), "batch-tables")
        above = _starts(coarse).withColumnRenamed("r", "g")
    return grouped.groupBy("g").cogroup(above.groupBy("g")).applyInPandas(opened, "r long, entry int, first long")


def greedy_batches(df: DataFrame, order: str, length: str, rows: int = 24, chars: int = 20_000) -> DataFrame:
    """``df`` with ``batch``: closed at so many rows, or before a row that would bring it over so many characters.

    Batches depend on all rows before, so the rows are numbered by ``order`` (unique) and cut
    in ranges of RANGE.  Each range tells, for each of the first ``rows`` places at which its
    first batch may open, where the next range's first one does and how many batches lie
    between; these tables are put together in stretches, and then each range is numbered.
    """
    slim = df.select(F.col(order).alias("o"), F.least(F.col(length), F.lit(chars + 1)).cast("long").alias("n"))
    size = max(RANGE, rows)
    at = F.col("_i") - 1
    own = staged(placed(slim, [], ["o"], "_i").select("o", "n", F.floor(at / size).cast("long").alias("r"), (at % size).cast("int").alias("k"), F.lit(False).alias("ahead")), "batches")
    both = own.unionByName(own.where((F.col("k") < rows) & (F.col("r") > 0)).withColumn("r", F.col("r") - 1).withColumn("ahead", F.lit(True)))

    def split(part: pd.DataFrame) -> tuple[pd.DataFrame, list[int], list[int]]:
        part = part.sort_values("k", kind="stable")
        mine = part[~part["ahead"]]
        return mine, _starts_after(mine["n"].tolist(), part.loc[part["ahead"], "n"].tolist(), rows, chars), mine["n"].tolist()

    def passing(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, after, lengths = split(part)
        out, count = [0] * len(after), [0] * len(after)
        for i in range(len(after) - 1, -1, -1):
            inside = after[i] < len(after)
            out[i], count[i] = (out[after[i]], count[after[i]] + 1) if inside else (after[i] - len(after), 1)
        short = range(len(after), rows)
        return pd.DataFrame({"r": key[0], "entry": range(rows), "exit": [*out[:rows], *[i - len(after) for i in short]], "batches": [*count[:rows], *[0 for _ in short]]})

    tables = staged(both.groupBy("r").applyInPandas(passing, "r long, entry int, exit int, batches long"), "batch-tables")
    starts = staged(_starts(tables), "batch-starts")

    def numbered(key: tuple, part: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({"o": [], "batch": []}).astype("int64")
        mine, after, lengths = split(part)
        at, batch = int(start["entry"].iloc[0]), int(start["first"].iloc[0])
        out = [batch - 1] * len(lengths)
        while at < len(lengths):
            out[at : after[at]] = [batch] * (min(after[at], len(lengths)) - at)
            at, batch = after[at], batch + 1
        return pd.DataFrame({"o": mine["o"], "batch": out})

    found = both.groupBy("r").cogroup(starts.groupBy("r")).applyInPandas(numbered, f"o {own.schema['o'].dataType.simpleString()}, batch long")
    return df.join(found, df[order] == found["o"]).drop("o")


def hash_order(df: DataFrame, hashed: str, order: str, out: str = "position") -> DataFrame:
    """``df`` with its place, from 1, by the whole hash."""
    return placed(df, [], [hashed, order], out)
