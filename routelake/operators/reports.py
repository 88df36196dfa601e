"""Distributions, rates, coverage and the report in Markdown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.functions import lexicon as lx
from routelake.session import staged


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, value, rows, share of each column's values, in one pass of grouping sets."""
    sets = df.groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("rows"), F.grouping_id().alias("_g"))
    n = len(columns)
    which = F.coalesce(*[F.when(F.col("_g") == (1 << n) - 1 - (1 << (n - 1 - i)), F.lit(c)) for i, c in enumerate(columns)])
    named = sets.select(which.alias("dimension"), F.coalesce(*[F.col(c).cast("string") for c in columns]).alias("value"), "rows")
    totals = named.groupBy("dimension").agg(F.sum("rows").alias("_t"))
    return named.join(F.broadcast(totals), "dimension").select("dimension", "value", "rows", (F.col("rows") / F.col("_t")).alias("share"))


def rate(df: DataFrame, condition, low: float, high: float) -> DataFrame:
    """rows, share, flagged: the share of rows that meet the condition, flagged outside the band; no rows give 0."""
    found = df.agg(F.count("*").alias("rows"), F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("int")), F.lit(0.0)).alias("share"))
    return found.withColumn("flagged", (F.col("share") < low) | (F.col("share") > high))


def coverage_gaps(df: DataFrame, task: str, floor: int = 500) -> DataFrame:
    """task_type, rows of all task types, absent ones too, that have fewer rows than the floor."""
    every = df.sparkSession.createDataFrame([(t,) for t in lx.TASK_TYPES], "task_type string")
    counts = df.groupBy(F.col(task).alias("task_type")).agg(F.count("*").alias("rows"))
    return every.join(counts, "task_type", "left").select("task_type", F.coalesce("rows", F.lit(0)).alias("rows")).where(F.col("rows") < floor)


def agreement(checkpoint: DataFrame) -> DataFrame:
    """completed, exact, same task, accepted, rejected of rows with label_a and label_b."""
    from routelake.functions.labels import resolve_labels

    both = checkpoint.where(F.col("label_a").isNotNull() & F.col("label_b").isNotNull())
    ok = resolve_labels(F.col("label_a"), F.col("label_b")).isNotNull()
    return both.agg(
        F.count("*").alias("completed"),
        F.count_if(F.col("label_a") == F.col("label_b")).alias("exact"),
        F.count_if(F.col("label_a.task_type") == F.col("label_b.task_type")).alias("same_task"),
        F.count_if(ok).alias("accepted"),
        F.count_if(~ok).alias("rejected"),
    )


def markdown(title: str, sections: dict[str, DataFrame]) -> str:
    """A report: each section a short table, as bullets."""
    lines = [f"# {title}", ""]
    for name, table in sections.items():
        lines += [f"## {name}", "", *("- " + ", ".join(f"{k}: {v:.4g}" if isinstance(v, float) else f"{k}: {v}" for k, v in r.asDict().items()) for r in table.collect()), ""]
    return "\n".join(lines)


def summary_lines(date: str, arena: DataFrame, final: DataFrame, funnels: dict[str, DataFrame], floor: int = 500) -> DataFrame:
    """The data set's report in Markdown as (section, place, line): totals, funnels (counter, rows), distributions, flags and coverage gaps.

    ``arena`` has strong_wins, ``final`` task_type, difficulty and privacy.  Sections and the places
    in them order the lines; the first funnel is followed by the strong models' win rate.
    Empty tables give zeros and sections without lines.  The rate, the distributions and the gaps are
    staged, a few rows each, so that ``arena`` is read once and ``final`` twice.
    """
    spark = arena.sparkSession
    thousands = lambda n: F.format_number(n, 0)
    percent = lambda share: F.concat(F.format_number(share * 100, 2), F.lit("%"))
    out: list[DataFrame] = []

    def told(*lines: str) -> None:
        out.append(spark.createDataFrame([(len(out), f"{i:04d}", line) for i, line in enumerate(lines)], "section int, place string, line string"))

    def add(rows: DataFrame, place, *lines) -> None:
        """Lines of each row; null lines are left out."""
        numbered = F.array(*[F.struct(F.concat_ws(" ", place, F.lit(f"{i:04d}")).alias("place"), line.alias("line")) for i, line in enumerate(lines)])
        out.append(rows.select(F.lit(len(out)).alias("section"), F.explode(numbered).alias("_l")).select("section", "_l.place", "_l.line").where("line is not null"))

    wins = staged(rate(arena, F.col("strong_wins"), 0.35, 0.65), "report-wins")
    spreads = staged(distribution(final, ["task_type", "difficulty", "privacy"]), "report-spreads")
    gaps = staged(coverage_gaps(final, "task_type", floor), "report-gaps")
    n = F.coalesce(F.sum(F.when(F.col("dimension") == "task_type", F.col("rows"))), F.lit(0))
    high = F.coalesce(F.sum(F.when((F.col("dimension") == "privacy") & (F.col("value") == "high"), F.col("share"))), F.lit(0.0))
    told("# Phase 2 Dataset Summary", "", f"Generated: {date}", "", "## Totals", "")
    totals = wins.select(F.col("rows").alias("a")).crossJoin(spreads.agg(n.alias("n")))  # one row each
    bullet = lambda name, n: F.concat(F.lit(f"- {name}: "), thousands(n))
    add(totals, F.lit(""), bullet("Arena preference records", F.col("a")), bullet("LMSYS labeled records", F.col("n")), bullet("Combined records", F.col("a") + F.col("n")))
    for at, (title, table) in enumerate(funnels.items()):
        told("", f"## {title}", "")
        add(table, F.col("counter"), F.concat(F.lit("- "), F.col("counter"), F.lit(": "), thousands(F.col("rows"))))
        if not at:
            told("")
            add(wins, F.lit(""), F.concat(F.lit("Strong-model win rate: "), percent(F.col("share")), F.when(F.col("flagged"), " — FLAG: outside 35%-65%.").otherwise("")))
    for title, name in (("Task type", "task_type"), ("Difficulty", "difficulty"), ("Privacy", "privacy")):
        told("", f"## {title} distribution", "")
        line = F.concat(F.lit("- "), F.col("value"), F.lit(": "), thousands(F.col("rows")), F.lit(" ("), percent(F.col("share")), F.lit(")"))
        add(spreads.where(F.col("dimension") == name), F.col("value"), line)
    low = F.col("share") < 0.08
    add(spreads.agg(high.alias("share")), F.lit(""), F.when(low, ""), F.when(low, F.concat(F.lit("**FLAG:** High-privacy coverage is "), percent(F.col("share")), F.lit(", below 8%."))))
    told("", "## Coverage gaps", "")
    add(gaps, F.col("task_type"), F.concat(F.lit("- "), F.col("task_type"), F.lit(": "), thousands(F.col("rows")), F.lit(" records")))
    add(gaps.agg(F.count("*").alias("n")), F.lit(""), F.when(F.col("n") == 0, f"No task type has fewer than {floor} records."))
    return reduce(DataFrame.unionByName, out)


def write_summary(lines: DataFrame, path: str) -> None:
    """The lines of a report, some dozens, as one text file."""
    lines.coalesce(1).sortWithinPartitions("section", "place").select("line").write.mode("overwrite").text(path)


def summary(date: str, arena: DataFrame, final: DataFrame, funnels: dict[str, DataFrame], floor: int = 500) -> str:
    """The report of ``summary_lines`` as a text."""
    rows = summary_lines(date, arena, final, funnels, floor).orderBy("section", "place").collect()
    return "\n".join(r["line"] for r in rows) + "\n"
