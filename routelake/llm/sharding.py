"""Sharding by balanced label propagation under the ``rows`` law: counts at most one apart.

Documents with equal texts are linked.  Every document starts in the shard that a hash
order deals it, one after another, so that counts are at most one apart.  In each round
the linked documents want the shard that most of their group is in; moves are only made
against moves of as many documents the other way, first by others that want it and then
by documents without links, so that the law holds after every round.

Groups larger than a shard holds are cut into pods of at most one shard's size, numbered
in hash order, and each pod moves as a group.  What is still cut when no more moves are
granted is settled: all pods, the largest first, take their majority's shard or else the one
with the most room, and documents without links fill what is left.  Only pods that then fit
nowhere are cut, and those are fewer than the shards.  Links are a star in a group (its members
against its totals), never pairs.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routelake.llm.common import documents, running, split_join, spread
from routelake.session import staged

SHARDS = 24
ROUNDS = 6
OVERHEAD = 8


def _moves(wants: dict[tuple[int, int], int], free: dict[int, int]) -> tuple[dict, dict]:
    """How many of those that want to move from a to b may, and how many free documents go from b to a.

    Every shard must lose as many as it gets.  What comes in beyond what goes out by wish is
    made up by free documents that leave for shards which lose more than they get; where a
    shard has too few of them its inflow is cut, until all shards balance.
    """
    granted = dict(wants)
    while True:
        gain = defaultdict(int)
        for (a, b), n in granted.items():
            gain[b] += n
            gain[a] -= n
        over = {b: gain[b] - free.get(b, 0) for b in sorted(gain) if gain[b] > free.get(b, 0)}
        if not over:
            break
        for b, excess in over.items():
            for a, n in sorted(((a, n) for (a, c), n in granted.items() if c == b and n), key=lambda x: (-x[1], x[0])):
                cut = min(n, excess)
                granted[a, b] -= cut
                excess -= cut
    swapped, losing = defaultdict(int), [[a, -n] for a, n in sorted(gain.items()) if n < 0]
    for b, n in sorted((b, n) for b, n in gain.items() if n > 0):
        while n:
            part = min(n, losing[-1][1])
            swapped[b, losing[-1][0]] += part
            n -= part
            losing[-1][1] -= part
            if not losing[-1][1]:
                losing.pop()
    return granted, swapped


def _homes(counts: list[tuple[str, int, int]], capacity: int) -> dict[str, int]:
    """A shard for each of the large pods, by the most of its documents there already, within what shards hold."""
    room: dict[int, int] = defaultdict(lambda: capacity)
    size: dict[str, int] = defaultdict(int)
    for pod, _, n in counts:
        size[pod] += n
    homes: dict[str, int] = {}
    for pod, shard, _ in sorted(counts, key=lambda c: (-c[2], c[0], c[1])):
        if pod not in homes and room[shard] >= size[pod]:
            homes[pod] = shard
            room[shard] -= size[pod]
    return homes


def _limits(spark, pairs: dict, kind: str) -> DataFrame:
    """Ranges of ranks that move, as rows (from, first, last, to) of a table with at most SHARDS squared rows."""
    rows, start = [], defaultdict(int)
    for (a, b), n in sorted(pairs.items()):
        if n:
            key = (a, b) if kind == "wants" else a
            rows.append((a, start[key] + 1, start[key] + n, b))
            start[key] += n
    return spark.createDataFrame(rows, "origin int, first long, last long, goal int")


def _plan(counts: list[tuple[int, int, int]], room: dict[int, int]) -> tuple[list, list]:
    """Shards for all pods, the largest first; ``counts`` has the number of pods by size and majority's shard.

    Returns rows (all, major, first, last, goal) of ranks of pods that stay whole, and rows
    (all, major, rank, first, last, goal) of the parts of those that no shard has room for.
    What is left of ``room`` is for documents without links.
    """
    most = lambda: max(room, key=lambda s: (room[s], -s))
    by_size = defaultdict(list)
    for size, shard, n in sorted(counts):
        by_size[size].append((shard, n))
    whole, refused, parts = [], [], []
    for size in sorted(by_size, reverse=True):
        kept = {}
        for shard, n in by_size[size]:
            kept[shard] = min(n, room[shard] // size)
            room[shard] -= kept[shard] * size
            whole.append((size, shard, 1, kept[shard], shard))
        for shard, n in by_size[size]:
            done = kept[shard]
            while done < n and (fit := min(n - done, room[goal := most()] // size)):
                whole.append((size, shard, done + 1, done + fit, goal))
                room[goal] -= fit * size
                done += fit
            refused += [(size, shard, k) for k in range(done + 1, n + 1)]
    for size, shard, k in refused:
        done = 0
        while done < size:
            fit = min(size - done, room[goal := most()])
            parts.append((size, shard, k, done + 1, done + fit, goal))
            room[goal] -= fit
            done += fit
    return [w for w in whole if w[2] <= w[3]], parts


def _totals(sizes: DataFrame) -> DataFrame:
    """pod, all, best (n, tie, shard): each pod's rows and the shard with the most of them; a hash settles ties, so that pods want shards evenly."""
    return sizes.groupBy("pod").agg(F.max(F.struct("n", F.xxhash64("pod", "shard").alias("tie"), "shard")).alias("best"), F.sum("n").alias("all"))


def _settled(state: DataFrame, rows: int, shards: int) -> DataFrame:
    """``state`` with every pod in one shard, but for those that fit in none; the shards' counts stay."""
    spark, columns = state.sparkSession, ["doc_id", "size", "text_crc32", "order", "shard", "pod"]
    sizes = state.where("pod is not null").groupBy("pod", "shard").agg(F.count("*").alias("n"))
    totals = _totals(sizes)
    if totals.where(F.col("best.n") < F.col("all")).isEmpty():
        return state
    totals = totals.select("pod", "all", F.col("best.shard").alias("major"), spread(F.col("pod")).alias("order"))
    ranked = staged(running(totals, ["all", "major"], "order", ["pod"], F.lit(1), "rank", rows).drop("order"), "sharding-pods")
    room = dict.fromkeys(range(shards), 0) | {r["shard"]: r["count"] for r in state.groupBy("shard").count().collect()}
    whole, parts = _plan([(r["all"], r["major"], r["count"]) for r in ranked.groupBy("all", "major").count().collect()], room)
    whole = spark.createDataFrame(whole, "all long, major int, first long, last long, goal int")
    ranges = (ranked["all"] == whole["all"]) & (ranked["major"] == whole["major"]) & ranked["rank"].between(whole["first"], whole["last"])
    goals = ranked.join(F.broadcast(whole), ranges, "left").select("pod", ranked["all"], ranked["major"], "rank", "goal")
    linked = staged(split_join(state.where("pod is not null"), goals, "pod"), "sharding-settled")
    out = linked.where("goal is not null").withColumn("shard", F.col("goal")).select(*columns)
    if parts:
        parts = F.broadcast(spark.createDataFrame(parts, "all long, major int, rank long, first long, last long, goal int"))
        cut = running(linked.where("goal is null").drop("goal"), ["pod"], "order", ["doc_id"], F.lit(1), "_rank", rows)
        cut = cut.join(parts, ["all", "major", "rank"]).where(F.col("_rank").between(F.col("first"), F.col("last")))
        out = out.unionByName(cut.withColumn("shard", F.col("goal")).select(*columns))
    loose = state.where("pod is null")
    spare = {r["shard"]: r["count"] for r in loose.groupBy("shard").count().collect()}
    spare = {s: spare.get(s, 0) - n for s, n in room.items()}
    moves, short = {}, [[s, -n] for s, n in sorted(spare.items()) if n < 0]
    for s, n in sorted(spare.items()):
        while n > 0:
            part = min(n, short[-1][1])
            moves[s, short[-1][0]] = part
            n -= part
            short[-1][1] -= part
            if not short[-1][1]:
                short.pop()
    ranked = running(loose, ["shard"], "order", ["doc_id"], F.lit(1), "_rank", rows)
    limits = F.broadcast(_limits(spark, moves, "free"))
    loose = ranked.join(limits, (F.col("shard") == F.col("origin")) & F.col("_rank").between(F.col("first"), F.col("last")), "left").withColumn("shard", F.coalesce("goal", "shard"))
    return staged(out.unionByName(loose.select(*columns)), "sharding-placed")


def propagate(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, linked.

    A null text is empty and weighs only the overhead; all null and empty texts are linked.
    Rows that repeat an id count as rows of their own.  Slots number a shard's rows from 0 in
    hash order; rows that repeat an id and a text take neighbouring slots in any order.
    """
    spark = docs.sparkSession
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    facts = staged(docs.select("doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.sha2(raw, 256).alias("digest")).withColumn("order", spread(F.col("doc_id"), F.col("digest"))), "sharding-facts")
    rows = facts.count()
    capacity = max(1, rows // shards)
    groups = facts.groupBy("digest").agg(F.count("*").alias("group_rows")).where("group_rows > 1")
    started = running(facts, [], "order", ["doc_id", "digest"], F.lit(1), "_rank", rows).withColumn("shard", ((F.col("_rank") - 1) % shards).cast("int")).drop("_rank")
    grouped = split_join(staged(started, "sharding-started"), groups, "digest")
    # Rows of a group are numbered only where the group must be cut.
    large = running(grouped.where(F.col("group_rows") > capacity), ["digest"], "order", ["doc_id"], F.lit(1), "_rank", rows)
    pods = grouped.where(F.coalesce(F.col("group_rows"), F.lit(0)) <= capacity).withColumn("pod", F.when(F.col("group_rows") > 1, F.concat("digest", F.lit("-0"))))
    pods = pods.unionByName(large.withColumn("pod", F.concat(F.col("digest"), F.lit("-"), F.floor((F.col("_rank") - 1) / capacity).cast("string"))).drop("_rank"))
    state = staged(pods.select("doc_id", "size", "text_crc32", "order", "shard", "pod"), "sharding-0")
    for turn in range(rounds):
        sizes = state.where("pod is not null").groupBy("pod", "shard").agg(F.count("*").alias("n"))
        totals = _totals(sizes)
        goals = totals.where(F.col("best.n") < F.col("all")).select("pod", F.col("best.shard").alias("goal"))
        # Of pods larger than half a shard there are fewer than two for each shard; they get homes of their own.
        large = totals.where(F.col("all") * 2 > capacity).select("pod")
        homes = _homes([(r["pod"], r["shard"], r["n"]) for r in sizes.join(large, "pod", "left_semi").collect()], capacity)
        fixed = F.broadcast(spark.createDataFrame(list(homes.items()), "pod string, home int"))
        goals = goals.join(fixed, "pod", "full").select("pod", F.coalesce("home", "goal").alias("goal"))
        wanted = split_join(state, goals, "pod").withColumn("goal", F.when(F.col("goal") != F.col("shard"), F.col("goal")))
        wanted = staged(wanted, f"sharding-wanted-{turn}")
        wants = {(r["shard"], r["goal"]): r["count"] for r in wanted.where("goal is not null").groupBy("shard", "goal").count().collect()}
        if not wants:
            break
        free = {r["shard"]: r["count"] for r in wanted.where("pod is null").groupBy("shard").count().collect()}
        granted, swapped = _moves(wants, free)
        if not any(granted.values()):
            break
        movers = running(wanted.where("goal is not null"), ["shard", "goal"], "order", ["doc_id"], F.lit(1), "_rank", sum(wants.values()))
        limits = F.broadcast(_limits(spark, granted, "wants"))
        movers = movers.join(limits, (F.col("shard") == F.col("origin")) & (movers["goal"] == limits["goal"]) & F.col("_rank").between(F.col("first"), F.col("last")), "left").select("doc_id", "size", "text_crc32", "order", F.coalesce(limits["goal"], F.col("shard")).alias("shard"), "pod")
        loose = running(wanted.where("pod is null").drop("goal"), ["shard"], "order", ["doc_id"], F.lit(1), "_rank", max(1, sum(free.values())))
        limits = F.broadcast(_limits(spark, swapped, "free"))
        loose = loose.join(limits, (F.col("shard") == F.col("origin")) & F.col("_rank").between(F.col("first"), F.col("last")), "left").select("doc_id", "size", "text_crc32", "order", F.coalesce(F.col("goal"), F.col("shard")).alias("shard"), "pod")
        stay = wanted.where("goal is null and pod is not null").drop("goal").select("doc_id", "size", "text_crc32", "order", "shard", "pod")
        state = staged(stay.unionByName(movers).unionByName(loose), f"sharding-{turn + 1}")
    state = _settled(state, rows, shards)
    placed = running(state, ["shard"], "order", ["doc_id"], F.lit(1), "_rank", rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("pod").isNotNull().alias("linked"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the shard and slot of every row of documents."""
    return propagate(documents(spark, sf_dir))
