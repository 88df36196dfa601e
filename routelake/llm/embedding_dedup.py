"""Embedding near-duplicates: a robust-pruned flat graph, searched from medoids, audited and verified.

Equal vectors become one class, so that copies cost nothing.  Classes are dealt to overlapping
shards by their nearest centres; every shard builds a pruned neighbour graph, and a class's
adjacency lists from its shards are united.  Each class is then searched in its shards: a
greedy walk from the shard's medoid and, where the class is a node there itself, from its own
place; once it meets a class over the threshold, the search spreads over all that are.  What it
finds is verified in double precision.  An audit compares a sample of classes with all others by
brute force; while it finds less than it should, the search is done again, wider.

No task holds more than two parts of a shard.  Pairs are counted where they are found, and only
a spanning set of links leaves a task, so a group of near copies never turns into all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routelake.llm.common import lean, split_join, table
from routelake.operators.components import connected_components
from routelake.session import discard, staged

THRESHOLD = 0.95


@dataclass(frozen=True)
class Index:
    """How the graph is built and searched."""

    threshold: float = THRESHOLD
    #: The search goes on from all that are as near as this.
    spread: float = 0.9
    #: Classes to a centre, on average; a shard holds ``overlap`` times as many.
    rows: int = 800
    #: A shard of more classes is dealt in parts of about as many, and each part's classes search every part.
    part: int = 4096
    #: Shards that a class lies in.
    overlap: int = 3
    #: Edges that pruning leaves a node, candidates it has to choose from, and its factor.
    degree: int = 16
    candidates: int = 48
    alpha: float = 1.2
    #: Nodes that a greedy walk keeps in view.
    beam: int = 24
    #: Centres at most, and classes that are sampled for each to fit them.
    centres: int = 16_384
    sample: int = 32
    #: Classes that the audit compares with all others, the share it asks for, and how often it may ask again.
    audited: int = 256
    recall: float = 0.999
    attempts: int = 3

    def wider(self) -> Index:
        return replace(self, overlap=self.overlap * 2, beam=self.beam * 2)


def usable(vector: Column) -> Column:
    """Whether a vector can link with any: there, finite throughout, not zero."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda c: c != 0), F.lit(False))


def _stack(column: pd.Series) -> np.ndarray:
    """Rows of unit length in double precision; scaled first, so that no square over- or underflows."""
    m = np.array([np.asarray(v, dtype=np.float64) for v in column])
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


# ---------------------------------------------------------------- shards


def centres(classes: DataFrame, rows: int, index: Index) -> np.ndarray:
    """Unit centres from a few rounds of spherical k-means over a sample of bounded size, chosen by hash."""
    k = max(1, min(index.centres, -(-rows // index.rows)))
    wanted = k * index.sample
    share = min(1.0, 1.25 * wanted / max(rows, 1))
    chosen = classes.withColumn("_h", F.xxhash64("key")).where(F.pmod("_h", F.lit(1 << 30)) < math.ceil(share * (1 << 30)))
    m = _stack(chosen.orderBy("_h", "key").limit(wanted).select("v").toPandas()["v"])
    found = m[:: max(1, len(m) // k)][:k]
    for _ in range(6):
        near = np.concatenate([(m[i : i + 4096] @ found.T).argmax(axis=1) for i in range(0, len(m), 4096)])
        sums = np.zeros_like(found)
        np.add.at(sums, near, m)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(size > 0, sums / np.where(size > 0, size, 1), found)
    return found


def assigned(classes: DataFrame, middle: np.ndarray, overlap: int) -> DataFrame:
    """``classes`` with ``shards``: the numbers of the nearest centres."""
    middle, keep = middle.astype(np.float32), min(overlap, len(middle))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = _stack(batch["v"]).astype(np.float32)
            for at in range(0, len(m), 512):
                s = m[at : at + 512] @ middle.T
                top = np.sort(np.argpartition(-s, keep - 1, axis=1)[:, :keep].astype(np.int32), axis=1)
                yield batch.iloc[at : at + 512].assign(shards=list(top))

    return classes.mapInPandas(lean(nearest), f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in classes.schema)}, shards array<int>")


# ---------------------------------------------------------------- one shard's graph


def pruned_graph(m: np.ndarray, index: Index) -> np.ndarray:
    """Neighbours of each row of unit vectors, -1 where there are fewer than of others.

    Of its nearest candidates a node takes the nearest, strikes those that lie nearer to the
    taken one by the factor than to itself, and goes on.  Edges are then held both ways, and two
    to far nodes are added, by which walks cross the graph.  A node that is taken by very many
    holds ``degree`` of them, these as many of the others, and so on, so that all stay in reach.
    """
    n = len(m)
    degree, k = min(index.degree, n - 1), min(index.candidates, n - 1)
    if n < 2:
        return np.full((n, 1), -1, dtype=np.int32)
    out = np.full((n, degree), -1, dtype=np.int32)
    for at in range(0, n, 256):
        block = m[at : at + 256]
        s = block @ m.T
        rows = np.arange(len(block))
        s[rows, at + rows] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, axis=1), axis=1, kind="stable"), axis=1)
        own = 1 - np.take_along_axis(s, top, axis=1)
        among = m[top]
        apart = 1 - among @ among.transpose(0, 2, 1)
        alive = np.ones(top.shape, dtype=bool)
        for turn in range(degree):
            pick = alive.argmax(axis=1)
            some = alive[rows, pick]
            out[at : at + 256, turn] = np.where(some, top[rows, pick], -1)
            alive &= index.alpha * apart[rows, pick] > own
            alive[rows, pick] = False
    source, turn = np.nonzero(out >= 0)
    at = out[source, turn]
    order = np.lexsort((source, turn, at))
    source, at = source[order], at[order]
    start = np.searchsorted(at, at)
    place = np.arange(len(at)) - start
    holder = np.where(place < degree, at, source[start + np.maximum(place // degree - 1, 0)])
    return _adjacency(n, np.concatenate([np.repeat(np.arange(n), (out >= 0).sum(axis=1)), holder, np.arange(n), np.arange(n)]), np.concatenate([out[out >= 0], source, (np.arange(n) * 7919 + n // 2) % n, (np.arange(n) + n // 3 + 1) % n]))


def _adjacency(n: int, source: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Edges as a row for each of n nodes, filled up by -1; each edge once, none to a node itself."""
    key = np.unique((source.astype(np.int64) * n + to)[source != to])
    source, to = key // n, key % n
    place = np.arange(len(source)) - np.searchsorted(source, source)
    graph = np.full((n, int(place.max(initial=0)) + 1), -1, dtype=np.int32)
    graph[source, place] = to
    return graph


def _found_by_search(q: np.ndarray, own: np.ndarray, m: np.ndarray, graph: np.ndarray, medoid: int, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) over the threshold: a greedy walk for all queries at once, then spreading from what it met.

    ``own`` is a query's own node, or -1.
    """
    count, beam = len(q), min(index.beam, len(m))
    rows = np.arange(count)
    seen = np.zeros((count, len(m)), dtype=bool)
    at = np.full((count, beam), -1, dtype=np.int32)
    near = np.full((count, beam), -np.inf)
    open_ = np.zeros((count, beam), dtype=bool)
    at[:, 0], near[:, 0], open_[:, 0] = medoid, q @ m[medoid], True
    seen[:, medoid] = True
    if beam > 1:
        mine = (own >= 0) & (own != medoid)
        at[mine, 1], near[mine, 1], open_[mine, 1] = own[mine], 1.0, True
        seen[rows[mine], own[mine]] = True
    hits = [(rows, np.full(count, medoid), near[:, 0].copy())]
    active = rows
    while len(active):
        best = np.where(open_[active], near[active], -np.inf).argmax(axis=1)
        open_[active, best] = False
        to = graph[at[active, best]]
        fresh = (to >= 0) & ~seen[active[:, None], to]
        i, j = np.nonzero(fresh)
        key = np.unique(active[i].astype(np.int64) * len(m) + to[i, j])
        who, node = key // len(m), key % len(m)
        seen[who, node] = True
        s = np.einsum("ij,ij->i", q[who], m[node])
        hits.append((who, node, s))
        # Of a query's fresh nodes as many as the beam is wide take part, the nearest first.
        order = np.lexsort((node, -s, who))
        who, node, s = who[order], node[order], s[order]
        starts = np.r_[True, who[1:] != who[:-1]] if len(who) else np.zeros(0, dtype=bool)
        place = np.arange(len(who)) - np.maximum.accumulate(np.where(starts, np.arange(len(who)), 0)) if len(who) else np.zeros(0, dtype=int)
        few = place < beam
        spot = np.searchsorted(active, who[few])
        more = np.full((len(active), beam), -np.inf)
        names = np.full((len(active), beam), -1, dtype=np.int32)
        more[spot, place[few]], names[spot, place[few]] = s[few], node[few]
        all_s = np.concatenate([near[active], more], axis=1)
        all_at = np.concatenate([at[active], names], axis=1)
        all_open = np.concatenate([open_[active], names >= 0], axis=1)
        kept = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        near[active], at[active] = np.take_along_axis(all_s, kept, axis=1), np.take_along_axis(all_at, kept, axis=1)
        open_[active] = np.take_along_axis(all_open, kept, axis=1)
        active = active[open_[active].any(axis=1)]
    # The range is spread over: neighbours of what is near, until no more come.
    who, node, s = (np.concatenate(x) for x in zip(*hits, strict=True))
    close, good, mine = s >= index.spread, s >= index.threshold, own >= 0
    found = [(who[good], node[good])]
    who, node = np.concatenate([who[close], rows[mine]]), np.concatenate([node[close], own[mine]])
    while len(who):
        parts = []
        for k in range(0, len(who), 50_000):
            to = graph[node[k : k + 50_000]]
            i, j = np.nonzero((to >= 0) & ~seen[who[k : k + 50_000, None], to])
            key = np.unique(who[k : k + 50_000][i].astype(np.int64) * len(m) + to[i, j])
            one, other = key // len(m), key % len(m)
            seen[one, other] = True
            parts.append((one, other, np.einsum("ij,ij->i", q[one], m[other])))
        who, node, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        good, close = s >= index.threshold, s >= index.spread
        found.append((who[good], node[good]))
        who, node = who[close], node[close]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the smallest number of a group) after the pairs i, j have been united."""
    roots, mine = np.arange(len(label)), label
    i, j = np.concatenate([i, roots]), np.concatenate([j, mine])
    while True:
        low = np.minimum(label[i], label[j])
        following = label.copy()
        np.minimum.at(following, i, low)
        np.minimum.at(following, j, low)
        following = following[following]
        if (following == label).all():
            return label
        label = following


def _graph_rows(index: Index):
    """A part's nodes with the neighbours that its pruned graph gives them, and whether they are its medoid."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node", ignore_index=True)
        m, names = _stack(part["v"]), part["node"].to_numpy()
        graph = pruned_graph(m, index)
        lists = [names[row[row >= 0]] for row in graph]
        middle = np.arange(len(m)) == (m @ m.mean(axis=0)).argmax()
        return pd.DataFrame({"shard": part["shard"], "part": part["part"], "node": names, "neighbours": lists, "medoid": middle})

    return build


def _searched(index: Index):
    """What the classes of a part find in a part of the same shard: links of each class, and pairs that span what is linked."""

    def search(_: tuple, nodes: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")
        if not len(nodes):
            return empty
        nodes = nodes.sort_values("node", ignore_index=True)
        queries = others.sort_values("node", ignore_index=True) if len(others) else nodes
        names, asked = nodes["node"].to_numpy(), queries["node"].to_numpy()
        m = _stack(nodes["v"])
        q = m if queries is nodes else _stack(queries["v"])
        lists = [np.asarray(x, dtype=np.int64) for x in nodes["neighbours"]]
        flat = np.concatenate(lists)
        source = np.repeat(np.arange(len(names)), [len(x) for x in lists])
        spot = np.searchsorted(names, flat).clip(0, len(names) - 1)
        here = names[spot] == flat
        graph = _adjacency(len(names), source[here], spot[here])
        medoid = int(nodes["medoid"].to_numpy().argmax())
        own = np.searchsorted(names, asked).clip(0, len(names) - 1)
        own = np.where(names[own] == asked, own, -1)
        size = nodes["size"].to_numpy()
        shard = int(nodes["shard"].iloc[0])
        mine = np.array([list(x) for x in nodes["shards"]])
        theirs = mine if queries is nodes else np.array([list(x) for x in queries["shards"]])
        all_names = np.unique(np.concatenate([names, asked]))
        label, links = np.arange(len(all_names)), np.zeros(len(asked), dtype=np.int64)
        for k in range(0, len(asked), 512):
            i, j = _found_by_search(q[k : k + 512], own[k : k + 512], m, graph, medoid, index)
            i = i + k
            other = asked[i] != names[j]
            i, j = i[other], j[other]
            label = _united(label, np.searchsorted(all_names, asked[i]), np.searchsorted(all_names, names[j]))
            # A pair that lies in several shards together counts in the first of them.
            first = np.ones(len(i), dtype=bool)
            for c in range(theirs.shape[1]):
                s = theirs[i, c]
                first &= ~((s < shard) & (mine[j] == s[:, None]).any(axis=1))
            np.add.at(links, i[first], size[j[first]])
        linked = label != np.arange(len(label))
        counted = pd.DataFrame({"a": asked, "b": asked, "links": links})[links > 0]
        spanning = pd.DataFrame({"a": all_names[linked], "b": all_names[label[linked]], "links": 0})
        return pd.concat([counted, spanning], ignore_index=True)

    return search


# ---------------------------------------------------------------- the whole index


def classes_of(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """node, key, v, rep (the smallest id), size of each different usable vector, staged; ``key`` is a digest of its numbers."""
    ready = vectors.where(usable(F.col(vector)) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), digest(F.col(vector)).alias("key"), F.col(vector).alias("v"))
    grouped = ready.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.any_value("v").alias("v"))
    return staged(grouped.withColumn("node", F.monotonically_increasing_id()), "embedding-classes")


def digest(vector: Column) -> Column:
    """Equal for equal numbers, zeros of either sign included."""
    return F.md5(F.to_json(F.transform(vector, lambda c: c.cast("double") + F.lit(0.0))).cast("binary"))


def graph_of(members: DataFrame, index: Index) -> DataFrame:
    """node, neighbours: the adjacency lists of all shards and parts united; and the medoids, as (shard, part, node)."""
    schema = "shard int, part int, node long, neighbours array<long>, medoid boolean"
    return members.groupBy("shard", "part").applyInPandas(_graph_rows(index), schema)


def links(classes: DataFrame, index: Index) -> tuple[DataFrame, DataFrame]:
    """(node, links) and (a, b): how many vectors of other classes each class links with, and pairs that span the links; ``classes`` of one length."""
    rows = classes.count()
    middle = centres(classes, rows, index)
    dealt = staged(assigned(classes.select("node", "key", "v", "size"), middle, index.overlap), "embedding-shards")
    each = dealt.select("node", "v", "size", "shards", F.explode("shards").alias("shard"))
    parts = each.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(index.part)).cast("int").alias("parts"))
    members = each.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    built = staged(graph_of(members.select("shard", "part", "node", "v"), index), "embedding-graph")
    united = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))  # a row for each of a node's shards
    nodes = members.join(united, "node").join(F.broadcast(built.where("medoid").select(F.col("shard").alias("_s"), F.col("part").alias("_p"), F.col("node").alias("_m"))), F.expr("shard = _s and part = _p")).withColumn("medoid", F.col("node") == F.col("_m"))
    columns = ["shard", "part", "node", "v", "size", "shards"]
    held = nodes.select(*columns, "neighbours", "medoid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    asking = members.where("parts > 1").select(*columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("meets")).where("part <> meets")
    asking = asking.select(F.col("meets").alias("part"), F.col("part").alias("other"), *[F.col(c).alias(c) for c in ("shard", "node", "v", "size", "shards")])
    found = held.groupBy("shard", "part", "other").cogroup(asking.groupBy("shard", "part", "other")).applyInPandas(_searched(index), "a long, b long, links long")
    found = staged(found, "embedding-links")
    discard(dealt, built)
    return found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")), found.where("links = 0").select("a", "b")


def audit(classes: DataFrame, counted: DataFrame, index: Index) -> float:
    """The share of the links of a sample of classes, found by brute force over all classes, that ``counted`` has."""
    picked = classes.orderBy(F.xxhash64("key"), "key").limit(index.audited).select("node", "size", "v").toPandas()
    asked, names = _stack(picked["v"]), picked["node"].to_numpy()

    def true_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(names), dtype=np.int64)
        for batch in batches:
            m, size, node = _stack(batch["v"]), batch["size"].to_numpy(), batch["node"].to_numpy()
            for at in range(0, len(m), 4096):
                over = (asked @ m[at : at + 4096].T >= index.threshold) & (names[:, None] != node[at : at + 4096])
                total += over @ size[at : at + 4096]
        yield pd.DataFrame({"node": names, "truth": total})[total > 0]

    truth = classes.select("node", "size", "v").mapInPandas(lean(true_links), "node long, truth long").groupBy("node").agg(F.sum("truth").alias("truth"))
    both = truth.join(counted, "node", "left").agg(F.sum("truth"), F.sum(F.least("truth", F.coalesce("links", F.lit(0))))).first()
    return both[1] / both[0] if both[0] else 1.0


def near_duplicates(vectors: DataFrame, id_col: str, vector: str, index: Index | None = None) -> DataFrame:
    """id, n_links, component_id, kept, recall for each row of ``vectors``.

    Vectors that are null, empty, zero, or hold a null, NaN or infinite entry, and rows
    without an id, link with nothing and stay.  Vectors of different lengths do not link.
    Repeated rows are vectors of their own and link with each other.  ``recall`` is the audit's
    last figure.  An empty table gives an empty one; further columns are not read.
    """
    index, classes = index or Index(), classes_of(vectors, id_col, vector)
    known = classes.select("key", "rep", "size", "node", F.size("v").alias("length"))
    facts, recall = None, 1.0
    for (length,) in classes.select(F.size("v")).distinct().orderBy(F.size("v")).collect():  # the lengths that occur: one, as a rule
        own, how = classes.where(F.size("v") == length), index
        counted, spanning = links(own, how)
        reached = audit(own, counted, how)
        for _ in range(how.attempts - 1):
            if reached >= how.recall:
                break
            how = how.wider()
            counted, spanning = links(own, how)
            reached = audit(own, counted, how)
        recall = min(recall, reached)
        grouped = connected_components(spanning, name="embedding-components")
        found = known.where(F.col("length") == length).join(counted, "node", "left").join(grouped, "node", "left")
        found = found.withColumn("component", F.coalesce("component", "node"))
        facts = found if facts is None else facts.unionByName(found)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(usable(F.col(vector)) & F.col(id_col).isNotNull(), digest(F.col(vector))).alias("key"))
    if facts is None:
        own = rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    else:
        smallest = facts.groupBy("component").agg(F.min("rep").alias("component_id"))
        facts = staged(facts.join(smallest, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id"), "embedding-facts")
        own = split_join(rows, facts, "key").select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return own.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumn("recall", F.lit(recall))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding with its links of cosine 0.95 or more and its component."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")
