"""Exact Jaccard join over word shingles by pivots and regions of the metric space.

The Jaccard distance 1 - |a & b| / |a | b| is a metric; documents link at a distance of at
most 1 - THRESHOLD.  Documents with equal shingle sets are one class, whose members are
never compared; a class stands for all its copies.

1. Seeds.  In this space nearly all documents are at distance 1 from each other, where the
   triangle inequality tells nothing apart.  So the first regions are those of seeds: all
   shingles have one global order, frequent ones last, and a class lies in the regions of
   the first |x| - ceil(THRESHOLD * |x|) + 1 of its shingles.  Two sets that link share one
   of these, so each linked pair meets in a region.
2. Pivots.  In each region the class with the smallest number is the pivot, and all others
   are compared with it, which settles groups of near copies with as many comparisons as
   they have members.
3. Regions again.  A region whose classes are all connected is finished, since only the
   components are asked for.  In a small region the unconnected pairs are compared.  A large
   region is compared by itself, unless another one holds all its classes.  Cells: a region
   too wide for one cell is split into rings by the distance from its pivot and into bands of
   set sizes, and each of these into blocks; the classes outside the region's largest
   component are replicated into all rings that the triangle inequality leaves them, in their
   own band and the two beside it.  A class travels with a signature of one to two bits a
   shingle, which bounds the overlap of two sets from above; only classes of which a cell
   finds a pair that the bounds let link are fetched whole and compared there.  So every pair
   that could still connect two components is met; nothing is capped.

Voronoi cells of several pivots were tried first: in a group of near copies all cells lie
within the boundary windows of all others, so that every cell gets every document.  Rings
around one pivot are the cells that the same inequality gives for one pivot.

A pair is compared first by its seeds, which bound the overlap from above, and only if that
leaves a chance by its whole sets.  Shingles are 64-bit hashes of five words; classes are told
apart by 128 bits of their sets' hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.llm.common import documents, few, lean, packed, split_join, texts, unpacked
from routelake.operators.components import connected_components
from routelake.session import discard, staged

WORDS = 5
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Frequent shingles that come last in the order; the order of all others is that of their hashes.
HEAVY = 300_000
#: Regions of at most so many classes compare their unconnected pairs at once.
LEAF = 64
#: Width of a ring as a distance, and ratio of the set sizes in a band: sets that link are in the same or adjacent bands.
RING, BAND = 0.05, 1.26
#: Classes and shingles in a block of a cell, on average, at most.
BLOCK, VOLUME = 4096, 1 << 20
#: Characters hashed at a time, and shingles counted together in a task.
CHUNK = 1 << 18
LOCAL = 1 << 20

_random = np.random.default_rng(20_250_101)
_BYTE = _random.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_PLACE = _random.integers(1, 1 << 63, size=WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64; those of a chunk's length are kept."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK * 2)
        steps = [np.full(size, base, dtype=np.uint64) for base in (_BASE, _BACK)]
        for step in steps:
            step[0] = 1
        found = [np.cumprod(step, dtype=np.uint64) for step in steps]
        if size > CHUNK * 2:
            return found[0], found[1]
        _POWERS[:] = found
    return _POWERS[0], _POWERS[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(strings: list[str]) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; see the contract in ``join``."""
    raw = [s.encode("utf-8", "surrogatepass") for s in strings]
    lengths = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    power, back = _powers(len(data) + 1)
    space = _SPACE[data]
    values = _BYTE[data] * power[: len(data)]
    values[space] = 0
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)])
    before = np.concatenate([[True], space[:-1]])
    begin = np.flatnonzero(before & ~space)
    end = np.flatnonzero(space & ~before)
    words = _mix((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64) * _PLACE[WORDS])
    owners = np.searchsorted(np.cumsum(lengths), begin, side="right")
    counts = np.bincount(owners, minlength=len(raw)) if len(owners) else np.zeros(len(raw), dtype=np.int64)
    total = len(words)
    rolled = np.zeros(total, dtype=np.uint64)
    for k in range(WORDS):
        rolled[: max(0, total - k)] += words[k:] * _PLACE[k] if k else words * _PLACE[0]
    rolled = _mix(rolled)
    out, at = [], 0
    for n in counts:
        if n >= WORDS:
            out.append(np.unique(rolled[at : at + n - WORDS + 1]))
        elif n:
            whole = (words[at : at + n] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + _PLACE[WORDS:] * np.uint64(n)
            out.append(_mix(whole ^ np.uint64(0x5851F42D4C957F2D)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        at += n
    return out


def chunked(strings: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Number and shingles of each text, a bounded amount of text at a time (a longer text alone)."""
    at = 0
    while at < len(strings):
        end, size = at, 0
        while end < len(strings) and (end == at or size + len(strings[end]) < CHUNK):
            size += len(strings[end])
            end += 1
        yield from enumerate(shingle_sets(strings[at:end]), at)
        at = end


def _class_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.astype("<u8").tobytes())


def number(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


FACTS = "doc_id long, text_hash long, n long, set_id binary, sid long, shingle long, uses long"


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each document; and for each shingle that two classes of a stretch share, its count there and the first of them."""
    seen: set[bytes] = set()
    waiting: list[np.ndarray] = []
    holders: list[int] = []

    def shared() -> pd.DataFrame:
        if not waiting:
            return pd.DataFrame({c: [] for c in ("doc_id", "text_hash", "n", "set_id", "sid", "shingle", "uses")})
        found, at, uses = np.unique(np.concatenate(waiting), return_index=True, return_counts=True)
        often = uses > 1
        first = np.array(holders, dtype=np.int64)[np.searchsorted(np.cumsum([len(x) for x in waiting]), at[often], side="right")]
        waiting.clear()
        holders.clear()
        return pd.DataFrame({"doc_id": None, "text_hash": None, "n": None, "set_id": None, "sid": first, "shingle": found[often].view(np.int64), "uses": uses[often]})

    held = 0
    for batch in batches:
        out = []
        for i, shingles in chunked(texts(batch["text"])):
            own = _class_of(shingles) if len(shingles) else None
            out.append((len(shingles), own, number(own) if own else None))
            if own and own not in seen:
                seen.add(own)
                waiting.append(shingles)
                holders.append(number(own))
                held += len(shingles)
                if held > LOCAL:
                    yield shared()
                    held = 0
                    seen.clear()
        sids = pd.array([o[2] for o in out], dtype="Int64")
        yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").array, "text_hash": batch["text_hash"], "n": [o[0] for o in out], "set_id": [o[1] for o in out], "sid": sids, "shingle": None, "uses": None})
    yield shared()


def ranked(shingles: np.ndarray, heavy: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Places in the global order: hashes halved, then the frequent shingles from 2**63 on."""
    rank = shingles >> np.uint64(1)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, shingles), len(heavy) - 1)
        rank = np.where(heavy[at] == shingles, places[at] | np.uint64(1 << 63), rank)
    return rank


def seed_count(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def signature(shingles: np.ndarray) -> bytes:
    """For each place of a table of one to two bits a shingle, whether an odd number of them falls there."""
    width = max(64, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(signs: np.ndarray, words: int) -> np.ndarray:
    """Rows of signatures as they are in tables of ``words`` 64-bit words, half their width or the same."""
    return signs if signs.shape[1] == words else signs[:, :words] ^ signs[:, words:]


def most_shared(ours: np.ndarray, n: np.ndarray, other: np.ndarray, other_n: int) -> np.ndarray:
    """The most that sets can share with another one: places that differ are shingles that only one of the two has."""
    apart = np.bitwise_count(ours ^ other).sum(axis=1, dtype=np.int64)
    return np.minimum((n + other_n - apart) // 2, np.minimum(n, other_n))


def _seeds(order):
    """``order`` is broadcast: the frequent shingles and their places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heavy, places = order.value
        seen: set[bytes] = set()
        for batch in batches:
            out = []
            for _, shingles in chunked(texts(batch["text"])):
                if not len(shingles) or (own := _class_of(shingles)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(own)
                first = np.sort(ranked(shingles, heavy, places))[: seed_count(len(shingles))]
                out.append((number(own), len(shingles), first.view(np.int64), signature(shingles)))
            yield pd.DataFrame(out, columns=["sid", "n", "seeds", "sign"])

    return run


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [(number(_class_of(s)), s.astype("<u8").tobytes()) for _, s in chunked(texts(batch["text"])) if len(s)]
        yield pd.DataFrame(out, columns=["sid", "shingles"])


def seed_bound(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> int:
    """The most that two sets can share, by their seeds (sorted places, the first of each set's order)."""
    limit = min(a[-1], b[-1])
    x, y = int(np.searchsorted(a, limit, side="right")), int(np.searchsorted(b, limit, side="right"))
    common = len(np.intersect1d(a[:x], b[:y], assume_unique=True))
    return common + min(na - x, nb - y)


def may_link(overlap: int, na: int, nb: int) -> bool:
    return 100 * overlap >= PERCENT * (na + nb - overlap)


def _bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        good = [may_link(seed_bound(np.asarray(r.seeds).view(np.uint64), r.n, np.asarray(r.other_seeds).view(np.uint64), r.other_n), r.n, r.other_n) for r in batch.itertuples(index=False)]
        yield batch.loc[good, ["a", "b"]]


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            x, y = np.frombuffer(r.shingles, dtype="<u8"), np.frombuffer(r.other, dtype="<u8")
            shared = len(np.intersect1d(x, y, assume_unique=True))
            out.append((r.a, r.b, shared, len(x) + len(y) - shared))
        yield pd.DataFrame(out, columns=["a", "b", "shared", "joint"])


class Space:
    """The classes of a document table, and comparisons between them."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select("doc_id", "text")
        rows = staged(self.docs.withColumn("text_hash", F.xxhash64("text")).mapInPandas(lean(_facts), FACTS), "jaccard-facts")
        self.facts = rows.where("n is not null").select("doc_id", "text_hash", "n", "set_id", "sid")
        uses = rows.where("shingle is not null").groupBy("shingle").agg(F.sum("uses").alias("uses"), F.min("sid").alias("first"))
        heavy = uses.orderBy(F.desc("uses"), "shingle").limit(HEAVY).toArrow()  # at most HEAVY rows of three numbers
        order = self._order(*(heavy[c].to_numpy() for c in ("shingle", "uses", "first")))
        shared = self.docs.sparkSession.sparkContext.broadcast(order)
        self.classes = staged(self.facts.where("sid is not null").groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.first("sid").alias("sid"), F.count("*").alias("copies")), "jaccard-classes")
        self.seeds = staged(self.docs.mapInPandas(lean(_seeds(shared)), "sid long, n int, seeds array<long>, sign binary"), "jaccard-seeds")

    @staticmethod
    def _order(shingle: np.ndarray, uses: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The frequent shingles ascending, and the place of each: rarer ones first, those of one passage side by side."""
        shingle = shingle.astype(np.int64).view(np.uint64)
        place = np.empty(len(shingle), dtype=np.uint64)
        place[np.lexsort((shingle, first, uses))] = np.arange(len(shingle), dtype=np.uint64)
        order = np.argsort(shingle)
        return shingle[order], place[order]

    def regions(self) -> tuple[DataFrame, DataFrame]:
        """Members of the seeds' regions that have two classes or more, as (region, sid, n, before), and pairs with the pivots.

        ``before`` is the seed before a frequent one in the member's order.
        """
        rare = self.seeds.select(F.explode("seeds").alias("seed"), "sid", "n").where("seed >= 0")  # places from 2**63 on are negative
        ordered = F.arrays_zip("seeds", F.expr("concat(array(cast(null as bigint)), slice(seeds, 1, size(seeds) - 1))").alias("before"))
        common = self.seeds.select(F.explode(ordered).alias("at"), "sid", "n").select(F.col("at.seeds").alias("seed"), "sid", "n", F.col("at.before").alias("before")).where("seed < 0")
        dealt = rare.repartition("seed")  # shuffled once, for the pivots and for the join with them
        pivots = dealt.groupBy("seed").agg(F.min(F.struct("sid", "n")).alias("low"), F.max("sid").alias("high")).where("low.sid <> high").select("seed", F.col("low.sid").alias("pivot"), F.col("low.n").alias("pivot_n"))
        found = dealt.join(pivots, "seed")
        # A frequent seed's rows stay where they are: its pivot, one of at most HEAVY, is broadcast.
        few = common.groupBy("seed").agg(F.min(F.struct("sid", "n")).alias("low"), F.max("sid").alias("high")).where("low.sid <> high").select("seed", F.col("low.sid").alias("pivot"), F.col("low.n").alias("pivot_n"))
        both = staged(found.withColumn("before", F.lit(None).cast("long")).unionByName(common.join(F.broadcast(few), "seed")), "jaccard-regions")
        pairs = both.where(F.col("sid") != F.col("pivot")).where(near("n", "pivot_n")).select(F.col("pivot").alias("a"), F.col("sid").alias("b")).distinct()
        return both.select(F.col("seed").alias("region"), "sid", "n", "before").distinct(), pairs

    def sets(self, sids: DataFrame) -> DataFrame:
        """sid, shingles (sorted, as bytes) of the classes with these numbers, from their first documents' texts."""
        ends = staged(self.classes.join(sids.distinct(), "sid", "left_semi").select("sid", "first_id"), "jaccard-ends")
        firsts = few(staged(ends.select("first_id").distinct(), "jaccard-firsts"))
        chosen = self.docs.join(firsts, F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
        found = chosen.mapInPandas(lean(_sets), "sid long, shingles binary")
        out = staged(found.join(ends.select("sid").distinct(), "sid", "left_semi").dropDuplicates(["sid"]), "jaccard-sets")
        discard(ends)
        return out

    def compare(self, pairs: DataFrame) -> DataFrame:
        """a, b, shared, joint of those pairs of class numbers that their seeds let link."""
        ends = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
        seeds = staged(self.seeds.join(few(staged(ends, "jaccard-ends")), "sid", "left_semi").dropDuplicates(["sid"]), "jaccard-compared")
        other = seeds.select(F.col("sid").alias("b"), F.col("n").alias("other_n"), F.col("seeds").alias("other_seeds"))
        pairs = staged(pairs.join(other, "b").join(seeds.withColumnRenamed("sid", "a"), "a").mapInPandas(lean(_bounded), "a long, b long"), "jaccard-bounded")
        sets = self.sets(pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))))
        other = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("other"))
        found = staged(pairs.join(other, "b").join(sets.withColumnRenamed("sid", "a"), "a").mapInPandas(lean(_measured), "a long, b long, shared long, joint long"), "jaccard-measured")
        discard(seeds, pairs, sets)
        return found


def near(a: str, b: str, percent: int = PERCENT):
    """Whether sizes allow a similarity of so many per cent."""
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def linked():
    return F.expr(f"100 * shared >= {PERCENT} * joint")


CELL = ["region", "ring", "band", "block", "part"]
FOUND = "region long, ring int, band int, block int, part int, sid long, component long, home boolean, away boolean"


def _chances(rows: pd.DataFrame) -> pd.DataFrame:
    """The classes of a cell of which a member (home) and a visitor (away) of other components might link."""
    home, away = rows["home"].to_numpy(), rows["away"].to_numpy()
    sizes, components = rows["n"].to_numpy().astype(np.int64), rows["component"].to_numpy()
    words = np.array([len(x) // 8 for x in rows["sign"]])
    chance = np.zeros(len(rows), dtype=bool)

    def signs(chosen: np.ndarray, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(rows["sign"].iloc[chosen]), dtype="<u8").reshape(len(chosen), width)

    for width in np.unique(words[home]):
        members = np.flatnonzero(home & (words == width))
        for other in (width // 2, width, 2 * width):
            visitors = np.flatnonzero(away & (words == other))
            if other and len(visitors):
                common = min(width, other)
                ours = folded(signs(members, width), common)
                for at, sign in zip(visitors, folded(signs(visitors, other), common), strict=True):
                    most = most_shared(ours, sizes[members], sign, sizes[at])
                    good = (100 * most >= PERCENT * (sizes[members] + sizes[at] - most)) & (components[members] != components[at])
                    if good.any():
                        chance[at] = True
                        chance[members[good]] = True
    return rows.loc[chance, [*CELL, "sid", "component", "home", "away"]]


def _connect(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the members and visitors of a cell that connect their components, no more than that takes."""
    found, root = [], {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    members, visitors = rows[rows["home"]], rows[rows["away"]]
    if len(members) and len(visitors):
        sets = [np.frombuffer(x, dtype="<u8") for x in members["shingles"]]
        sizes = np.array([len(x) for x in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], np.repeat(np.arange(len(sets)), sizes)[order]
        sids, components = members["sid"].to_numpy(), members["component"].to_numpy()
        for sid, component, raw in zip(visitors["sid"], visitors["component"], visitors["shingles"], strict=True):
            own = np.frombuffer(raw, dtype="<u8")
            lo = np.searchsorted(every, own, side="left")
            n = np.searchsorted(every, own, side="right") - lo
            hits = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            shared = np.bincount(owner[hits], minlength=len(sets))
            for at in np.flatnonzero((100 * shared >= PERCENT * (sizes + len(own) - shared)) & (components != component)):
                x, y = top(component), top(components[at])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    found.append((sid, sids[at]))
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _pieces():
    """Blocks for a group's classes and shingles."""
    return F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.col("n").cast("long")) / VOLUME)).cast("int")


def _ringed(space: Space, wide: DataFrame) -> DataFrame:
    """``wide`` with the ring of each class by its distance from its region's pivot, the class with the smallest number."""
    pivots = wide.groupBy("region").agg(F.min("sid").alias("pivot"))
    placed = staged(wide.join(pivots, "region"), "jaccard-wide")
    sets = space.sets(placed.select("sid"))
    centre = sets.join(pivots.select(F.col("pivot").alias("sid")).distinct(), "sid").select(F.col("sid").alias("a"), F.col("shingles").alias("other"))
    met = placed.select(F.col("pivot").alias("a"), F.col("sid").alias("b")).distinct().join(sets.withColumnRenamed("sid", "b"), "b").join(centre, "a")
    met = met.mapInPandas(lean(_measured), "a long, b long, shared long, joint long")
    met = met.select(F.col("a").alias("pivot"), F.col("b").alias("sid"), ((F.col("joint") - F.col("shared")) / F.col("joint")).alias("distance"))
    ringed = staged(placed.join(met, ["pivot", "sid"]).drop("pivot").withColumn("ring", F.floor(F.col("distance") / RING).cast("int")), "jaccard-rings")
    discard(sets, placed)
    return ringed


def _cells(space: Space, wide: DataFrame) -> DataFrame:
    """The classes of wide regions in the blocks of their cells, and visitors in each cell where they could find a link."""
    ringed = _ringed(space, wide).withColumn("band", F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int"))
    place = ["region", "ring", "band"]
    cells = ringed.groupBy(*place).agg(_pieces().alias("blocks"))
    reach = (100 - PERCENT) / 100 + 1e-9
    rings = F.sequence(F.floor((F.col("distance") - reach) / RING).cast("int"), F.floor((F.col("distance") + reach) / RING).cast("int"))
    visits = ringed.where("away").withColumn("ring", F.explode(rings)).withColumn("band", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)))
    visits = visits.join(cells, place)
    parts = visits.groupBy(*place).agg(_pieces().alias("parts"))
    own = F.xxhash64("sid")
    columns = [*CELL, "sid", "n", "component", "home", "away"]
    members = ringed.join(cells, place).join(parts, place).withColumn("block", F.pmod(own, "blocks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    visitors = visits.join(parts, place).withColumn("part", F.pmod(own, "parts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return members.withColumn("home", F.lit(True)).withColumn("away", F.lit(False)).select(columns).unionByName(visitors.withColumn("home", F.lit(False)).select(columns))


def within(space: Space, large: DataFrame) -> DataFrame:
    """Links that connect different components among the classes of each large region (region, sid, n, component)."""
    sizes = large.groupBy("region", "component").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("region").agg(F.max(F.struct("k", "component")).alias("most")).select("region", F.col("most.component").alias("largest"))
    blocks = large.groupBy("region").agg(_pieces().alias("blocks"))
    placed = staged(large.join(largest, "region").join(blocks, "region").withColumn("away", F.col("component") != F.col("largest")).drop("largest"), "jaccard-large")
    # A region of one block is one cell, whose classes are its members; some of these are visitors as well.
    cells = placed.where("blocks = 1").select("region", *[F.lit(0).alias(c) for c in CELL[1:]], "sid", "n", "component", F.lit(True).alias("home"), "away")
    wide = placed.where("blocks > 1").drop("blocks")
    if wide.limit(1).count():
        cells = cells.unionByName(_cells(space, wide))
    numbers = few(staged(placed.select("sid").distinct(), "jaccard-numbers"))
    signs = space.seeds.select("sid", "sign").join(numbers, "sid", "left_semi").dropDuplicates(["sid"])
    chances = staged(cells.join(signs, "sid").groupBy(*CELL).applyInPandas(_chances, FOUND), "jaccard-chances")
    sets = space.sets(chances.select("sid"))
    found = staged(chances.join(sets, "sid").groupBy(*CELL).applyInPandas(_connect, "a long, b long"), "jaccard-within")
    discard(sets, chances, placed)
    return found


def links(space: Space) -> DataFrame:
    """Links between classes, enough to connect all that are connected: a, b."""
    regions, pairs = space.regions()
    found = space.compare(pairs).where(linked()).select("a", "b")
    label = connected_components(found, name="jaccard-components").select(F.col("node").alias("sid"), F.col("component"))
    named = regions.join(label, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    # Regions of one component are finished; of regions with the same classes (by number, sum and ends of their hashes) one goes on.
    # If all classes of a region have the same seed before its own, that seed's region holds them all; of several regions
    # with the same classes the first in order tells whether a larger one does.
    nested = (F.count("before") == F.count("*")) & (F.min("before") == F.max("before"))
    own = F.xxhash64("sid")
    facts = named.groupBy("region").agg(F.count("*").alias("size"), F.sum(own.cast("decimal(38,0)")).alias("print"), F.min(own).alias("first"), F.max("sid").alias("last"), F.min("component").alias("low"), F.max("component").alias("high"), nested.alias("nested")).where("low <> high")
    kept = facts.groupBy("size", "print", "first", "last").agg(F.min("region").alias("region"), F.count("*").alias("weight"), F.bool_and("nested").alias("nested")).select("region", "size", "weight", "nested")
    left = staged(named.join(kept, "region"), "jaccard-left")
    x, y = left.where(F.col("size") <= LEAF).alias("x"), left.where(F.col("size") <= LEAF).alias("y")
    met = x.join(y, "region").where("x.sid < y.sid and x.component <> y.component").where(near("x.n", "y.n"))
    # Two classes share the seeds of the regions they meet in, and beyond their seeds at most what follows those
    # of one of them.  (Those that also meet in a large region are compared there.)
    met = met.groupBy(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).agg(F.sum("x.weight").alias("common"))
    after = "ceil(%d * {0} / 100) - 1" % PERCENT
    most = F.expr(f"least(common + greatest({after.format('na')}, {after.format('nb')}), na, nb)")
    small = met.withColumn("most", most).where(f"100 * most >= {PERCENT} * (na + nb - most)").select("a", "b")
    found = found.unionByName(space.compare(small).where(linked()).select("a", "b"))
    large = left.where((F.col("size") > LEAF) & ~F.col("nested")).select("region", "sid", "n", "component")
    return found.unionByName(within(space, large)) if large.limit(1).count() else found


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies (rows with the same set) for each row of ``docs``.

    Words are what ASCII white space separates, A-Z in lower case.  A set holds the distinct
    runs of five words; with fewer words the whole sequence is its one shingle; without words,
    and for null texts, it is empty and links with nothing.  Rows that repeat a text are
    copies.  A component is named by its smallest doc_id; an empty document by its own.
    Null ids count as larger than all others.  Rows that repeat an id are documents of their
    own.  Empty tables give no rows; other columns are ignored.
    """
    return _members(docs).drop("text_hash")


def _members(docs: DataFrame) -> DataFrame:
    """The join's rows with a hash of their texts."""
    space = Space(docs)
    label = connected_components(links(space), name="jaccard-components")
    classes = space.classes.join(label, space.classes["sid"] == label["node"], "left").withColumn("component", F.coalesce("component", "sid"))
    firsts = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = staged(classes.join(firsts, "component").select("set_id", "component_id", "copies"), "jaccard-named")
    full = split_join(space.facts.where("sid is not null"), named, "set_id")
    empty = space.facts.where("sid is null").select("doc_id", "text_hash", "n", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("copies"))
    return full.select("doc_id", "text_hash", "n", "component_id", "copies").unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("copies").alias("n_copies"), "text_hash")


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; its columns as they were.

    Rows without a shingle stay.  Rows that repeat the smallest id, or of a component without
    ids, all stay.  Rows that share an id with another text's are told apart by their texts.
    """
    dropped = _members(docs).where("doc_id <> component_id or (doc_id is null and component_id is not null)").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    gone = few(staged(dropped, "jaccard-dropped"))
    own = packed(docs, _own_id=F.col("doc_id"), _own_hash=F.xxhash64("text"))
    return unpacked(own.join(gone, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash")), "left_anti"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the component of every row of documents."""
    return join(documents(spark, sf_dir))


#: Every shared shingle joined with every other: for small tables only.
ORACLE = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM worded),
sized AS MATERIALIZED (
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n, CASE WHEN len(s) > 0 THEN count(*) OVER (PARTITION BY sha256(array_to_string(list_sort(s), chr(10)))) ELSE 0 END AS n_copies FROM shingled),
members AS MATERIALIZED (SELECT doc_id, hash(unnest(s)) AS h FROM shingled),
common AS MATERIALIZED (SELECT doc_id, h FROM members WHERE h IN (SELECT h FROM members GROUP BY h HAVING count(*) > 1)),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM common x JOIN common y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN sized m ON m.doc_id = p.a JOIN sized k ON k.doc_id = p.b WHERE 100 * shared >= 80 * (m.n + k.n - shared)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.node)
SELECT s.doc_id, s.n AS n_shingles, min(r.root) AS component_id, CAST(s.n_copies AS BIGINT) AS n_copies FROM sized s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, s.n, s.n_copies
"""
