"""Mini-batch k-means over a table: batches by hash, a rate for each centre, centres in a small table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.session import discard, staged

SEED, BATCH, ROUNDS = 20260621, 2048, 200
#: Rounds after which the fit ends if the smoothed loss has not fallen by this share, and sampled rows for each centre to begin with.
PATIENCE, LESS, SAMPLE = 10, 1e-3, 20


def _stack(column: pd.Series, width: int) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in column]).reshape(-1, width)


#: Rows and centres that meet at a time, and centres that a portion (one array in a task) has at most.
ROWS, MEET, PORTION = 256, 1024, 4096
#: Pairs that are compared by differences at a time.
FULL = 16384


def nearest_centre(m: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre, the first of equal ones, and its squared distance.

    Squared lengths and a product give the distances up to rounding; only the centres that
    it leaves in doubt are compared by differences.  Some rows meet some centres at a time.
    """
    near, apart = np.zeros(len(m), dtype=np.int64), np.full(len(m), np.inf)
    for at in range(0, len(m), ROWS):
        x = m[at : at + ROWS]
        own, best = near[at : at + ROWS], apart[at : at + ROWS]
        for c in range(0, len(centres), MEET):
            part = centres[c : c + MEET]
            lengths = (x**2).sum(axis=1)[:, None] + (part**2).sum(axis=1)
            about = lengths - 2 * (x @ part.T)
            off = (m.shape[1] + 8) * 2.0**-50 * lengths
            least = np.minimum((about + off).min(axis=1), best)
            i, j = np.nonzero(~(about - off > least[:, None]))
            for d in range(0, len(i), FULL):
                u, v = i[d : d + FULL], j[d : d + FULL]
                exact = ((x[u] - part[v]) ** 2).sum(axis=1)
                order = np.lexsort((v, exact, u))
                first = order[np.flatnonzero(np.diff(u[order], prepend=-1))]
                closer = first[exact[first] < best[u[first]]]  # equal ones before stay
                own[u[closer]], best[u[closer]] = v[closer] + c, exact[closer]
    return near, apart


def first_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: each next centre drawn by squared distance from those before."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(sample)))]
    apart = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = apart.sum()
        chosen.append(int(rng.choice(len(sample), p=apart / total)) if total > 0 else len(chosen) % len(sample))
        apart = np.minimum(apart, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen].copy()


def mini_batch_kmeans(df: DataFrame, id_col: str, vector: str, clusters: int = 200, seed: int = SEED, batch: int = BATCH, rounds: int = ROUNDS) -> DataFrame:
    """The centres (cluster_id, centre, rows) of min(clusters, max(2, rows // 50)) clusters.

    Rows are dealt to batches of about ``batch`` by a hash of seed and id, and a round takes one
    batch: every task adds up its rows by their nearest centre, and a centre moves towards the
    mean of its rows by the share that they are of all rows it has had.  After all batches
    they come again, up to ``rounds`` times over; the fit ends early once the smoothed loss
    has not fallen for PATIENCE rounds.  What reaches the driver is a sum for each centre.
    Null vectors take no part; an empty table gives no centre.
    """
    slim = df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    n = slim.count()
    schema = "cluster_id int, centre array<double>, rows long"
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    batches = max(1, round(n / batch))
    # Batches lie in stretches of files, so that a round reads its own rows alone.
    dealt = staged(slim.withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(batches)).cast("int")).repartitionByRange("_b").sortWithinPartitions("_b"), "kmeans-batches")
    k = min(clusters, max(2, n // 50), n)
    begin = dealt.orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id").limit(k * SAMPLE).select("v").toPandas()
    width = len(begin["v"].iloc[0])
    centres, had = first_centres(_stack(begin["v"], width), k, seed), np.zeros(k)
    smooth, best, idle, share = None, math.inf, 0, min(1.0, 2 * batch / (n + 1))
    for turn in range(rounds * batches):
        sums, counts, loss = _sums(dealt.where(F.col("_b") == turn % batches), centres, width)
        if not counts.sum():
            continue
        had += counts
        rate = np.divide(counts, had, out=np.zeros(k), where=had > 0)[:, None]
        mean = np.divide(sums, counts[:, None], out=centres.copy(), where=counts[:, None] > 0)
        centres = centres + rate * (mean - centres)
        loss /= counts.sum()
        smooth = loss if smooth is None else smooth * (1 - share) + loss * share
        idle = 0 if smooth < best * (1 - LESS) else idle + 1
        best = min(best, smooth) if idle == 0 else best
        if idle >= PATIENCE:
            break
    _, counts, _ = _sums(dealt, centres, width)
    discard(dealt)
    return df.sparkSession.createDataFrame([(i, [float(x) for x in c], int(counts[i])) for i, c in enumerate(centres)], schema)


def _sums(rows: DataFrame, centres: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Of each centre the sum and number of the rows nearest to it, and the squared distances in all."""
    k = len(centres)

    def added(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, loss = np.zeros((k, width + 1)), 0.0
        for part in parts:
            for at in range(0, len(part), 256):
                m = _stack(part["v"].iloc[at : at + 256], width)
                near, apart = nearest_centre(m, centres)
                np.add.at(total, near, np.hstack([m, np.ones((len(m), 1))]))
                loss += apart.sum()
        yield pd.DataFrame({"sums": [np.concatenate([total.ravel(), [loss]])]})

    parts = rows.select("v").mapInPandas(added, "sums array<double>")
    found = dict(parts.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s")).collect())
    flat = np.array([found.get(i, 0.0) for i in range(k * (width + 1) + 1)])
    table = flat[:-1].reshape(k, width + 1)
    return table[:, :-1], table[:, -1], float(flat[-1])


def assigned(df: DataFrame, vector: str, centres: DataFrame, out: str = "cluster_id") -> DataFrame:
    """``df`` with its nearest centre, of a table (cluster_id, centre); the smaller number of equal ones, null for a null vector.

    Centres are packed into portions of bounded size, each a row.  A row of ``df`` keeps the
    best it has met while the portions come one after the other, and no row of ``df`` moves.
    The driver takes a portion at a time and hands it to the tasks as an array.
    """
    numbered = centres.select("cluster_id", "centre").where("cluster_id is not null and centre is not null")
    found = df.withColumn(out, F.lit(None).cast("int")).withColumn("_apart", F.lit(None).cast("double"))
    after = None
    while True:
        rest = numbered if after is None else numbered.where(F.col("cluster_id") > after)
        held = sorted((r["cluster_id"], list(r["centre"])) for r in rest.orderBy("cluster_id").limit(PORTION).collect())
        if not held:
            break
        met = _nearer(np.array([i for i, _ in held], dtype=np.int32), np.array([c for _, c in held], dtype=np.float64))
        found = found.withColumn("_met", met(F.col(vector), F.col(out), F.col("_apart"))).withColumns({out: F.col("_met.number"), "_apart": F.col("_met.apart")}).drop("_met")
        after = held[-1][0]
    return found.drop("_apart")


def _nearer(numbers: np.ndarray, places: np.ndarray):
    """The nearest centre of those so far and of a portion, as number and squared distance."""

    @F.pandas_udf("number int, apart double")
    def near(column: pd.Series, number: pd.Series, apart: pd.Series) -> pd.DataFrame:
        known = column.notna().to_numpy()
        best, least = number.astype("Int32"), apart.astype("float64").to_numpy(copy=True)
        spots = np.flatnonzero(known)
        for at in range(0, len(spots), ROWS):
            some = spots[at : at + ROWS]
            which, distance = nearest_centre(_stack(column.iloc[some], places.shape[1]), places)
            closer = ~(distance >= least[some])  # none so far: nan
            best.iloc[some[closer]] = numbers[which[closer]]
            least[some[closer]] = distance[closer]
        return pd.DataFrame({"number": best, "apart": least})

    return near
