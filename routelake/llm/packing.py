"""Best-fit packing of documents into bins under conflicts.

A document's words (or a given length) are cut into pieces of at most one bin; full pieces
take a bin each, and the last piece is packed.  Documents are dealt over shards of a bounded
number of rows by a hash of all that identifies a row, so a hot source or cluster is
spread evenly.  Within a shard, in decreasing order of length, each piece goes to the
tightest bin that it fits and that holds no document of its duplicate cluster and fewer
than ``PER_SOURCE`` of its source: bins are ordered by what is left of them, each carries
bitmaps of sources and clusters, and the search goes on from bin to next larger bin until
one is compatible.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.llm.common import documents
from routelake.llm.exact_dedup import normalised
from routelake.llm.mixing import word_count
from routelake.session import staged

CAPACITY = 4096
#: Documents of one source that a bin holds at most.
PER_SOURCE = 6
#: Documents in a shard, on average, and rows that agree in all that are dealt together at most.
SHARD_ROWS, COPIES = 4096, 256
PACKED = "doc_id long, piece int, n_words long, bin long, bin_offset long, bin_used long"


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[tuple[int, int]]:
    """Bin and offset of each piece.  Sources and clusters are small numbers; cluster -1 conflicts with none.

    Lengths of 0 are packed as the others.  Pieces are taken in decreasing length, then in the
    order given; of bins equally tight the first opened is taken.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    left: list[tuple[int, int]] = []  # (words left, bin), ascending
    by_source: list[list[int]] = []  # of each bin: bitmaps of the sources held once, twice, ...
    by_cluster: list[int] = []
    placed: list[tuple[int, int]] = [(-1, -1)] * len(lengths)
    for i in order:
        n, source, cluster = lengths[i], 1 << sources[i], 1 << clusters[i] if clusters[i] >= 0 else 0
        at = bisect_left(left, (n, -1))
        while at < len(left) and (by_cluster[left[at][1]] & cluster or by_source[left[at][1]][-1] & source):
            at += 1
        if at < len(left):
            room, own = left.pop(at)
        else:
            room, own = capacity, len(by_cluster)
            by_source.append([0] * per_source)
            by_cluster.append(0)
        placed[i] = own, capacity - room
        by_cluster[own] |= cluster
        held = by_source[own]
        held[next(k for k in range(per_source) if not held[k] & source)] |= source
        insort(left, (room - n, own))
    return placed


def _pack(capacity: int, per_source: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["doc_id", "cluster", "words", "source", "chunk"], kind="stable", na_position="last")
        shard = shard.loc[shard.index.repeat(shard["copies"])].reset_index(drop=True)
        full = (np.maximum(shard["words"].to_numpy() - 1, 0) // capacity).astype(np.int64)
        n_words = shard["words"].to_numpy() - full * capacity
        sources = pd.factorize(shard["source"], use_na_sentinel=False)[0]
        clusters, names = pd.factorize(shard["cluster"].where(shard["words"] > 0), use_na_sentinel=True)
        # Only clusters with two pieces or more need a bit.
        sizes = pd.Series(clusters).value_counts()
        bit = {c: k for k, c in enumerate(c for c, n in sizes.items() if n > 1 and c >= 0)}
        placed = best_fit(n_words.tolist(), sources.tolist(), [bit.get(c, -1) for c in clusters], capacity, per_source)
        own = np.array([b for b, _ in placed], dtype=np.int64)
        used = pd.Series(n_words).groupby(own).transform("sum").to_numpy()
        first = np.int64(shard["shard"].iloc[0]) << 32
        ids = shard["doc_id"].astype("Int64")
        last = pd.DataFrame({"doc_id": ids, "piece": full, "n_words": n_words, "bin": first + own, "bin_offset": [o for _, o in placed], "bin_used": used})
        # Full pieces take the bins after these, one each.
        row = np.repeat(np.arange(len(full)), full)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
        after = first + (own.max() + 1 if len(own) else 0) + np.arange(len(row))
        whole = pd.DataFrame({"doc_id": ids.to_numpy()[row], "piece": piece, "n_words": capacity, "bin": after, "bin_offset": 0, "bin_used": capacity})
        return pd.concat([last, whole.astype({"doc_id": "Int64"})])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> DataFrame:
    """One row for each piece: doc_id, piece, n_words, bin, bin_offset, bin_used.

    Pieces of a document are numbered from 0; a text without words (null too) is one piece of
    length 0.  A null source is a source of its own.  Duplicate clusters are texts equal but
    for white space; texts without words are in no cluster.  Rows that repeat an id are packed
    each on its own.  Bin numbers are unique but not gapless.  Empty tables give no rows.  The
    result depends on the rows alone, not on how they lie in partitions: rows that agree in all
    that is read are counted, and dealt in chunks of at most COPIES.
    """
    text = normalised(F.col("text"))
    facts = docs.select("doc_id", "source", word_count(F.col("text")).alias("words"), F.xxhash64(text).alias("cluster"))
    same = staged(facts.groupBy("doc_id", "source", "words", "cluster").agg(F.count("*").alias("all")), "packing-facts")
    n = same.agg(F.sum("all")).first()[0] or 0
    shards = max(1, -(-n // SHARD_ROWS))
    chunks = same.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / COPIES))))
    dealt = chunks.select("doc_id", "source", "words", "cluster", "chunk", F.least(F.lit(COPIES).cast("long"), F.col("all") - F.col("chunk") * COPIES).alias("copies"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "source", "chunk"), F.lit(shards)).cast("long"))
    return dealt.groupBy("shard").applyInPandas(_pack(capacity, per_source), PACKED)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the bin of every piece of every row of documents."""
    return pack(documents(spark, sf_dir))
