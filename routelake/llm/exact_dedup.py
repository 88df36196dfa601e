"""Exact deduplication with a heavy-hitter split (DataFrame operations only).

Digests of the normalised texts are grouped.  A Misra-Gries family summary (Spark's
``approx_top_k`` aggregate: counters that are decremented when the table is full, with
map-side partial summaries that merge) names the digests that may be frequent.  These
candidates are counted exactly; the winners among them, at most ``TOP`` rows of fixed
size, are broadcast, so that their copies are settled on the map side and no task
gathers them.  All other digests take the ordinary shuffle, with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.llm.common import SPACE, documents, few, fingerprint, packed, unpacked
from routelake.session import staged

#: Counters in the summary, and the most digests that are broadcast (about 100 bytes each).
COUNTERS = 4096
TOP = 1024
#: A digest is settled on the map side if more than this share of the rows carry it.
HOT_SHARE = 1 / 4096


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space is replaced by one
    space; null counts as empty.  The smallest id of a group stays.  Rows that repeat an id
    and a text form one group, count once each, and all carry ``kept`` if their id stays
    (``surviving`` keeps one of them).  A group whose ids are all null keeps id null.
    Empty tables give empty results; other columns are ignored.
    """
    digests = staged(docs.select(F.col(id_col).alias("id"), F.sha2(F.encode(normalised(F.col(text_col)), "utf-8"), 256).alias("digest")), "digests")
    heavy = digests.agg(F.expr(f"approx_top_k(digest, {TOP}, {COUNTERS})").alias("top")).select(F.explode("top.item").alias("digest"))
    total = digests.agg(F.count("*").alias("total"))
    winners = (
        digests.join(F.broadcast(heavy), "digest", "left_semi")
        .groupBy("digest").agg(F.min("id").alias("hot_keep"), F.count("*").alias("hot_size"))
        .join(F.broadcast(total), F.expr(f"hot_size > 1 and hot_size > total * {HOT_SHARE!r}"))
        .select("digest", "hot_keep", "hot_size")
    )
    split = digests.join(F.broadcast(winners), "digest", "left")
    hot = split.where("hot_size is not null").select("id", "digest", F.col("hot_keep").alias("keep"), F.col("hot_size").alias("size"))
    cold = split.where("hot_size is null").select("id", "digest")
    groups = cold.groupBy("digest").agg(F.min("id").alias("keep"), F.count("*").alias("size"))
    return hot.unionByName(cold.join(groups, "digest").select("id", "digest", "keep", "size")).select(
        F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def surviving(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the smallest id; its columns as they were.

    Of rows that repeat that id and text the one whose columns hash lowest stays.
    """
    verdict = staged(deduplicate(docs.select(id_col, text_col), id_col, text_col).select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_digest"), "kept"), "verdict")
    gone = few(staged(verdict.where("not kept").select("_id", "_digest").distinct(), "dropped"))
    own = packed(docs, _own=F.sha2(F.encode(normalised(F.col(text_col)), "utf-8"), 256), _own_id=F.col(id_col), _print=fingerprint(docs))
    rows = own.join(gone, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_digest")), "left_anti")
    # The texts are moved only where there are many rows to drop, or where some id and text repeat.
    repeated = verdict.where("kept").groupBy("_id", "_digest").count().where("count > 1").limit(1).count() > 0
    return unpacked(rows.groupBy("_own_id", "_own").agg(F.min_by("_row", "_print").alias("_row")) if repeated else rows)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the verdict on every row of documents."""
    return deduplicate(documents(spark, sf_dir))


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
WINDOW same AS (PARTITION BY text_sha256)
"""
