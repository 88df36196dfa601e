"""What the operators share: column names, hashing splits and input shaping."""

from __future__ import annotations

import ctypes
import gc
import math
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, the only separator that the contracts know.
SPACE = r"[\x20\x09-\x0D]"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's decimal text leaves no remainder by FOLDS (null id: not)."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % FOLDS == 0, F.lit(False))


def packed(docs: DataFrame, **named: Column) -> DataFrame:
    """The rows whole, as ``_row``, beside the named columns, so that no name of theirs can clash; ``unpacked`` undoes it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[v.alias(k) for k, v in named.items()])


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("_row.*")


#: Rows of short numbers or digests that are broadcast at most; more are joined by a shuffle.
FEW = 500_000


def few(rows: DataFrame) -> DataFrame:
    """``rows`` (staged and short), to be broadcast if there are at most FEW of them."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def texts(column: pd.Series) -> list[str]:
    """The column's strings, null as empty."""
    return [x if isinstance(x, str) else "" for x in column]


def lean(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``run``, which at its end gives its free memory back to the system: Spark keeps a worker for later stages, and with it all it holds."""

    def wrapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
            trim(0)

    return wrapped


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


#: Rows that a task sorts and numbers in one group, on average, at least; of larger tables the square root of their rows.
RUN_ROWS = 4096


def spread(*columns: Column) -> Column:
    """A uniform 128-bit order, as 32 hex digits, that depends on the values alone."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x1e")) for c in columns]))


def running(df: DataFrame, keys: list[str], order: str, ties: list[str], value: Column, out: str, rows: int, together: bool = False) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the same keys before and with this one
    (and, ``together``, with those that agree with it in order and ties).

    ``order`` holds ``spread`` digits.  They are cut into ranges so that a range holds about
    RUN_ROWS of the ``rows``, or their square root: ranges are summed up, their sums run up in
    a table as small as there are ranges, and only the rows of one key and range are sorted
    together.  A key that holds most of the rows is so dealt over many tasks.
    """
    ranges = max(1, -(-rows // max(RUN_ROWS, math.isqrt(rows))))
    at = F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * ranges / F.lit(2.0**32)).cast("int")
    dealt = df.withColumn("_range", at).withColumn("_value", value)
    nulls = [F.coalesce(F.col(k).cast("string"), F.lit("\x1e")) for k in keys]
    dealt = dealt.withColumn("_key", F.concat_ws("\x1f", *nulls) if keys else F.lit(""))
    sums = dealt.groupBy("_key", "_range").agg(F.sum("_value").alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("_key").orderBy("_range")) - F.col("_sum")).drop("_sum")
    within = Window.partitionBy("_key", "_range").orderBy(order, *ties)
    within = (within.rangeBetween if together else within.rowsBetween)(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumn("_own", F.sum("_value").over(within)).join(before, ["_key", "_range"])
    return summed.withColumn(out, F.col("_before") + F.col("_own")).drop("_key", "_range", "_value", "_own", "_before")


def fingerprint(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed, to order rows that agree in all that an operator reads."""
    from pyspark.sql.types import MapType, VariantType

    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))])


#: A join key is hot if more than this share of the rows carry it, so there are fewer than 1 / HOT_KEY of them.
HOT_KEY = 1 / 256


def split_join(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` with ``facts``, which has one short row for each key.

    The facts of hot keys, fewer than 1 / HOT_KEY of them, are broadcast, so that their rows
    stay where they are, and so do rows without a key; all other rows take the shuffle.
    ``rows`` is read more than once.
    """
    bare = rows.where(F.col(key).isNull())
    rows = rows.where(F.col(key).isNotNull())
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*").alias("_all"))
    hot = counts.join(F.broadcast(total), F.expr(f"_n > 1 and _n > _all * {HOT_KEY!r}")).select(F.col(key).alias("_hot"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    few = facts.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left_semi")
    warm = marked.where("_hot is not null").drop("_hot").join(F.broadcast(few), key, "left")
    cold = marked.where("_hot is null").drop("_hot").join(facts, key, "left")
    return warm.unionByName(cold).unionByName(bare, allowMissingColumns=True)
