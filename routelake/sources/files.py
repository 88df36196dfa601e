"""JSON lines, JSON documents, append logs and the embedding cache, on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from routelake.operators.ranges import placed

def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, lenient: bool = False) -> DataFrame:
    """Rows of JSON lines; blank lines skipped, a missing path is an empty table.  A malformed line raises, or is skipped if lenient."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if lenient else "FAILFAST").json(path)


def count_malformed(spark: SparkSession, path: str, schema: StructType) -> int:
    """How many lines of a JSON lines path are not rows of the schema."""
    wide = StructType([*schema.fields]).add("_corrupt_record", "string")
    lines = spark.read.schema(wide).option("mode", "PERMISSIVE").json(path)
    return lines.select("_corrupt_record", *schema.names[:1]).where("_corrupt_record is not null").count()


def _replace(spark: SparkSession, fresh: str, path: str) -> None:
    """Put a folder that is whole in another's place; the old one goes only once the new one is there."""
    jvm = spark.sparkContext._jvm
    place, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, fresh, f"{fresh}-old"))
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = files.exists(place)
    if had and not files.rename(place, old) or not files.rename(new, place):
        raise OSError(f"could not put {fresh} in the place of {path}")
    if had:
        files.delete(old, True)


def write_jsonl(df: DataFrame, path: str) -> int:
    """Replace the path's content; nulls are kept as keys.  Returns the rows written.

    The rows are written beside the path and put in its place at the end, so a job that fails
    leaves the old content, and ``df`` may read it.
    """
    import uuid

    from pyspark.sql import Observation

    seen, fresh = Observation(), f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.observe(seen, F.count("*").alias("rows")).write.option("ignoreNullFields", "false").json(fresh)
    _replace(df.sparkSession, fresh, path.rstrip("/"))
    return seen.get["rows"]


def append_jsonl(df: DataFrame, path: str, batch: int) -> bool:
    """Add a batch to a log, once: a batch that is there already is left as it is.  Whether it was added.

    Rows carry their batch's number as ``batch_seq``, which tells later rows from earlier ones.
    A batch is written where readers do not look, and put in its own folder when it is whole, so
    that the folders are the log's manifest and a job that failed may be run again.
    """
    import uuid

    spark, root = df.sparkSession, path.rstrip("/")
    done, fresh = f"{root}/batch-{batch:020d}", f"{root}/_fresh-{uuid.uuid4().hex}"
    if exists(spark, done):
        return False
    df.withColumn("batch_seq", F.lit(batch).cast("long")).write.option("ignoreNullFields", "false").json(fresh)
    jvm = spark.sparkContext._jvm
    new, place = jvm.org.apache.hadoop.fs.Path(fresh), jvm.org.apache.hadoop.fs.Path(done)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if exists(spark, done) or not store.rename(new, place):
        store.delete(new, True)  # another writer was first
        return False
    return True


def batches_of(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a log's batches, ascending."""
    if not exists(spark, path):
        return []
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    names = [f.getPath().getName() for f in found]
    return sorted(int(n.removeprefix("batch-")) for n in names if n.startswith("batch-"))


def read_batches(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All rows of a log; a missing one is empty."""
    if not batches_of(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(path)


def write_parts(spark: SparkSession, head: dict, lists: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """One JSON object in ordered parts: the head's fields, and a field for each list (its rows, their order).

    No row holds more than one element.  The folders below ``path`` and the files in them, one
    after the other in the order of their names, are the document.
    """
    import json

    opened = json.dumps(head, ensure_ascii=False)[:-1] + ("," if head else "")
    for i, (name, (rows, order)) in enumerate(lists.items()):
        told = opened if not i else "],"
        spark.createDataFrame([(f"{told}{json.dumps(name)}:[",)], "value string").coalesce(1).write.text(f"{path}/{2 * i:02d}-{name}-begin")
        line = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
        numbered = placed(rows.select(line.alias("_line"), *[F.col(c).alias(f"_{j}") for j, c in enumerate(order)]), [], [f"_{j}" for j in range(len(order))], "_place")
        value = F.concat(F.when(F.col("_place") > 1, ",").otherwise(""), "_line")
        numbered.select("_place", value.alias("value")).repartitionByRange("_place").sortWithinPartitions("_place").select("value").write.text(f"{path}/{2 * i + 1:02d}-{name}")
    spark.createDataFrame([("]}" if lists else opened.rstrip(",") + "}",)], "value string").coalesce(1).write.text(f"{path}/{2 * len(lists):02d}-end")


def read_part(spark: SparkSession, path: str, name: str, at: int, schema: StructType | str) -> DataFrame:
    """The rows of a written document's list, the ``at``-th of its lists from 0."""
    lines = spark.read.text(f"{path}/{2 * at + 1:02d}-{name}")
    return lines.select(F.from_json(F.regexp_replace("value", "^,", ""), schema, {"mode": "FAILFAST"}).alias("_r")).select("_r.*")


def write_document(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON document."""
    import json

    spark.createDataFrame([(json.dumps(value, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> dict | None:
    """The document, or None where the path is missing or its content is no JSON object."""
    import json

    if not exists(spark, path):
        return None
    try:
        value = json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def cached_embeddings(prompts: DataFrame, cache_path: str, embed, hash_col: str = "prompt_hash") -> DataFrame:
    """``prompts`` with embeddings: known hashes from the cache, the others from ``embed`` and then cached."""
    spark = prompts.sparkSession
    schema = f"{hash_col} string, embedding array<float>"
    known = spark.read.schema(schema).parquet(cache_path) if exists(spark, cache_path) else spark.createDataFrame([], schema)
    missing = prompts.join(known, hash_col, "left_anti").dropDuplicates([hash_col])
    embed(missing).select(hash_col, "embedding").write.mode("append").parquet(cache_path)
    return prompts.join(spark.read.schema(schema).parquet(cache_path).dropDuplicates([hash_col]), hash_col)
