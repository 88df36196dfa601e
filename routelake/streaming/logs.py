"""Structured Streaming over append logs: incremental JSON lines, latest row by key, batch appends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from routelake.session import staged
from routelake.sources.files import append_jsonl, batches_of, exists


def read_log(spark: SparkSession, path: str, schema: StructType | str, files: int = 100) -> DataFrame:
    """New JSON lines as they arrive; a final line without a line feed counts as well."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").json(path)


def latest_by_key(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, kept in the state store (complete or update mode)."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")


def append_batches(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Add each batch once to a log: one that is repeated after a failure is there already."""

    def write(batch: DataFrame, number: int) -> None:
        append_jsonl(transform(batch) if transform else batch, path, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_lines(spark: SparkSession, path: str, out: str, checkpoint: str) -> int | None:
    """One step over files that others append to: whole lines that are new go to the log ``out`` (path, start, line), a last line without its line feed waits.  The step's number, None if nothing was new.

    A step first stores from which byte to which it reads each file, and then reads just that, so
    one that failed is read again with the same rows, and a line comes once.  Files are read
    from their beginning each time; a writer should begin a new one from time to time.
    """
    plans = batches_of(spark, checkpoint)
    if plans and plans[-1] not in batches_of(spark, out):
        _write_lines(spark, path, out, checkpoint, plans[-1])
    schema = "path string, start long, stop long, batch_seq long"
    if plans:
        known = spark.read.schema(schema).option("recursiveFileLookup", "true").json(checkpoint)
        known = known.groupBy(F.col("path").alias("_path")).agg(F.max("stop").alias("_stop"))
    else:
        known = spark.createDataFrame([], "_path string, _stop long")
    if not exists(spark, path):
        return None
    found = spark.read.format("binaryFile").load(path).join(known, F.col("path") == F.col("_path"), "left")
    begun = F.coalesce("_stop", F.lit(0).cast("long"))
    fresh = found.where(F.col("length") > begun).select("path", begun.alias("start"), _bytes(begun, F.col("length")).alias("_s"))
    whole = fresh.withColumn("_back", F.instr(F.reverse("_s"), "\n")).where("_back > 0").select("path", "start", (F.col("start") + F.length("_s") - F.col("_back") + 1).alias("stop"))
    plan = staged(whole, "line-plan")
    if plan.isEmpty():
        return None
    step = plans[-1] + 1 if plans else 1
    append_jsonl(plan, checkpoint, step)
    _write_lines(spark, path, out, checkpoint, step)
    return step


def _bytes(start: Column, stop: Column) -> Column:
    """A file's bytes from one place to another, a character for each."""
    return F.decode(F.substring("content", (start + 1).cast("int"), (stop - start).cast("int")), "ISO-8859-1")


def _write_lines(spark: SparkSession, path: str, out: str, checkpoint: str, step: int) -> None:
    plan = spark.read.schema("path string, start long, stop long").json(f"{checkpoint}/batch-{step:020d}").withColumnRenamed("path", "_path")
    held = spark.read.format("binaryFile").load(path).join(F.broadcast(plan) if plan.limit(100_001).count() <= 100_000 else plan, F.col("path") == F.col("_path"))
    lines = held.select("path", "start", F.posexplode(F.split(F.rtrim(_bytes(F.col("start"), F.col("stop")), F.lit("\n")), "\n")).alias("at", "_l"))
    text = F.regexp_replace(F.decode(F.encode("_l", "ISO-8859-1"), "UTF-8"), "\r$", "")
    append_jsonl(lines.select("path", "start", "at", text.alias("line")).where("line <> ''"), out, step)
