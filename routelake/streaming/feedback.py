"""Feedback clicks folded as they arrive: a message's rating and expected model are the state of its key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructField, StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def clicked(rating: str | None, expected: str | None, click: Row) -> tuple[str | None, str | None]:
    """What a click (kind, selected, choice) makes of a rating and the expected model: see ``history.fold_feedback``."""
    if click["kind"] == "correct":
        return (rating, click["choice"]) if rating == "negative" else (rating, expected)
    if rating is not None and rating == click["kind"]:
        return None, None
    return click["kind"], click["selected"] if click["kind"] == "positive" else None


class Fold(StatefulProcessor):
    """Keeps a key's rating and expected model; a batch's clicks are folded in their order."""

    def __init__(self, key: str, order: str) -> None:
        self.key, self.order = key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("feedback", "rating string, expected string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        rating, expected = self.state.get() if self.state.exists() else (None, None)
        for click in sorted(rows, key=lambda r: r[self.order]):
            rating, expected = clicked(rating, expected, click)
        self.state.update((rating, expected))
        yield Row(**{self.key: key[0], "rating": rating, "expected": expected})

    def close(self) -> None:
        pass


def fold_stream(clicks: DataFrame, key: str, order: str) -> DataFrame:
    """key, rating, expected of each key that a batch has clicks of; clicks of later batches follow those of earlier ones."""
    schema = StructType([StructField(key, clicks.schema[key].dataType)]).add("rating", "string").add("expected", "string")
    return clicks.groupBy(key).transformWithState(Fold(key, order), schema, "Update", "None")


def start(clicks: DataFrame, key: str, order: str, path: str, checkpoint: str) -> StreamingQuery:
    """Folds what is new into the log ``path``, a batch once, and ends; the state is in ``checkpoint``, from which a later call goes on."""
    from routelake.sources.files import append_jsonl

    spark = clicks.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        folded = fold_stream(clicks, key, order).writeStream.outputMode("update").foreachBatch(lambda batch, number: append_jsonl(batch, path, number))
        return folded.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
