"""External models behind two small interfaces: embedders and labellers, called in batches with retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Embedder = Callable[[list[str]], list[list[float]]]
Labeller = Callable[[list[str], str], list[str]]


def with_bisection(call: Callable[[list[str]], list], items: list[str], attempts: int = 3, pause: float = 1.0) -> list:
    """``call`` on all items; after so many failures on each half, down to one item, whose failure raises."""
    for attempt in range(attempts):
        try:
            return call(items)
        except Exception:
            if attempt + 1 == attempts and len(items) == 1:
                raise
            time.sleep(pause * 2**attempt if attempt + 1 < attempts else 0)
    middle = len(items) // 2
    return with_bisection(call, items[:middle], attempts, pause) + with_bisection(call, items[middle:], attempts, pause)


def embed(df: DataFrame, id_col: str, text_col: str, embedder: Embedder, batch: int = 64, pause: float = 1.0) -> DataFrame:
    """id, embedding of unit length for each row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            texts, out = part[text_col].fillna("").tolist(), []
            for lo in range(0, len(texts), batch):
                out += with_bisection(embedder, texts[lo : lo + batch], pause=pause)
            m = np.asarray(out, dtype=np.float32).reshape(len(texts), -1)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            yield pd.DataFrame({id_col: part[id_col], "embedding": list(m / np.where(norm == 0, 1, norm))})

    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, embedding array<float>")


#: Prompts, and characters, that a labeller gets in one call at most.
LABEL_ROWS, LABEL_CHARS = 24, 20_000


def label_twice(df: DataFrame, id_col: str, text_col: str, labeller: Labeller, order: str | None = None, attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """id, answer_a, answer_b, error of two passes over batches in ``order`` (the id), which run side by side.

    A call that fails is tried again; if it fails for good, the answers of both passes are null
    for its batch and for no other, so that these rows are labelled another time.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.sql import functions as F

    from routelake.operators.relational import greedy_batches

    kind = df.schema[id_col].dataType.simpleString()
    key = order or id_col
    sized = df.withColumn("_chars", F.length(F.coalesce(F.col(text_col), F.lit(""))))
    batches = greedy_batches(sized, key, "_chars", LABEL_ROWS, LABEL_CHARS).select(id_col, text_col, F.col(key).alias("_order"), F.col("batch").alias("_batch"))

    def tried(texts: list[str], which: str) -> list[str]:
        for attempt in range(attempts):
            try:
                answers = labeller(texts, which)
                if len(answers) != len(texts):
                    raise ValueError(f"{len(answers)} answers for {len(texts)} prompts")
                return answers
            except Exception:
                if attempt + 1 == attempts:
                    raise
                time.sleep(pause * 2**attempt)
        return []

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_order")
        texts = part[text_col].fillna("").tolist()
        with ThreadPoolExecutor(2) as pool:
            calls = [pool.submit(tried, texts, which) for which in "ab"]
        errors = [str(c.exception()) for c in calls if c.exception()]
        a, b = ([None] * len(texts),) * 2 if errors else (c.result() for c in calls)
        return pd.DataFrame({id_col: part[id_col], "answer_a": a, "answer_b": b, "error": errors[0] if errors else None})

    return batches.groupBy("_batch").applyInPandas(run, f"{id_col} {kind}, answer_a string, answer_b string, error string")
