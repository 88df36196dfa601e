"""Language identification by words first, backing off to shorter character n-grams.

A known word scores with its log frequency in each language.  An unseen word scores with
the mean log frequency of its longest character n-grams of which half or more are known,
from ``NGRAMS[0]`` characters down to one.  The language with the largest sum wins.

The fit uses a bounded sample: at most ``MAX_PER_LANG`` rows of each language outside the
held-out fold, those with the smallest hash of their id.  Tables keep the most frequent
entries of each kind and language, as ``KEEP`` says.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routelake.llm.common import documents, held_out, texts
from routelake.session import staged

MAX_PER_LANG = 2048
NGRAMS = (5, 4, 3, 2, 1)
#: Entries kept for each language: words (kind 0), then n-grams by their length.
KEEP = {0: 20_000, 1: 500, 2: 3_000, 3: 8_000, 4: 8_000, 5: 8_000}
SMOOTHING = 0.1
UNDETERMINED = "und"
CACHE = 600_000


def word_of(token: str) -> str:
    """The token's letters (and marks between them) in lower case; empty if it has no letter."""
    return "".join(c for c in token.lower() if c.isalpha())


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


@dataclass
class Model:
    """Languages in order, and for each kind the entries' log frequencies by language."""

    langs: list[str]
    tables: dict[int, dict[str, np.ndarray]] = field(default_factory=dict)

    def of_word(self, word: str) -> np.ndarray:
        if (known := self.tables[0].get(word)) is not None:
            return known
        for n in NGRAMS:
            own = grams(word, n)
            found = [v for g in own if (v := self.tables[n].get(g)) is not None]
            if found and 2 * len(found) >= len(own):
                return np.mean(found, axis=0)
        return np.zeros(len(self.langs))


class Scorer:
    """Sums the scores of a text's words; keeps the scores of tokens met, up to CACHE of them."""

    def __init__(self, model: Model):
        self.model, self.index, self.rows = model, {}, []
        self._reset()

    def _reset(self) -> None:
        self.index = {"": 0}
        self.matrix = np.zeros((1 << 14, len(self.model.langs) + 1))
        self.used = 1

    def _add(self, token: str) -> int:
        if self.used == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        word = word_of(token)
        if word:
            self.matrix[self.used, :-1] = self.model.of_word(word)
            self.matrix[self.used, -1] = 1
        self.index[token] = at = self.used
        self.used += 1
        return at

    def predict(self, text: str) -> tuple[str, float]:
        if self.used > CACHE:
            self._reset()
        get = self.index.get
        counts = Counter(text.split())
        at = [i if (i := get(token)) is not None else self._add(token) for token in counts]
        sums = np.fromiter(counts.values(), dtype=float, count=len(counts)) @ self.matrix[at] if at else self.matrix[0]
        if not sums[-1] or not self.model.langs:
            return UNDETERMINED, 0.0
        logs = sums[:-1] / math.sqrt(sums[-1])
        best = int(np.argmax(logs))
        return self.model.langs[best], float(1 / np.exp(logs - logs[best]).sum())


def training_sample(docs: DataFrame) -> DataFrame:
    """text, lang of the bounded training sample; of rows that repeat an id and a language the smallest text serves.

    A language's rows are first thinned, by the hash that orders them, to about twice as many
    as are wanted, so that no task sorts more of them than that.
    """
    known = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    place = (F.xxhash64("doc_id").cast("double") / 2.0**64) + 0.5
    counts = known.groupBy(F.col("lang").alias("_lang")).agg(F.approx_count_distinct("doc_id", 0.02).alias("_all"))
    thinned = known.join(F.broadcast(counts), F.col("lang") == F.col("_lang")).where(place * F.col("_all") < 2.0 * MAX_PER_LANG).select("lang", F.col("doc_id").alias("_id")).distinct()
    first = Window.partitionBy("lang").orderBy(F.xxhash64("_id"), "_id")
    sample = thinned.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= MAX_PER_LANG).select("_id", F.col("lang").alias("_lang"))
    # At most MAX_PER_LANG rows of an id and a language for each language are broadcast.
    own = docs.select("doc_id", "text", "lang").join(F.broadcast(sample), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    return own.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("text", "lang")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words: dict[str, Counter] = {}
    for batch in batches:
        for text, lang in zip(texts(batch["text"]), batch["lang"], strict=True):
            words.setdefault(lang, Counter()).update(text.split())
    for lang, tokens in words.items():
        counts: Counter = Counter()
        for token, n in tokens.items():
            if word := word_of(token):
                counts[(0, word)] += n
                for size in NGRAMS:
                    for gram in grams(word, size):
                        counts[(size, gram)] += n
        items = list(counts.items())
        for lo in range(0, len(items), 100_000):
            yield pd.DataFrame([(lang, kind, entry, n) for (kind, entry), n in items[lo : lo + 100_000]], columns=["lang", "kind", "entry", "n"])


def learn(docs: DataFrame, keep: dict[int, int] | None = KEEP) -> Model:
    """Fit the tables.  Without a labelled row (an empty table too) the model knows no language.

    ``keep`` bounds the entries of each kind and language; with None all of the sample's are kept.
    """
    sample = staged(training_sample(docs), "language-sample")
    counts = staged(sample.mapInPandas(_count, "lang string, kind int, entry string, n long").groupBy("lang", "kind", "entry").agg(F.sum("n").alias("n")), "language-counts")
    totals = {(r["lang"], r["kind"]): (r["n"], r["entries"]) for r in counts.groupBy("lang", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("entries")).collect()}
    langs = sorted({lang for lang, _ in totals})
    model, kept = Model(langs, {kind: {} for kind in KEEP}), counts
    if keep is not None:
        most = F.create_map(*[F.lit(x) for pair in keep.items() for x in pair])[F.col("kind")]
        rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "entry"))
        kept = counts.withColumn("_r", rank).where(F.col("_r") <= most)
    for r in kept.select("lang", "kind", "entry", "n").toLocalIterator():
        model.tables[r["kind"]].setdefault(r["entry"], {})[r["lang"]] = r["n"]
    for kind, entries in model.tables.items():
        floor = [math.log(SMOOTHING / (totals[(lang, kind)][0] + SMOOTHING * totals[(lang, kind)][1])) for lang in langs]
        sizes = [math.log(totals[(lang, kind)][0] + SMOOTHING * totals[(lang, kind)][1]) for lang in langs]
        for entry, own in entries.items():
            entries[entry] = np.array([math.log(own[lang] + SMOOTHING) - size if lang in own else low for lang, low, size in zip(langs, floor, sizes, strict=True)])
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row, repeated ones too; a null or letterless text gives ``und`` and 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = pd.DataFrame([scorer.predict(text) for text in texts(batch["text"])], columns=["lang_pred", "score"])
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), found], axis=1)

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the language of every row of documents."""
    docs = documents(spark, sf_dir)
    return identify(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
