"""Quality classifier from weak labels.

Overlapping heuristic labellers each vote clean, poor or nothing on a document.  The vote
patterns of all documents are counted (the table has at most 3**len(LABELLERS) rows), and
expectation-maximisation estimates each labeller's accuracy and each pattern's posterior.
Posterior labels of a bounded sample train a linear scorer over hashed features, which
scores every document.  No gold label is read.

The scorer trains on at most ``MAX_TRAIN`` documents, those with the smallest hash of
their id; the labellers' accuracies rest on all documents.
"""

from __future__ import annotations

import itertools
import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.llm.common import documents, texts
from routelake.session import staged

MAX_TRAIN = 16_384
BUCKETS = 1 << 15
EM_ROUNDS = 200
THRESHOLD = 0.5
CACHE = 600_000
SYMBOLS = "#$%&*|<>{}[]\\^~=_@+"
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def measure(text: str, tokens: list[str], counts: Counter) -> dict[str, float]:
    """Shares that the labellers judge; ``counts`` are those of the text's words."""
    words, chars = len(tokens), max(len(text), 1)
    lines = [line for line in text.split("\n") if line.strip()]
    odd = loud = bare = 0
    for word, n in counts.items():
        last = word[-1]
        if last == "!":
            loud += n
        elif not last.isalnum() and last not in ".,;:?)\"'":
            odd += n
        if len(word) < 4 and not any(map(str.isalnum, word)):
            bare += n
    most = max(words, 1)
    return {
        "words": words,
        "symbols": sum(text.count(s) for s in SYMBOLS) / chars,
        "capitals": len(UPPER.findall(text)) / max(chars - words, 1),
        "stutter": sum(map(operator.eq, tokens, itertools.islice(tokens, 1, None))) / most,
        "top": max(counts.values(), default=0) / most,
        "lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "length": sum(len(w) * n for w, n in counts.items()) / most,
        "stops": sum(text.count(s) for s in (". ", ".\n", ", ", "; ")) / most,
        "odd": odd / most,
        "loud": loud / most,
        "bare": bare / most,
    }


def _prose(m: dict[str, float]) -> int:
    few = m["words"] < 20
    return 1 if m["words"] and m["symbols"] < 0.04 and (few or m["capitals"] < 0.25) and m["odd"] + m["loud"] + m["bare"] + m["stutter"] < 0.15 and (few or (m["top"] < 0.2 and m["stops"] > 0.03)) else -1


# Votes: 1 clean, 0 poor, -1 none.
LABELLERS = {
    "symbols": lambda m: 0 if m["symbols"] > 0.06 else -1,
    "odd": lambda m: 0 if m["odd"] > 0.2 else -1,
    "loud": lambda m: 0 if m["loud"] > 0.2 else -1,
    "bare": lambda m: 0 if m["bare"] > 0.15 else -1,
    "capitals": lambda m: 0 if m["words"] >= 3 and m["capitals"] > 0.4 else -1,
    "stutter": lambda m: 0 if m["stutter"] > 0.2 else -1,
    "top": lambda m: 0 if m["words"] >= 8 and m["top"] > 0.25 else -1,
    "lines": lambda m: 0 if m["lines"] > 0.5 else -1,
    "length": lambda m: 0 if m["words"] and not 2 < m["length"] < 14 else -1,
    "stops": lambda m: 0 if m["words"] >= 15 and m["stops"] < 0.02 else -1,
    "empty": lambda m: 0 if not m["words"] else -1,
    "prose": _prose,
}


def votes(text: str) -> str:
    """The labellers' votes as digits: 0 poor, 1 clean, 2 none."""
    tokens = text.split()
    m = measure(text, tokens, Counter(tokens))
    return "".join(str(vote(m) % 3) for vote in LABELLERS.values())


@dataclass
class LabelModel:
    """Share of clean documents, and each labeller's chances of each vote by class."""

    prior: float
    chances: np.ndarray  # labeller, class, vote

    def posterior(self, patterns: list[str]) -> np.ndarray:
        seen = np.array([[int(c) for c in p] for p in patterns]).reshape(-1, len(self.chances))
        logs = np.log([[1 - self.prior], [self.prior]]) + np.array([sum(np.log(self.chances[j, k, seen[:, j]]) for j in range(len(self.chances))) for k in (0, 1)])
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    def accuracy(self) -> np.ndarray:
        """Each labeller's chance to be right where it votes, at the estimated prior."""
        right = (1 - self.prior) * self.chances[:, 0, 0] + self.prior * self.chances[:, 1, 1]
        wrong = (1 - self.prior) * self.chances[:, 0, 1] + self.prior * self.chances[:, 1, 0]
        return right / (right + wrong)


def fit_labels(patterns: dict[str, int]) -> LabelModel:
    """Expectation-maximisation over counted vote patterns, labellers erring independently given the class.

    It starts from labellers that vote poor, and not clean, far more often on poor documents
    than on clean ones; the start also smooths the estimates, so that the classes keep their names.
    """
    names, weight = list(patterns), np.array(list(patterns.values()), dtype=float)
    n = len(LABELLERS)
    start = np.array([[0.4, 0.1, 0.5], [0.02, 0.5, 0.48]])
    model = LabelModel(0.8, np.repeat(start[None], n, axis=0))
    if not names:
        return model
    seen = np.array([[int(c) for c in p] for p in names])
    for _ in range(EM_ROUNDS):
        clean = model.posterior(names)
        chances = np.empty_like(model.chances)
        for k, share in enumerate((1 - clean, clean)):
            own = weight * share
            for j in range(n):
                chances[j, k] = (np.bincount(seen[:, j], weights=own, minlength=3)[:3] + start[k]) / (own.sum() + 1)
        prior = float(np.clip((weight * clean).sum() / weight.sum(), 0.01, 0.99))
        moved = max(abs(prior - model.prior), float(np.abs(chances - model.chances).max()))
        model = LabelModel(prior, chances)
        if moved < 1e-7:
            break
    return model


def shape(token: str) -> str:
    """The token's kinds of characters, runs cut to one: ``Theas,`` gives ``Aa,``."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token)
    return re.sub(r"(.)\1+", r"\1", kinds)


class Features:
    """Hashed features of texts: shapes of words (signed), and the measures in steps."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        tokens = text.split()
        counts = Counter(tokens)
        if len(self.known) > CACHE:
            self.known.clear()
        found: Counter[int] = Counter()
        for token, n in counts.items():
            if (at := self.known.get(token)) is None:
                at = self.known[token] = zlib.crc32(shape(token).encode("utf-8", "surrogatepass")) % BUCKETS
            found[at] += n
        words = max(len(tokens), 1)
        at, value = list(found), [(n / words) ** 0.5 for n in found.values()]
        for name, x in measure(text, tokens, counts).items():
            step = int(np.log2(x + 1)) if name in ("words", "length") else int(x * 20)
            at.append(zlib.crc32(f"{name}={step}".encode()) % BUCKETS)
            value.append(0.5)
        return np.array(at, dtype=np.int32), np.array(value, dtype=np.float32)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 30) -> np.ndarray:
    """Weights of the buckets and, last, the constant, by AdaGrad on soft labels in a fixed order."""
    weights, squares = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-6)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for lo in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 64)):
            gradient = np.zeros(BUCKETS + 1)
            for i in lo:
                at, value, y = rows[i]
                error = _sigmoid(weights[at] @ value + weights[-1]) - y
                np.add.at(gradient, at, error * value)
                gradient[-1] += error
            gradient = gradient / max(len(lo), 1) + 1e-5 * weights
            squares += gradient**2
            weights -= 0.3 * gradient / np.sqrt(squares)
    return weights.astype(np.float32)


def vote_patterns(docs: DataFrame) -> dict[str, int]:
    """How many of all documents have each vote pattern."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for batch in batches:
            counts.update(map(votes, texts(batch["text"])))
        yield pd.DataFrame(list(counts.items()), columns=["pattern", "n"])

    found = docs.select("text").mapInPandas(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return {r["pattern"]: r["n"] for r in sorted(found.collect())}


def learn(docs: DataFrame) -> tuple[LabelModel, np.ndarray]:
    """The label model over all documents, and the scorer from the sample's posteriors.

    Of rows that repeat an id the smallest text trains; rows without an id do not.  An empty
    table gives the model and the scorer that the fits start from.
    """
    model = fit_labels(vote_patterns(docs))
    chosen = docs.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(MAX_TRAIN)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for batch in batches:
            out = [(votes(text), *features.of(text)) for text in texts(batch["text"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "pattern": [o[0] for o in out], "at": [o[1] for o in out], "value": [o[2] for o in out]})

    # At most MAX_TRAIN ids are broadcast, and as many rows collected; a row has at most as many features as its text has word shapes.
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    sample = staged(own.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "quality-sample")
    rows = sorted(sample.mapInPandas(run, "doc_id long, pattern string, at array<int>, value array<float>").collect(), key=lambda r: r["doc_id"])
    clean = model.posterior([r["pattern"] for r in rows]) if rows else []
    return model, fit_scorer([(np.array(r["at"]), np.array(r["value"], dtype=np.float32), float(p)) for r, p in zip(rows, clean, strict=True)])


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score (chance of being clean), kept for each row, repeated ones too; a null text is empty, and empty texts score as learned for them."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, w = Features(), shared.value
        for batch in batches:
            out = []
            for text in texts(batch["text"]):
                at, value = features.of(text)
                out.append(float(_sigmoid(w[at] @ value + w[-1])))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": out, "kept": [x >= THRESHOLD for x in out]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double, kept boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the quality score of every row of documents."""
    docs = documents(spark, sf_dir)
    _, weights = learn(docs)
    return score(docs, weights)
