"""Toxicity: a learned weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, strips accents and zero-width characters, and maps look-alike letters
and digit substitutions to Latin letters.  The lexicon holds whole words and word stems
whose share of toxic training documents stands out; each has its log odds as weight.
Matches inside exception phrases (two-word phrases that only clean documents use) do not
count.  A document's summed weight, plain and normalised by its length, gives its score
through a logistic fit.

The fit uses a bounded sample of labelled rows: at most ``MAX_TOXIC`` and ``MAX_CLEAN``
rows outside the held-out fold, those with the smallest hash of their id.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.llm.common import documents, held_out, lean, table, texts
from routelake.session import staged

MAX_TOXIC = 8192
MAX_CLEAN = 16384
#: Terms that are looked at for evidence, the most telling ones (four times as many give the same lexicon), stem lengths, and how much evidence (in nats) a term needs.
MAX_TERMS = 4096
STEMS = range(3, 10)
EVIDENCE = 9.0
#: Least log ratio of the rates of a stem and of a word, and distinct clean documents that make a phrase an exception.
MIN_STEM, MIN_WORD, MIN_PHRASE = 4.0, 2.0, 3
THRESHOLD = 0.5

# Letters of other scripts that look like Latin ones, then digit and sign substitutions.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t",
    "@": "a", "$": "s",
}


class Folding(dict):
    """Translation table, filled as characters are met: letters folded, the rest a space."""

    def __missing__(self, code: int) -> str:
        out = ""
        for char in unicodedata.normalize("NFKD", chr(code).casefold()):
            char = LOOK_ALIKES.get(char, char)
            kind = unicodedata.category(char)
            if kind not in ("Mn", "Me", "Cf"):
                out += char if kind[0] in "LN" else " "
        if len(self) < 100_000:
            self[code] = out
        return out


FOLD = Folding()


def fold(text: str) -> str:
    """Folded words, each led by one space, with a space at the end."""
    return f" {' '.join(text.translate(FOLD).split())} "


def terms_of(folded: str) -> dict[str, int]:
    """The words (' word ') and proper stems (' stem') of a folded text, with their counts."""
    found: Counter[str] = Counter()
    for word, n in Counter(folded.split()).items():
        found[f" {word} "] += n
        for size in STEMS:
            if size >= len(word):
                break
            found[f" {word[:size]}"] += n
    return dict(found)


@dataclass
class Lexicon:
    """Terms with weights, exception phrases, and the logistic's coefficients."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[tuple[str, str]] = field(default_factory=set)
    fit: tuple[float, ...] = (-6.0, 2.0, 0.0, 0.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def hits(self, folded: str) -> list[tuple[float, str, str, str]]:
        """For each word that a term matches: the largest weight, the word before, the word, the word after."""
        if not self.weights:
            return []
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                self._automaton.add_word(term, (len(term), weight))
            self._automaton.make_automaton()
        best: dict[int, float] = {}
        for end, (length, weight) in self._automaton.iter(folded):
            start = end - length + 1
            best[start] = max(weight, best.get(start, 0.0))
        found = []
        for start, weight in sorted(best.items()):
            end = folded.index(" ", start + 1)
            before = folded[folded.rfind(" ", 0, start) + 1 : start] if start else ""
            after = folded[end + 1 : folded.find(" ", end + 1)] if end + 1 < len(folded) else ""
            found.append((weight, before, folded[start + 1 : end], after))
        return found

    def counted(self, hits) -> float:
        return sum(w for w, before, word, after in hits if (before, word) not in self.exceptions and (word, after) not in self.exceptions)

    def score(self, total: float, words: int) -> float:
        z = sum(a * b for a, b in zip(self.fit, measures(total, words), strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def measures(total: float, words: int) -> tuple[float, ...]:
    """The logistic's inputs: 1, the summed weight, and the same normalised by length and its root."""
    words = max(words, 1)
    return 1.0, math.log1p(total), math.log1p(100 * total / words), math.log1p(10 * total / math.sqrt(words))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of the bounded training sample; of rows that repeat an id the smallest text serves."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("label = 1").orderBy(*order).limit(MAX_TOXIC).unionByName(known.where("label = 0").orderBy(*order).limit(MAX_CLEAN))
    # At most MAX_TOXIC + MAX_CLEAN rows of two numbers are broadcast.
    own = docs.select("doc_id", "text").join(F.broadcast(sample.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"))
    return own.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("toxic")).select("text", "toxic")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, list[int]] = {}

    def flush():
        out = pd.DataFrame([(k, v[1], v[0]) for k, v in counts.items()], columns=["term", "toxic", "clean"])
        counts.clear()
        return out

    for batch in batches:
        for text, label in zip(texts(batch["text"]), batch["toxic"], strict=True):
            for term, n in terms_of(fold(text)).items():
                counts.setdefault(term, [0, 0])[int(label)] += n
            if len(counts) > 100_000:
                yield flush()
    yield flush()


def _signature(folded: str) -> tuple[int, int]:
    """Two minimum hashes over five-word shingles, by which near copies in the sample are known."""
    words = folded.split()
    shingles = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    import xxhash

    values = np.array([xxhash.xxh3_64_intdigest(s) for s in shingles], dtype=np.uint64)
    return int(values.min() >> np.uint64(1)), int((values * np.uint64(0x9E3779B97F4A7C15)).min() >> np.uint64(1))


def _incidence(candidates: list[str]):
    index = {term: i for i, term in enumerate(candidates)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, label in zip(texts(batch["text"]), batch["toxic"], strict=True):
                folded = fold(text)
                out.append((int(label), *_signature(folded), folded.count(" ") - 1, [index[t] for t, n in terms_of(folded).items() if t in index for _ in range(n)]))
            yield pd.DataFrame(out, columns=["toxic", "first", "second", "words", "terms"])

    return run


def _contexts(lexicon: Lexicon):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, label in zip(texts(batch["text"]), batch["toxic"], strict=True):
                folded = fold(text)
                out.append((int(label), *_signature(folded), folded.count(" ") - 1, [f"{n} {w!r} {a}\t{b}\t{c}" for (w, a, b, c), n in Counter(lexicon.hits(folded)).items()]))
            yield pd.DataFrame(out, columns=["toxic", "first", "second", "words", "hits"])

    return run


def evidence(toxic: int, clean: int, prior: float) -> float:
    """Nats by which the share of a term's uses in toxic documents exceeds the prior."""
    n, share = toxic + clean, toxic / max(toxic + clean, 1)
    if share <= prior:
        return 0.0
    return n * (share * math.log(share / prior) + ((1 - share) * math.log((1 - share) / (1 - prior)) if share < 1 else 0))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge-penalised logistic fit by Newton's steps, each halved until it does not make the loss larger."""
    penalty = np.full(x.shape[1], 0.1)
    penalty[0] = 1e-6

    def loss(b):
        z = x @ b
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * penalty @ (b * b))

    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
        while loss(beta + step) > loss(beta) and np.abs(step).max() > 1e-9:
            step = step / 2
        beta = beta + step
        if np.abs(step).max() < 1e-7:
            break
    return tuple(float(b) for b in beta)


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Fit the lexicon, its exceptions and the logistic.  Without both classes the lexicon is empty."""
    sample = staged(labelled_sample(docs, labels), "toxicity-sample")
    words = F.size(F.split(F.coalesce(F.col("text"), F.lit("")), r"\s+"))
    sizes = {r["toxic"]: r["words"] for r in sample.groupBy("toxic").agg(F.sum(words).alias("words")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon()
    counts = sample.mapInPandas(lean(_count), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    found = counts.where("toxic >= 3").withColumn("odds", odds).where(F.col("odds") > MIN_WORD - 0.5).orderBy(F.desc(F.col("odds") * F.log(F.col("toxic"))), "term").limit(MAX_TERMS).collect()
    candidates = [r["term"] for r in found]
    # Bounded: one row for each row of the sample, of candidate numbers.  Near copies count once.
    seen: set[int] = set()
    in_toxic, in_clean, n_toxic, n_clean = Counter(), Counter(), 0, 0
    rows = sample.mapInPandas(lean(_incidence(candidates)), "toxic int, first long, second long, words int, terms array<int>").collect()
    for r in sorted(rows, key=lambda r: (r["first"], r["second"], r["toxic"])):
        if r["first"] in seen or r["second"] in seen:
            continue
        seen.update((r["first"], r["second"]))
        (in_toxic if r["toxic"] else in_clean).update(r["terms"])
        n_toxic, n_clean = n_toxic + r["toxic"] * r["words"], n_clean + (1 - r["toxic"]) * r["words"]
    weights: dict[str, float] = {}
    if n_toxic and n_clean:
        prior = n_toxic / (n_toxic + n_clean)
        for i in sorted(range(len(candidates)), key=lambda i: (len(candidates[i]), candidates[i])):
            t, c = in_toxic[i], in_clean[i]
            weight = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
            term = candidates[i]
            if weight > (MIN_WORD if term.endswith(" ") else MIN_STEM) and evidence(t, c, prior) > EVIDENCE:
                covering = max((weights.get(term.rstrip()[:n], 0.0) for n in range(4, len(term.rstrip()) + 1)), default=0.0)
                if covering < weight:
                    weights[term] = weight
    lexicon = Lexicon(weights)
    found = sample.mapInPandas(lean(_contexts(lexicon)), "toxic int, first long, second long, words int, hits array<string>").collect()
    # Near copies count once; phrases are learned from one half of the rest, the logistic from the other.
    seen, rows = set(), []
    for r in sorted(found, key=lambda r: (r["first"], r["second"], r["toxic"])):
        if r["first"] not in seen and r["second"] not in seen:
            rows.append(r)
        seen.update((r["first"], r["second"]))
    # Each document's distinct matches, with how often it has them.
    hits = [[(int(n), (float(w), *context.split("\t"))) for n, w, context in (h.split(" ", 2) for h in r["hits"])] for r in rows]
    used = [Counter(), Counter()]
    for r, own in zip(rows[::2], hits[::2], strict=True):
        used[r["toxic"]].update({p for _, (_, a, b, c) in own for p in ((a, b), (b, c)) if all(p)})
    lexicon.exceptions = {p for p, n in used[0].items() if n >= MIN_PHRASE and not used[1][p]}
    rows, hits = rows[1::2] or rows, hits[1::2] or hits
    totals = [sum(n * lexicon.counted([hit]) for n, hit in own) for own in hits]
    x = np.array([measures(t, r["words"]) for t, r in zip(totals, rows, strict=True)])
    lexicon.fit = _logistic(x, np.array([r["toxic"] for r in rows], dtype=float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, predicted, hits, words for each row, repeated ones too; null and empty texts score as no match, empty tables give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in texts(batch["text"]):
                folded = fold(text)
                hits, words = lexicon.hits(folded), max(folded.count(" ") - 1, 0) if folded.strip() else 0
                value = lexicon.score(lexicon.counted(hits), words)
                out.append((value, int(value >= THRESHOLD), len(hits), words))
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["score", "predicted", "hits", "words"])], axis=1)

    return docs.select("doc_id", "text").mapInPandas(lean(run), "doc_id long, score double, predicted int, hits int, words int")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score as toxic; its columns as they were, null and empty texts kept."""
    lexicon = learn(docs, labels)

    @F.pandas_udf("boolean")
    def clean(column: pd.Series) -> pd.Series:
        out = []
        for text in texts(column):
            folded = fold(text)
            out.append(lexicon.score(lexicon.counted(lexicon.hits(folded)), folded.count(" ") - 1) < THRESHOLD)
        return pd.Series(out, dtype=bool)

    return docs.where(clean(F.col("text")))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the score of every row of documents."""
    docs = documents(spark, sf_dir)
    lexicon = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, lexicon).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "hits", "words")
