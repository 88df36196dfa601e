"""Learned scorers over router tokens, with weights that tables supply."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routelake.functions import lexicon as lx
from routelake.functions.rules import contains_any
from routelake.functions.text import bound
from routelake.operators.relational import small


def router_tokens(text: Column, char_ngrams: tuple[int, int] | None = None) -> Column:
    """Words without stop words, their bigrams, character n-grams if asked for, and feature tokens, with repeats."""

    def tokens(every: Column) -> Column:
        words = F.filter(every, lambda w: (F.length(w) > 1) & ~w.isin(lx.STOP_WORDS))
        own = bound(F.struct(F.array_join(every, " ").alias("flat"), words.alias("words")), lambda x: _tokens(x["flat"], x["words"], char_ngrams))
        return F.when(F.size(every) == 0, F.array().cast("array<string>")).otherwise(own)

    return bound(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9+#.]+"), F.lit(0)), tokens)


def _tokens(flat: Column, words: Column, char_ngrams: tuple[int, int] | None) -> Column:
    n = F.size(words)
    pairs = F.when(n > 1, F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(F.array().cast("array<string>"))
    parts = [words, pairs]
    if char_ngrams:
        for size in range(char_ngrams[0], char_ngrams[1] + 1):
            parts.append(F.flatten(F.transform(F.filter(words, _reaches(size)), _grams(size))))  # none crosses a space

    def feature(name: str, condition: Column, times: int = 2) -> Column:
        return F.when(condition, F.array_repeat(F.lit(f"feature:{name}"), times)).otherwise(F.array().cast("array<string>"))

    parts += [feature("privacy", contains_any(flat, lx.PRIVACY_TERMS)), feature("coding", contains_any(flat, lx.CODING_TERMS))]
    parts.append(feature("complex", contains_any(flat, lx.COMPLEX_TERMS) | (n > 80)))
    parts += [feature(name, contains_any(flat, terms)) for name, terms in lx.TASK_LEXICONS.items()]
    parts += [feature("short_prompt", n < 12, 1), feature("long_prompt", n > 80, 1)]
    return F.concat(*parts)


def _reaches(size: int):
    return lambda word: F.length(word) >= size


def _grams(size: int):
    return lambda word: F.transform(F.sequence(F.lit(1), F.length(word) - size + 1), lambda start: F.concat(F.lit("char:"), F.substr(word, start, F.lit(size))))


def counted(tokens: Column) -> Column:
    """Distinct tokens of an array with their counts, as structs (token, n): runs of the sorted array."""

    def runs(a: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: (i == 1) | (F.element_at(a, i) != F.element_at(a, F.greatest(i - 1, F.lit(1)))))
        ends = lambda s: F.concat(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.size(a) + 1))
        return bound(starts, lambda s: F.zip_with(s, ends(s), lambda i, j: F.struct(F.element_at(a, i).alias("token"), (j - i).cast("long").alias("n"))))

    return F.when(F.size(tokens) > 0, bound(F.array_sort(tokens), runs)).otherwise(F.array().cast("array<struct<token:string,n:bigint>>"))


def token_counts(prompts: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """id, token, n: one row for each distinct token of a prompt.  Counted within the row, so nothing is shuffled."""
    return prompts.select(id_col, F.explode(counted(F.col(tokens))).alias("_c")).select(id_col, "_c.token", "_c.n")


#: Labels that a classifier has at most; they are held on the driver.
MOST_LABELS = 1000


def tfidf(counts: DataFrame, id_col: str, idf: DataFrame) -> DataFrame:
    """id, token, weight: (1 + ln n) * idf of known tokens, each prompt's weights of unit length."""
    known = counts.join(small(idf), "token").withColumn("_w", (1 + F.log(F.col("n"))) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))  # a prompt's tokens are few
    return known.withColumn("_norm", norm).where("_norm > 0").select(id_col, "token", (F.col("_w") / F.col("_norm")).alias("weight"))


def softmax(scores: DataFrame, id_col: str, score: str = "score", temperature: Column | float = 1.0, out: str = "probability") -> DataFrame:
    """Shares of each prompt's labels by exp((score - best) / temperature).  A prompt has as many rows as there are labels."""
    own = Window.partitionBy(id_col)
    e = F.exp((F.col(score) - F.max(score).over(own)) / temperature)
    return scores.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(own)).drop("_e")


def labels_of(labels: DataFrame) -> list[dict]:
    """The rows of a classifier's table of labels, by label."""
    found = labels.limit(MOST_LABELS + 1).collect()
    if len(found) > MOST_LABELS:
        raise ValueError(f"a classifier with over {MOST_LABELS} labels")
    return sorted((r.asDict() for r in found), key=lambda r: r["label"])


def _sums(rows: DataFrame, id_col: str, values: DataFrame, value: str, names: list[str], term, *others: Column) -> DataFrame:
    """id, others, _0, _1, ...: for each label the sum of ``term`` of the values that ``values`` (label, token) gives the tokens.

    A token's values come as one map, so a row meets the table once, and a prompt's rows are
    added up before they are shuffled.  A prompt without tokens has a row with a null token.
    """
    by_token = values.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("label", value))).alias("_v"))
    met = rows.join(small(by_token), "token", "left")
    return met.groupBy(id_col).agg(*others, *[F.sum(term(F.try_element_at("_v", F.lit(name)), name)).alias(f"_{i}") for i, name in enumerate(names)])


def _unfolded(sums: DataFrame, id_col: str, names: list[str], score) -> DataFrame:
    """id, label, score: a row for each label."""
    each = F.array(*[F.struct(F.lit(name).alias("label"), score(i, F.coalesce(F.col(f"_{i}"), F.lit(0.0))).cast("double").alias("score")) for i, name in enumerate(names)])
    return sums.select(id_col, F.explode(each).alias("_l")).select(id_col, "_l.label", "_l.score")


def _every_prompt(prompts: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """``rows``, and a row of nulls for each prompt."""
    return rows.unionByName(prompts.select(id_col), allowMissingColumns=True)


def linear_scores(prompts: DataFrame, vectors: DataFrame, id_col: str, labels: DataFrame, weights: DataFrame) -> DataFrame:
    """id, label, score: intercept plus the weighted sum; ``labels`` has label, intercept, ``weights`` label, token, coefficient."""
    own = labels_of(labels)
    names = [r["label"] for r in own]
    sums = _sums(_every_prompt(prompts, vectors, id_col), id_col, weights, "coefficient", names, lambda v, _: F.col("weight") * v)
    return _unfolded(sums, id_col, names, lambda i, s: F.lit(own[i]["intercept"]) + s)


def naive_bayes_scores(prompts: DataFrame, counts: DataFrame, id_col: str, labels: DataFrame, likelihoods: DataFrame) -> DataFrame:
    """id, label, score: log prior plus log likelihoods of all tokens with repeats; ``labels`` has label, log_prior, unknown."""
    own = labels_of(labels)
    names, unknown = [r["label"] for r in own], {r["label"]: F.lit(r["unknown"]) for r in own}
    sums = _sums(_every_prompt(prompts, counts, id_col), id_col, likelihoods, "log_likelihood", names, lambda v, name: F.col("n") * F.coalesce(v, unknown[name]))
    return _unfolded(sums, id_col, names, lambda i, s: F.lit(own[i]["log_prior"]) + s)


def centroid_scores(prompts: DataFrame, vectors: DataFrame, id_col: str, labels: DataFrame, centroids: DataFrame) -> DataFrame:
    """id, label, score: inner product with each label's centroid; ``centroids`` has label, token, value."""
    names = [r["label"] for r in labels_of(labels)]
    sums = _sums(_every_prompt(prompts, vectors, id_col), id_col, centroids, "value", names, lambda v, _: F.col("weight") * v)
    return _unfolded(sums, id_col, names, lambda i, s: s)


def hybrid(naive_bayes: DataFrame | None, centroid: DataFrame, id_col: str, nb_weight: float = 0.15, centroid_weight: float = 1.0) -> DataFrame:
    """id, label, confidence: weighted shares of both scorers, not normalised again, so up to the weights' sum."""
    parts = [softmax(centroid, id_col, temperature=0.18).select(id_col, "label", (F.col("probability") * centroid_weight).alias("confidence"))]
    if naive_bayes is not None:
        parts.append(softmax(naive_bayes, id_col).select(id_col, "label", (F.col("probability") * nb_weight).alias("confidence")))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy(id_col, "label").agg(F.sum("confidence").alias("confidence"))


def best_label(scores: DataFrame, id_col: str, value: str) -> DataFrame:
    """id, label, value, margin to the next, alternatives: each prompt's best label, ties by name."""
    ranked = scores.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct((-F.col(value)).alias("_minus"), "label"))).alias("_r"))
    return ranked.select(id_col, F.col("_r")[0]["label"].alias("label"), (-F.col("_r")[0]["_minus"]).alias(value), (F.try_element_at("_r", F.lit(2))["_minus"] - F.col("_r")[0]["_minus"]).alias("margin"), F.transform(F.slice("_r", 2, 2), lambda x: x["label"]).alias("alternatives"))


def predict_linear(prompts: DataFrame, counts: DataFrame, id_col: str, idf: DataFrame, labels: DataFrame, weights: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Label, confidence, margin, alternatives, normalised entropy and token coverage of the linear scorer.

    One pass: a prompt's raw weights, their length, the labels' sums and the coverage are one
    aggregation, and what follows happens within a row.
    """
    own = labels_of(labels)
    names = [r["label"] for r in own]
    rows = _every_prompt(prompts, counts, id_col).join(small(idf), "token", "left").withColumn("weight", (1 + F.log(F.col("n"))) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm")
    sums = _sums(rows, id_col, weights, "coefficient", names, lambda v, _: F.col("weight") * v, norm, F.count("idf").alias("_known"), F.count("token").alias("_all"))
    scores = F.array(*[F.lit(float(r["intercept"])) + F.coalesce(F.when(F.col("_norm") > 0, F.col(f"_{i}") / F.col("_norm")), F.lit(0.0)) for i, r in enumerate(own)])
    shares = sums.withColumn("_scores", scores).withColumn("_e", F.transform("_scores", lambda x: F.exp((x - F.array_max("_scores")) / temperature)))
    total = F.aggregate("_e", F.lit(0.0), lambda s, x: s + x)
    shares = shares.withColumn("_p", F.transform("_e", lambda x: x / total))
    ranked = F.array_sort(F.zip_with("_p", F.array(*[F.lit(n) for n in names]), lambda p, n: F.struct((-p).alias("minus"), n.alias("label"))))
    entropy = F.aggregate("_p", F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log(p)).otherwise(0.0)) / F.log(F.lit(float(len(names))))
    best = shares.withColumn("_r", ranked)
    first, second = F.col("_r")[0], F.try_element_at("_r", F.lit(2))
    return best.select(
        id_col,
        first["label"].alias("label"),
        (-first["minus"]).alias("confidence"),
        (second["minus"] - first["minus"]).alias("margin"),
        F.transform(F.slice("_r", 2, 2), lambda x: x["label"]).alias("alternatives"),
        entropy.alias("normalized_entropy"),
        F.when(F.col("_all") > 0, F.col("_known") / F.col("_all")).otherwise(0.0).alias("coverage"),
    )


def predict_hybrid(prompts: DataFrame, counts: DataFrame, id_col: str, idf: DataFrame, labels: DataFrame, likelihoods: DataFrame | None, centroids: DataFrame) -> DataFrame:
    """Label, confidence, margin and alternatives of naive Bayes and centroids together."""
    centroid = centroid_scores(prompts, tfidf(counts, id_col, idf), id_col, labels, centroids)
    bayes = None if likelihoods is None else naive_bayes_scores(prompts, counts, id_col, labels, likelihoods)
    return best_label(hybrid(bayes, centroid, id_col), id_col, "confidence")


def load_router_model(spark: SparkSession, path: str) -> dict | None:
    """A router model's document, or None where it is missing or damaged: then the rules stand alone."""
    from routelake.sources.files import read_document

    found = read_document(spark, path)
    return found if found and isinstance(found.get("targets"), list) else None


class _Classifier:
    """A classifier of a router model: its labels, what each token weighs for them, and the sums that its scores need."""

    def __init__(self, number: int, kind: str, model: dict):
        self.number, self.kind, self.model = number, kind, model
        self.names = sorted(model["labels"])
        if len(self.names) > MOST_LABELS:
            raise ValueError(f"a classifier with over {MOST_LABELS} labels")
        self.idf = model.get("idf") or {}
        if kind == "linear_classifiers":
            self.values = {name: model["coefficients"].get(name, {}) for name in self.names}
        else:
            inner = "centroid" if kind == "centroid_classifiers" else "token_log_likelihoods"
            self.values = {name: model["classes"][name][inner] for name in self.names}

    @property
    def schema(self) -> str:
        return f"idf{self.number} double, values{self.number} array<double>"

    def cells(self, token: str) -> tuple:
        """A token's inverse frequency and values by label, null where there is none."""
        found = [None if (v := self.values[name].get(token)) is None else float(v) for name in self.names]
        return (None if (v := self.idf.get(token)) is None else float(v), found if any(v is not None for v in found) else None)

    def sums(self) -> list[Column]:
        k = self.number
        value = lambda i: F.get(f"values{k}", F.lit(i))
        if self.kind == "classifiers":
            return [F.sum(F.col("n") * F.coalesce(value(i), F.lit(float(self.model["classes"][name]["unknown_log_likelihood"])))).alias(f"_{k}_{i}") for i, name in enumerate(self.names)]
        weight = (1 + F.log(F.col("n"))) * F.col(f"idf{k}")
        own = [F.sum(weight * value(i)).alias(f"_{k}_{i}") for i in range(len(self.names))]
        return [*own, F.sqrt(F.sum(weight * weight)).alias(f"_{k}_norm"), F.count(f"idf{k}").alias(f"_{k}_known")]

    def scores(self) -> Column:
        """The labels' scores as an array, of a prompt's sums."""
        k = self.number
        if self.kind == "classifiers":
            return F.array(*[F.lit(float(self.model["classes"][name]["log_prior"])) + F.coalesce(F.col(f"_{k}_{i}"), F.lit(0.0)) for i, name in enumerate(self.names)])
        first = lambda name: float(self.model["intercepts"][name]) if self.kind == "linear_classifiers" else 0.0
        return F.array(*[F.lit(first(name)) + F.coalesce(F.when(F.col(f"_{k}_norm") > 0, F.col(f"_{k}_{i}") / F.col(f"_{k}_norm")), F.lit(0.0)) for i, name in enumerate(self.names)])


def _shares(scores: Column, temperature: float = 1.0) -> Column:
    """Shares by exp((score - best) / temperature), of an array."""
    shifted = bound(scores, lambda own: bound(F.array_max(own), lambda most: F.transform(own, lambda x: F.exp((x - most) / temperature))))
    return bound(shifted, lambda e: bound(F.aggregate(e, F.lit(0.0), lambda t, x: t + x), lambda total: F.transform(e, lambda x: x / total)))


def _weighted(parts: list[tuple[_Classifier, float, float]], names: list[str]) -> Column:
    """The weighted sum of the shares of classifiers (each with its temperature and weight), for each label of any."""

    def summed(shares: Column) -> Column:
        terms = lambda name: [shares[i][c.names.index(name)] * weight for i, (c, _, weight) in enumerate(parts) if name in c.names]
        return F.array(*[reduce(add, terms(name)) for name in names])

    return bound(F.array(*[_shares(c.scores(), temperature) for c, temperature, _ in parts]), summed)


def _ranked(shares: Column, names: list[str]) -> Column:
    """Structs (minus, label), the best first, ties by name."""
    return F.array_sort(F.zip_with(shares, F.array(*[F.lit(n) for n in names]), lambda p, n: F.struct((-p).alias("minus"), n.alias("label"))))


def _found(shares: Column, names: list[str], linear: _Classifier | None) -> Column:
    """label, confidence, margin, coverage, entropy and alternatives of a prompt; only a linear classifier tells margin, coverage and entropy."""
    none = F.lit(None).cast("double")

    def told(p: Column) -> Column:
        def best(r: Column) -> Column:
            entropy = F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log(x)).otherwise(0.0)) / F.log(F.lit(float(len(names))))
            more = (F.try_element_at(r, F.lit(2))["minus"] - r[0]["minus"], F.when(F.col("_all") > 0, F.col(f"_{linear.number}_known") / F.col("_all")).otherwise(0.0), entropy) if linear else (none,) * 3
            columns = [r[0]["label"], -r[0]["minus"], *more, F.transform(F.slice(r, 2, 2), lambda x: x["label"])]
            return F.struct(*[c.alias(n) for c, n in zip(columns, ("label", "confidence", "margin", "coverage", "entropy", "alternatives"), strict=True)])

        return bound(_ranked(p, names), best)

    return bound(shares, told)


def predict_with_model(prompts: DataFrame, id_col: str, text: str, model: dict | None) -> DataFrame:
    """``prompts`` with label, confidence, margin, coverage and entropy of each of the model's targets as ``<target>_label`` and so on.

    A target's linear classifier predicts if there is one, else centroids with naive Bayes beside
    them, else naive Bayes alone; what a classifier does not tell is null.  Without a model, or
    without any classifier in it, ``prompts`` come back as they are.

    Texts are taken apart once: a token meets one table with what it weighs in all classifiers,
    one aggregation gives a prompt the sums of them all, and what follows happens within a row.
    """
    kinds = ("linear_classifiers", "classifiers", "centroid_classifiers")
    if not model or not any(model.get(kind) for kind in kinds):
        return prompts
    spark, ngrams = prompts.sparkSession, (model.get("preprocessing") or {}).get("char_ngrams")
    held: list[_Classifier] = []

    def classifier(kind: str, target: str) -> _Classifier | None:
        """The classifier of a target; equal ones are held once."""
        own = (model.get(kind) or {}).get(target)
        if own and not (known := [c for c in held if c.kind == kind and c.model == own]):
            held.append(known := _Classifier(len(held), kind, own))
            return known
        return known[0] if own else None

    ensemble, columns = model.get("ensemble") or {}, {}
    for target in model["targets"]:
        if linear := classifier(kinds[0], target):
            columns[target] = _found(_shares(linear.scores(), float(linear.model.get("temperature") or 1)), linear.names, linear)
            continue
        bayes, centroid = (classifier(kind, target) for kind in kinds[1:])
        if centroid:
            both = [(centroid, 0.18, ensemble.get("centroid_weight", 1.0)), *([(bayes, 1.0, ensemble.get("naive_bayes_weight", 0.15))] if bayes else [])]
            names = sorted({name for c, *_ in both for name in c.names})
            columns[target] = _found(_weighted(both, names), names, None)
        elif bayes:
            columns[target] = _found(_shares(bayes.scores()), bayes.names, None)
    if not columns:
        return prompts
    tokens = sorted({t for c in held for t in [*c.idf, *(t for own in c.values.values() for t in own)]})
    schema = ", ".join(["token string", *(c.schema for c in held)])
    by_token = spark.createDataFrame([(t, *(cell for c in held for cell in c.cells(t))) for t in tokens], schema)
    apart = prompts.select(id_col, router_tokens(F.col(text), tuple(ngrams) if ngrams else None).alias("_tokens"))
    counts = apart.select(id_col, F.explode_outer(counted(F.col("_tokens"))).alias("_c")).select(id_col, "_c.token", "_c.n")
    sums = counts.join(small(by_token), "token", "left").groupBy(id_col).agg(F.count("token").alias("_all"), *[s for c in held for s in c.sums()])
    found = sums.select(F.col(id_col).alias("_id"), *[column.alias(f"_of_{target}") for target, column in columns.items()])
    parts = ("label", "confidence", "margin", "coverage", "entropy", "alternatives")
    found = found.select("_id", *[F.col(f"_of_{target}")[part].alias(f"{target}_{part}") for target in columns for part in parts])
    return prompts.join(found, F.col(id_col).eqNullSafe(F.col("_id")), "left").drop("_id")
