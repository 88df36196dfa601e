"""Queries and pipeline stages against plain Python over the same rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.llm.test_llm import SF, brute_components, check_packing, empty, odd, rows_of, words  # noqa: F401
from tests.oracle import compare

import corpus_pipeline
from routelake.llm import exact_dedup, jaccard_join, language_id, media, mixing, packing, quality, toxicity


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def plain_score(lexicon, text):
    """A text's toxicity by looking for every term at every place of the folded text."""
    folded = toxicity.fold(text or "")
    own = folded.split()
    total = 0.0
    for i, word in enumerate(own):
        found = [w for term, w in lexicon.weights.items() if (f" {word} " == term if term.endswith(" ") else f" {word}".startswith(term))]
        before, after = own[i - 1] if i else "", own[i + 1] if i + 1 < len(own) else ""
        if found and (before, word) not in lexicon.exceptions and (word, after) not in lexicon.exceptions:
            total += max(found)
    n = max(len(own), 1)
    z = sum(a * b for a, b in zip(lexicon.fit, (1, math.log1p(total), math.log1p(100 * total / n), math.log1p(10 * total / math.sqrt(n))), strict=True))
    return 1 / (1 + math.exp(-z))


def test_toxicity_against_plain_search_and_held_out_labels(spark):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.1"), table(spark, "labels", "/root/testdata/sf0.1")
    lexicon = toxicity.learn(docs, labels)
    rows = toxicity.query(spark, "/root/testdata/sf0.1").collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    found = Counter(held)
    assert found[1, 1] >= 0.9 * (found[1, 1] + found[1, 0]) and found[0, 1] <= 0.01 * (found[0, 0] + found[0, 1])
    score = {r["doc_id"]: r["score"] for r in rows}
    for r in docs.where("doc_id % 50 = 7").collect():
        assert abs(score[r["doc_id"]] - plain_score(lexicon, r["text"])) < 1e-9


def test_language_against_plain_sums(spark):
    docs = table(spark, "documents")
    model = language_id.learn(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.query(spark, SF).collect()}
    for r in docs.collect():
        known = [w for t in (r["text"] or "").split() if (w := language_id.word_of(t))]
        if not known:
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        logs = sum(model.of_word(w) for w in known) / math.sqrt(len(known))
        best = int(np.argmax(logs))
        assert got[r["doc_id"]][0] == model.langs[best] and abs(got[r["doc_id"]][1] - 1 / np.exp(logs - logs[best]).sum()) < 1e-6


def test_language_sample_is_bounded_and_even(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_PER_LANG", 50)
    rows = [(i, f"text {i}", "en" if i % 10 else "fr", "s") for i in range(5000)] + [(5, "repeat", "en", "s")] * 3000
    counts = Counter(r["lang"] for r in language_id.training_sample(rows_of(spark, rows)).collect())
    assert counts == {"en": 50, "fr": 50}


def test_quality_against_plain_formula(spark):
    docs = table(spark, "documents")
    assert quality.vote_patterns(docs) == Counter(quality.votes(r["text"] or "") for r in docs.collect())
    _, weights = quality.learn(docs)
    got = {r["doc_id"]: r["score"] for r in quality.query(spark, SF).collect()}
    for r in docs.collect():
        at, value = quality.Features().of(r["text"] or "")
        z = sum(float(weights[i]) * float(v) for i, v in zip(at, value, strict=True)) + float(weights[-1])
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-4


def test_quality_learns_from_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "MAX_TRAIN", 20)
    seen = []
    monkeypatch.setattr(quality, "fit_scorer", lambda rows: seen.append(len(rows)) or np.zeros(quality.BUCKETS + 1, dtype=np.float32))
    quality.learn(rows_of(spark, [(i % 30, words(30, i), "en", "s") for i in range(400)] + [(3, "copy", "en", "s")] * 200))
    assert seen == [20]


def plain_items(html):
    """Texts, media references and captions of a page in order, by a scan over its tags."""
    out, words_, hidden, caption, figure = [], [], 0, None, []

    def flush():
        if text := " ".join("".join(words_).split()):
            out.append(("text", text, None))
        words_.clear()

    import html as entities

    for tag, end, name, rest, data in re.findall(r"(<(/?)([A-Za-z][A-Za-z0-9]*)([^<>]*)>)|(?:<!--.*?-->)|(?:<!\w[^<>]*>)|([^<]+|<)", html, re.S):
        name = name.lower()
        if not tag:
            if not hidden and data:
                (words_ if caption is None else caption).append(entities.unescape(data))
        elif name in media.HIDDEN:
            hidden = max(0, hidden + (-1 if end else 1))
        elif not hidden:
            if name == "figcaption" and not end:
                caption = []
            elif name == "figcaption":
                for at in figure:
                    out[at] = (*out[at][:2], " ".join("".join(caption).split()))
                caption = None
            elif name in media.BLOCKS and caption is None:
                flush()
            if name == "figure":
                figure = []
            elif name in media.MEDIA and not end and (ref := re.search(r"\bsrc=[\"']?([^\"' >]+)", rest)):
                flush()
                out.append(("media", ref[1], None))
                figure.append(len(out) - 1)
    flush()
    return out


def test_sequences_of_real_pages(spark):
    pages = table(spark, "pages", "/root/testdata/sf0.01")
    items = media.sequences(pages, "page_id", "html")
    facts = spark.createDataFrame([("0" * 64, 1)], "digest string, payload_bytes long")
    got = {r["page_id"]: [(x["kind"], x["text"] if x["kind"] == "text" else x["ref"], x["caption"]) for x in r["items"]] for r in media.interleaved(media.resolved(items, facts), "page_id").collect()}
    want = {r["page_id"]: plain_items(r["html"] or "") for r in pages.collect()}
    same = sum(got.get(k, []) == v for k, v in want.items())
    assert len(want) == 250 and same == len(want), next((got.get(k), v) for k, v in want.items() if got.get(k, []) != v)


def test_features_of_stored_payloads(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, "documents").collect()}
    for r in media.query(spark, SF).collect():
        payload = media.padded(texts[r["doc_id"]].encode())
        size = len(payload) // 64
        means = [sum(payload[i * size : (i + 1) * size if i < 63 else None]) / size for i in range(64)]
        mean = sum(payload) / len(payload)
        bits = sum(1 << i for i, m in enumerate(means) if m > sum(means) / 64)
        told = r["feature"].split("/")
        assert abs(float(told[0]) - mean) < 1e-3 and bin(int(told[2], 16) ^ bits).count("1") <= 1


def test_jaccard_sql(spark):
    assert compare(spark, "op10", jaccard_join.query, jaccard_join.ORACLE, SF) == ""


def test_packing_does_not_depend_on_partitions(spark, odd):  # noqa: F811
    rows = [(i % 400, words(1 + i % 90, i % 50), "en", f"s{i % 3}") for i in range(900)] + [(7, "same words again", "en", "s0")] * 600
    docs = rows_of(spark, rows)
    found = [sorted(map(tuple, packing.pack(d, capacity=60).collect())) for d in (docs, docs.repartition(7), docs.orderBy("text"))]
    assert found[0] == found[1] == found[2]
    check_packing(packing.pack(docs, capacity=60).collect(), docs.collect(), 60, packing.PER_SOURCE)
    many = packing.pack(rows_of(spark, [(1, " ".join(["w"] * 50_000), "en", "s")] * 2), capacity=5).collect()
    assert len({r["bin"] for r in many}) == len(many) == 20_000


def test_mixing_cuts_among_ties(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SETTLED", 4)
    monkeypatch.setattr(mixing, "PARTS", 8)
    docs = rows_of(spark, [(i, "one two three", "en", f"s{i}") for i in range(600)])  # a source for each: very many equal times
    out = mixing.account(docs, repeats=True).collect()
    assert sum(r["taken"] for r in out) == 2700 and max(r["repeats"] for r in out) <= 2


# ---------------------------------------------------------------- stages of the pipeline


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain_stage(name, rows, spark, docs, sf):
    """The ids that a stage should leave, by plain Python over the rows that it gets."""
    if name == "toxicity":
        lexicon = toxicity.learn(docs, table(spark, "labels", sf))
        return Counter(r["doc_id"] for r in rows if plain_score(lexicon, r["text"]) < 0.5)
    if name == "exact_dedup":
        least = {}
        for r in rows:
            key = normal(r["text"])
            least[key] = min(least.get(key, (True, 0)), (r["doc_id"] is None, r["doc_id"] or 0))
        return Counter(None if none else i for none, i in least.values())
    if name == "jaccard_join":
        own = brute_components([(r["doc_id"], r["text"]) for r in rows])
        return Counter(k for k, (_, c) in own.items() if k == c)
    size = lambda r: len((r["text"] or "").encode().split())
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    total = {s: sum(size(r) for r in rows if r["source"] == s) for s in sources}
    budget, full = 1.5 * sum(total.values()), set()
    while True:
        share = (budget - sum(2 * total[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in sources if s not in full and share * weight[s] > 2 * total[s]}
        if not more:
            break
        full |= more
    target = {s: 2.0 * total[s] if s in full else share * weight[s] for s in sources}
    turns = []
    for s in sources:
        served = 0
        for r in sorted((r for r in rows if r["source"] == s), key=lambda r: mixing_order(r["doc_id"])):
            served += size(r)
            turns += [((k * total[s] + served) / target[s] if target[s] else 0.0, mixing_order(r["doc_id"]), k, r) for k in (0, 1)]
    out, used = Counter(), 0
    for _, _, _, r in sorted(turns, key=lambda t: t[:3]):
        used += size(r)
        if used > budget:
            break
        out[r["doc_id"]] += 1
    return out


def mixing_order(doc_id):
    import hashlib

    return hashlib.md5(str(doc_id).encode()).hexdigest()


@pytest.fixture(scope="module")
def unlike(spark, odd):  # noqa: F811
    """Real documents and odd ones, each id once."""
    extra = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    docs = table(spark, "documents")
    return docs.unionByName(extra.select((extra["doc_id"] + 100_000).alias("doc_id"), *docs.columns[1:]))


def test_every_stage_against_plain_python(spark, unlike):
    seen = unlike
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = seen.collect()
        want = plain_stage(name, rows, spark, seen, SF)
        out = stage(spark, seen, SF)
        assert out.columns == unlike.columns
        assert Counter(r["doc_id"] for r in out.collect()) == want, name
        seen = spark.createDataFrame(out.collect(), out.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, seen, SF).collect()
    check_packing(pieces, seen.collect(), packing.CAPACITY, packing.PER_SOURCE)
    # One shard: the tightest compatible bin, found by looking at all of them.
    rows = sorted(seen.collect(), key=lambda r: r["doc_id"])
    assert len(rows) <= packing.SHARD_ROWS and len(pieces) >= len(rows)
    of = {r["doc_id"]: (r["source"], normal(r["text"])) for r in rows}
    bins = {}
    for p in pieces:
        bins.setdefault(p["bin"], []).append(p)
    for own in bins.values():
        told = [of[p["doc_id"]] for p in own if p["n_words"] and p["n_words"] < packing.CAPACITY]
        assert len(set(told)) == len(told)
        assert max(Counter(s for s, _ in told).values(), default=0) <= packing.PER_SOURCE


def test_stages_of_odd_and_empty_rows(spark, odd, empty):  # noqa: F811
    kept = {"toxicity": 14, "exact_dedup": 10, "jaccard_join": 9}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
        out = stage(spark, odd, SF)
        if name in kept:
            assert out.count() == kept[name], name
        if name == "packing":
            check_packing(out.collect(), odd.collect(), packing.CAPACITY, packing.PER_SOURCE)
        else:
            assert out.columns == odd.columns


def test_repeated_rows_leave_a_defined_one(spark):
    rows = rows_of(spark, [(1, "x", lang, "s") for lang in ("en", "de", "fr")] + [(2, "x", "en", "s")])
    found = {tuple(exact_dedup.surviving(rows.repartition(n)).collect()) for n in (1, 3, 5)}
    assert len(found) == 1 and len(next(iter(found))) == 1
