"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib

import pytest

from routelake.llm import resampling

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def features(text, grams):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in range(1, grams + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, grams=1, percent=10, least=20):
    """(doc_id, n_features, weight, score, rank) of each document."""
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in features(text, grams)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((float(t[b] + 1) * (sum(s) + 10_000)) / (float(s[b] + 1) * (sum(t) + 10_000)))) for b in range(10_000)]
    rows = []
    for doc_id, text in docs:
        words, own = features(text, grams)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= least])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0], r[1]))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def found(spark, docs, target, **how):
    own = spark.createDataFrame([(i, x, "s", 1, 2) for i, x in docs], "doc_id long, text string, score string, rank int, eligible int")
    goal = spark.createDataFrame([(x, 1) for x in target], "text string, weight int")
    got = resampling.resampled(own, goal, **how)
    return sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def corpus(n):
    return [(i * 7919 % 10_007, " ".join(f"W{(i * 31 + k * k) % 97}é" if k % 3 else f"x{k % 11},y" for k in range(i % 60))) for i in range(n)]


@pytest.mark.parametrize("grams,percent", [(1, 10), (2, 33), (3, 100)])
def test_ranks_as_plain_python(spark, grams, percent):
    docs, target = corpus(300), ["x1 y w5é w7é", "W5É w12é y", None, ""]
    assert found(spark, docs, target, grams=grams, percent=percent) == plain(docs, target, grams, percent)


def test_many_of_one_score(spark, monkeypatch):
    """A third of the rows share an id and a text, and so a score; blocks and ranges are tiny."""
    monkeypatch.setattr(resampling, "SPAN", 3)
    monkeypatch.setattr(resampling, "noise", lambda doc_id, seed: resampling.F.lit(0).cast("long"))
    docs = [(i, "a b " * 10 + f"w{i % 5}") for i in range(120)] + [(500, "b c " * 11)] * 60
    got = found(spark, docs, ["b c d"], percent=70)
    ranks = sorted(r[4] for r in got if r[4])
    assert ranks == list(range(1, 127))
    by_rank = sorted((r for r in got if r[4]), key=lambda r: r[4])
    assert [(-r[3], r[0]) for r in by_rank] == sorted((-r[3], r[0]) for r in by_rank)
    assert max((-r[3], r[0]) for r in by_rank) <= min((-r[3], r[0]) for r in got if not r[4])


def test_odd_documents(spark):
    docs = [(1, None), (2, ""), (3, "one two"), (None, "a b c d e " * 4), (5, "a\x00b " * 20), (5, "a\x00b " * 20), (6, "word " * 50_000)]
    assert found(spark, docs, ["a b c"], percent=50) == plain(docs, ["a b c"], percent=50)
    assert found(spark, docs, []) == plain(docs, [])
    assert found(spark, [], ["a"]) == []
    assert found(spark, [(1, "few words")], ["a"]) == plain([(1, "few words")], ["a"])
