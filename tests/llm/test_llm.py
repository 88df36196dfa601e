import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from routelake.llm import exact_dedup, jaccard_join, language_id, media, mixing, packing, quality, sharding, token_store, toxicity
from tests.oracle import compare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
VOCABULARY = None


def words(n, seed, stem="w"):
    rng = random.Random(seed)
    return " ".join(f"{stem}{rng.randrange(10**6)}" for _ in range(n))


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, odd characters; extra columns with clashing names."""
    long = words(30_000, 1)
    rows = [
        (1, "a b c d e f g", "en", "s0"), (2, None, "en", "s0"), (3, "", None, "s1"), (4, long, "de", None), (5, "a b c d e f g", "fr", "s1"), (5, "a b c d e f g", "fr", "s1"),
        (None, "nobody's text here", "en", "s0"), (None, "a b c d e f g", None, None), (7, " \t\n ", "en", "s2"), (8, "A  b\tc d e f g", "en", "s2"), (9, "été ümlaut 漢字 \U0001f600 x y  z", "fr", "s2"),
        (10, long + " tail", "de", "s0"), (11, "<p>&amp;</p> <|endoftext|> 12 '#$%", "en", "s1"), (12, "one", "en", "s1"),
    ]
    df = rows_of(spark, rows)
    for name in ("_row", "_id", "_own", "_words", "size", "order", "shard", "digest", "sid", "n", "row", "_key", "keep_id", "label"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- op1


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def expected_ids(pairs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    pairs = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or ""))
    start, out = 0, []
    for (key, _), ids in zip(pairs, [plain.encode(t or "", add_special_tokens=False).ids for _, t in pairs], strict=True):
        ids = np.array([*ids, token_store.END], dtype="<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_store_round_trip(spark, odd, empty, tmp_path):
    token_store.write(odd, f"file://{tmp_path}/a", vocabulary())
    got = sorted(map(tuple, token_store.listing(spark, f"file://{tmp_path}/a").collect()), key=lambda r: r[1])
    want = expected_ids(texts_of(odd))
    assert sorted((r[0] is None, r[0] or 0, r[2], r[3]) for r in got) == sorted((r[0] is None, r[0] or 0, r[2], r[3]) for r in want)
    assert [r[1] for r in got] == list(np.cumsum([0, *[r[2] for r in got]])[:-1])
    keyed = [r[0] for r in got if r[0] is not None]
    assert keyed == sorted(keyed)
    token_store.write(empty, f"file://{tmp_path}/b", vocabulary())
    assert token_store.listing(spark, f"file://{tmp_path}/b").count() == 0


def test_token_query(spark):
    got = {tuple(r) for r in token_store.query(spark, SF).collect()}
    assert got == set(expected_ids(texts_of(spark.read.parquet(f"{SF}/documents.parquet"))))


def test_range_coder(monkeypatch):
    monkeypatch.setattr(token_store, "EVERY", 8)
    rng = np.random.default_rng(0)
    for n, top in ((1, 5), (63, 3), (5000, 50_000), (70_000, 300), (4096, 1)):
        ids = np.minimum(rng.geometric(0.01, size=n), top).astype(np.uint32)
        freq = token_store.quantised(np.bincount(ids))
        assert freq.sum() == 1 << token_store.SCALE and (freq[np.unique(ids)] > 0).all()
        start = np.cumsum(freq) - freq
        used = np.flatnonzero(freq)
        table = token_store.Table.of(np.stack([used, freq[used].astype(np.int64)], axis=1).astype("<u4").tobytes())
        lanes, states, positions, stream = token_store.encode_block(ids, freq, start)
        assert (token_store.decode_block(table, n, lanes, states, positions, stream) == ids).all()
        marks = len(positions) // 4
        parts = [token_store.decode_block(table, n, lanes, states, positions, stream, k, (k + 1) * 8) for k in range(marks)]
        assert (np.concatenate(parts) == ids).all()  # every checkpoint is an entry of its own


def test_damage_is_found(spark, tmp_path):
    token_store.write(rows_of(spark, [(1, words(500, 3), "en", "s")]), f"file://{tmp_path}/a", vocabulary())
    bad = spark.read.parquet(f"file://{tmp_path}/a").withColumn("crc", F.col("crc") + 1)
    bad.write.parquet(f"file://{tmp_path}/b")
    with pytest.raises(Exception, match="checksum"):
        token_store.listing(spark, f"file://{tmp_path}/b").collect()


# ---------------------------------------------------------------- op2


def check_packing(pieces, docs, capacity, per_source):
    """Whole, within capacity, without overlaps or conflicts."""
    size = Counter()
    bins = defaultdict(list)
    for r in pieces:
        size[r["doc_id"]] += r["n_words"]
        bins[r["bin"]].append(r)
    want = Counter()
    for r in docs:
        want[r["doc_id"]] += len((r["text"] or "").encode().split())
    assert size == want
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: (r["bin_offset"], r["n_words"])):
            assert r["bin_offset"] == at
            at += r["n_words"]
        assert at <= capacity and all(r["bin_used"] == at for r in own)


def test_packing(spark, odd, empty):
    out = packing.pack(odd, capacity=1000).collect()
    check_packing(out, odd.collect(), 1000, packing.PER_SOURCE)
    copies = [r["bin"] for r in out if r["doc_id"] in (1, 5) and r["n_words"]]
    assert len(copies) == len(set(copies))  # equal texts share no bin
    assert packing.pack(empty).count() == 0
    check_packing(packing.query(spark, SF).collect(), spark.read.parquet(f"{SF}/documents.parquet").collect(), packing.CAPACITY, packing.PER_SOURCE)


def test_best_fit_matches_a_plain_search():
    rng = random.Random(5)
    n = 300
    lengths, sources, clusters = [rng.randrange(0, 60) for _ in range(n)], [rng.choice([0, 0, 1, 2]) for _ in range(n)], [rng.choice([-1, -1, 0, 1]) for _ in range(n)]
    got = packing.best_fit(lengths, sources, clusters, 100, 3)
    bins, want = [], {}
    for i in sorted(range(n), key=lambda i: (-lengths[i], i)):
        fits = [(100 - sum(lengths[j] for j in b), k) for k, b in enumerate(bins) if sum(lengths[j] for j in b) + lengths[i] <= 100 and sum(sources[j] == sources[i] for j in b) < 3 and (clusters[i] < 0 or all(clusters[j] != clusters[i] for j in b))]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        want[i] = k, sum(lengths[j] for j in bins[k])
        bins[k].append(i)
    assert got == [want[i] for i in range(n)]


# ---------------------------------------------------------------- op3


def toxic_corpus(spark, n=600):
    rng = random.Random(2)
    common = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        own = [rng.choice(common) for _ in range(rng.randrange(20, 120))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                own[rng.randrange(len(own))] = rng.choice(["Scumble", "sсumble", "5cumble", "grotox", "gr0tox", "mirpalot", "mirpaler"])
        elif i % 40 == 1:
            at = rng.randrange(len(own) - 1)
            own[at : at + 2] = ["grotox", "remover"]
        rows.append((i, " ".join(own), "en", f"s{i % 3}"))
        labels.append((i, 1, int(bad)))
    return rows_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, t) for i, _, t in labels)


def test_toxicity_learns_words_stems_foldings_and_exceptions(spark, odd, empty):
    docs, labels, truth = toxic_corpus(spark)
    lexicon = toxicity.learn(docs, labels)
    assert ("grotox", "remover") in lexicon.exceptions
    out = toxicity.score(docs, lexicon).collect()
    held = {r["doc_id"] for r in docs.select("doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    wrong = [r for r in out if r["doc_id"] in held and r["predicted"] != truth[r["doc_id"]]]
    assert len(held) > 80 and len(wrong) <= 2
    assert toxicity.fold("SСUMBLE 5cumble") == " scumble scumble "
    scored = toxicity.score(odd, lexicon).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score(empty, lexicon).count() == 0
    kept = toxicity.accepted(odd, labels)
    assert kept.columns == odd.columns and kept.count() == odd.count()  # nothing in it is toxic
    assert toxicity.learn(empty, labels.limit(0)) == toxicity.Lexicon()
    assert {r["doc_id"] for r in toxicity.accepted(docs, labels).collect()} == {r["doc_id"] for r in out if not r["predicted"]}


def test_held_out_labels_are_not_read(spark):
    docs, labels, _ = toxic_corpus(spark, 200)
    wrong = F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    assert toxicity.learn(docs, labels) == toxicity.learn(docs, labels.withColumn("toxic", wrong))


# ---------------------------------------------------------------- op4


def check_shards(out, n, texts):
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert len(out) == n and all(0 <= s < sharding.SHARDS for s in by)
    sizes = [len(by[s]) for s in range(sharding.SHARDS)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding(spark, odd, empty):
    rows = [(i, words(5, i), "en", "s") for i in range(700)] + [(700 + i, words(5, i % 40), "en", "s") for i in range(150)] + [(900 + i, "hot text", "en", "s") for i in range(220)]
    docs = rows_of(spark, rows)
    out = sharding.propagate(docs).collect()
    check_shards(out, len(rows), rows)
    text = {i: t for i, t, *_ in rows}
    where = defaultdict(set)
    for r in out:
        where[text[r["doc_id"]]].add(r["shard"])
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    small = [s for t, s in where.items() if t != "hot text"]
    assert sum(len(s) > 1 for s in small) <= 0.05 * len(small)  # groups that fit stay together
    hot = Counter(r["shard"] for r in out if text[r["doc_id"]] == "hot text")
    assert sum(n for _, n in hot.most_common(5)) >= 0.75 * 220  # it fills five shards
    check_shards(sharding.propagate(odd).collect(), odd.count(), None)
    assert sharding.propagate(empty).count() == 0


# ---------------------------------------------------------------- op5


def test_language_id(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn(docs)
    out = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.97 * len(held)
    scored = language_id.identify(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert all(r["lang_pred"] == "und" for r in scored if r["doc_id"] in (2, 3, 7))
    assert language_id.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.learn(empty)).collect()} == {"und"}


# ---------------------------------------------------------------- op6


def test_exact_dedup_sql(spark):
    assert compare(spark, "op6", exact_dedup.query, exact_dedup.ORACLE, SF) == ""


def test_exact_dedup_edges(spark, odd, empty):
    out = exact_dedup.deduplicate(odd).collect()
    assert len(out) == odd.count()
    group = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in out}
    assert group[1] == (1, 4, True) and group[5] == (1, 4, False) and group[2] == (2, 2, True) and group[3] == (2, 2, False)
    assert group[7] == (7, 1, True) and group[8] == (8, 1, True)
    assert next(r for r in out if r["doc_id"] == 2)["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert exact_dedup.deduplicate(empty).count() == 0
    kept = exact_dedup.surviving(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 4, 7, 8, 9, 10, 11, 12]
    repeats = rows_of(spark, [(1, "x", "en", "s")] * 3 + [(2, "x", "en", "s")])
    assert [r["doc_id"] for r in exact_dedup.surviving(repeats).collect()] == [1]


def test_exact_dedup_hot_group(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}", "en", "s") for i in range(20_000)]
    out = exact_dedup.deduplicate(rows_of(spark, rows)).collect()
    first, size = {}, Counter()
    for i, t, *_ in rows:
        first.setdefault(t, i)
        size[t] += 1
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in out} == {(i, first[t], size[t]) for i, t, *_ in rows}


# ---------------------------------------------------------------- op7


def test_html_sequences(spark):
    pages = spark.createDataFrame([(1, "<p>a <b>b</b></p><figure><img src=x alt=A><figcaption>c <i>d</i></figcaption></figure>tail<script>no</script><img data-src=' y '>"), (2, None), (3, ""), (4, "<figure><img src=z"), (5, "<figure><img src=q><figcaption>open")], "page_id long, html string")
    items = media.sequences(pages, "page_id", "html")
    got = {(r["page_id"], r["position"]): (r["kind"], r["text"], r["ref"], r["alt"], r["caption"]) for r in items.collect()}
    assert got == {
        (1, 0): ("text", "a b", None, None, None), (1, 1): ("media", None, "x", "A", "c d"), (1, 2): ("text", "tail", None, None, None), (1, 3): ("media", None, "y", None, None), (5, 0): ("media", None, "q", None, "open"),
    }
    one = media.interleaved(items, "page_id").where("page_id = 1").first()["items"]
    assert [x["position"] for x in one] == [0, 1, 2, 3]


def test_media(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(media, "documents", lambda spark, d: odd)
    out = media.query(spark, "").collect()
    assert len(out) == odd.count()
    want = Counter()
    for key, text in texts_of(odd):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored = media.as_pgm(payload)
        want[key, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest()] += 1
    assert Counter(tuple(r)[:7] for r in out) == want
    assert len({(r["payload_sha256"], r["feature"]) for r in out}) == len({r["payload_sha256"] for r in out})
    monkeypatch.setattr(media, "documents", lambda spark, d: empty)
    assert media.query(spark, "").count() == 0
    with pytest.raises(ValueError):
        media.from_pgm(b"P5\n64 2\n255\nshort")


# ---------------------------------------------------------------- op8


def test_mixing_sql(spark):
    assert compare(spark, "op8", mixing.query, mixing.ORACLE, SF) == ""


def test_mixing_edges(spark, odd, empty):
    out = mixing.account(odd).collect()
    assert len(out) == odd.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    assert mixing.account(empty).count() == 0 and mixing.mixed(empty).count() == 0
    taken = mixing.mixed(odd)
    assert taken.columns == odd.columns
    assert sum(len((r["text"] or "").encode().split()) for r in taken.collect()) == sum(r["taken"] for r in out)


def test_mixing_targets_and_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SETTLED", 4)
    monkeypatch.setattr(mixing, "PARTS", 8)
    rows = [(i, words(1 + i % 37, i), "en", f"s{min(i % 7, 3)}") for i in range(900)]
    docs = rows_of(spark, rows)
    out = mixing.account(docs, repeats=True).collect()
    total, by = sum(r["size"] for r in out), defaultdict(int)
    for r in out:
        by[r["source"]] += r["taken"]
    target = {r["source"]: r["target"] for r in out}
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 and 0 <= 1.5 * total - sum(by.values()) <= 40
    assert all(abs(by[s] - target[s]) <= 2 * 37 for s in by)
    queue = mixing.mix(docs).collect()
    assert [r["finish"] for r in queue] == sorted(r["finish"] for r in queue)
    assert sum(r["size"] for r in queue) == sum(by.values())
    sources = mixing.weighted(spark.createDataFrame([("b", 100), ("a", 10), (None, 50)], "source string, source_size long"))
    assert {r["source"]: r["target"] for r in mixing.with_targets(sources).collect()} == {"a": 20.0, "b": 146.66666666666666, None: 73.33333333333333}


# ---------------------------------------------------------------- op9


def test_quality(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model, weights = quality.learn(docs)
    assert 0.5 < model.prior < 1 and all(a > 0.5 for a in model.accuracy())
    out = quality.score(docs, weights).join(labels, "doc_id").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in out) > 0.97 * len(out)
    scored = quality.score(odd, weights).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.score(empty, weights).count() == 0
    assert quality.learn(empty)[0].prior == 0.8


# ---------------------------------------------------------------- op10


def brute_components(pairs):
    sets = {}
    for key, text in pairs:
        w = (text or "").encode("utf-8", "surrogatepass").lower().split()
        sets[key] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def near_corpus():
    """Chains of near copies, a large loose group, common passages, copies, short texts."""
    rng = random.Random(8)
    rows, key = [], 0
    passage = words(60, 99, "p").split()
    for g in range(12):
        base = words(rng.choice([6, 40, 120]), g).split()
        for _ in range(rng.choice([1, 2, 5, 12])):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
            if g % 3 == 0:
                base = own
            rows.append((key, " ".join(own if rng.random() < 0.7 else [*own, *passage])))
            key += 1
    loose = words(150, 77).split()
    for _ in range(60):
        own = list(loose)
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(len(own))] = f"loose{rng.randrange(10**6)}"
        rows.append((key, " ".join(own)))
        key += 1
    for i in range(30):
        rows.append((key, " ".join([*words(30, 1000 + i).split(), *passage, *words(30, 2000 + i).split()])))
        key += 1
    rows += [(key, "One two three"), (key + 1, "one TWO\tthree"), (key + 2, "one two"), (key + 3, ""), (key + 4, None), (key + 5, " \n"), (key + 6, "É é é é é é"), (key + 7, "é é é é é é")]
    return rows


@pytest.mark.parametrize("leaf, block, heavy", [(64, 256, 50_000), (3, 8, 50_000), (2, 4, 0)])
def test_jaccard_join_is_exact(spark, monkeypatch, leaf, block, heavy):
    for name, value in (("LEAF", leaf), ("BLOCK", block), ("HEAVY", heavy)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = near_corpus()
    docs = rows_of(spark, [(i, t, "en", "s") for i, t in rows]).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs).collect()}
    assert got == brute_components(rows)


def test_jaccard_join_edges(spark, odd, empty):
    out = jaccard_join.join(odd).collect()
    assert len(out) == odd.count()
    got = {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None}
    want = brute_components([(k, t) for k, t in texts_of(odd) if k is not None])
    assert got == {k: c for k, (_, c) in want.items()}
    assert jaccard_join.join(empty).count() == 0
    kept = jaccard_join.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 7, 9, 11, 12]


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, SF)
        assert seen.columns == docs.columns, name
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_edges(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, empty):
            out = stage(spark, docs, SF)
            assert out.count() >= 0
            assert name == "packing" or out.columns == odd.columns
