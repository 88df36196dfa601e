"""Training documents are read to their end."""

import random

from routelake.llm import toxicity


def test_phrases_after_many_matches_are_seen(spark):
    rng = random.Random(3)
    filler = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = [(i, filler(30) + " scumble" * 1050 + f" odd scumble {filler(5)}", 1) for i in range(60)]
    rows += [(100 + i, f"{filler(30)} {'odd scumble' if i < 14 else ''} {filler(2000)}", 0) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(docs.drop("toxic"), docs.drop("text"))
    assert lexicon.weights
    assert ("odd", "scumble") not in lexicon.exceptions
    text = toxicity.fold(rows[0][1])
    assert lexicon.score(lexicon.counted(lexicon.hits(text)), text.count(" ") - 1) >= toxicity.THRESHOLD


def test_long_documents_contexts_are_whole(spark):
    lexicon = toxicity.Lexicon({" scumble ": 2.0})
    docs = spark.createDataFrame([("scumble x " * 1500 + "end", 1)], "text string, toxic int")
    hits = docs.mapInPandas(toxicity._contexts(lexicon), "toxic int, first long, second long, words int, hits array<string>").first()["hits"]
    assert sum(int(h.split(" ", 1)[0]) for h in hits) == 1500
