"""Ids are those of the plain library, whatever the texts hold, and documents can be fetched from checkpoints."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.test_llm import SF, vocabulary

from routelake.llm import token_store


def test_added_tokens_are_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    texts = ["x <|endoftext|> y", "a<|endoftext|>", "<|endoftext|> <|endoftext|>", "no such token here", "two  spaces <|endoftext|>", "x <|endoftext y"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert any(50256 in ids for ids in want)
    assert [ids.tolist() for ids in token_store.Encoder(vocabulary()).encode(texts)] == want


@pytest.mark.parametrize("known", [2_000_000, 40])
def test_pieces_give_the_ids_of_whole_texts(monkeypatch, known):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store.Encoder, "KNOWN", known)
    monkeypatch.setattr(token_store.Encoder, "PIECES", 30)
    rng, plain, coder = random.Random(4), Tokenizer.from_file(vocabulary()), token_store.Encoder(vocabulary())
    marks = ["a", "b", "Z", "é", "ß", "1", " ", "  ", "\n", ".", ",", "'s", "'", "!", "漢", "\u00a0", "\u200b", "😀", "-", "don't", "The", "?", ":", "\t", "ª", "ɐ", "²", "\u0308"]
    for _ in range(5):
        texts = [" ".join("".join(rng.choice(marks) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
        assert [ids.tolist() for ids in coder.encode(texts)] == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]


def test_documents_are_fetched_from_checkpoints(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, "no id")], "doc_id long, text string"))
    path = f"file://{tmp_path}/a"
    token_store.write(docs, path, vocabulary())
    whole = {r["doc_id"]: bytes(r["ids"]) for r in token_store.read(spark, path).collect()}
    asked = [0, 1, 7, 42, 43, 44, 199, 10**9]
    got = {r["doc_id"]: bytes(r["ids"]) for r in token_store.fetch(spark, path, asked).collect()}
    assert got == {k: whole[k] for k in asked if k in whole} and len(got) >= 6
    spark.read.parquet(path).withColumn("crcs", F.lit(bytes(400_000))).write.parquet(f"{path}-bad")
    with pytest.raises(Exception, match="checksum"):
        token_store.fetch(spark, f"{path}-bad", [42]).collect()
    assert np.frombuffer(got[42], dtype="<u4")[-1] == token_store.END


def test_rows_that_repeat_an_id_keep_their_order(spark, tmp_path):
    rows = [(5, f"text {i}") for i in range(40)] + [(None, f"none {i}") for i in range(5)]
    found = []
    for turn, parts in enumerate((1, 7)):
        docs = spark.createDataFrame(rows[:: 1 - 2 * turn], "doc_id long, text string").repartition(parts)
        token_store.write(docs, f"file://{tmp_path}/{turn}", vocabulary())
        found.append(sorted((r["start"], r["ids_crc32"]) for r in token_store.listing(spark, f"file://{tmp_path}/{turn}").collect()))
    assert found[0] == found[1]
