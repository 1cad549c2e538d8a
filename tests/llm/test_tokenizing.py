"""Problem 6: against the vocabulary's own library, and round trips."""

import base64
import os
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("sentencepiece")
from codestrata.llm.tokenizing import alphabet, encode_column, pretokens, serialised_model, token_counts, tokenizer, vocabulary_path  # noqa: E402

SPECIAL = ["", " ", "a", "<|endoftext|>", "it's I'LL", "  x\t\ty \n\n", "a\x1c b\x1d", "nbsp\u00a0\u2003x", "Ⅷ ½ ² ٣", "é é", "🙂‍↔️ 漢字 עברית", "\ufeff{}", "\x00\x01", "a" * 3000, " " * 2000 + "x", "\r\n" * 50, "x" * 400 + "1" * 400]


@pytest.fixture(scope="module")
def path():
    pytest.importorskip("public_tokenizers")
    return vocabulary_path()


@pytest.fixture(scope="module")
def reference(path):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_and_round_trip(path, reference):
    t, rnd = tokenizer(path), random.Random(1)
    drawn = ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(160, 0x2FFF), rnd.randint(0x1F300, 0x1F6FF), 10, 32])) for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    for text in SPECIAL + drawn:
        ids = t.encode(text)
        assert ids == reference.encode_ordinary(text) and t.decode(ids) == text and "".join(pretokens(text)) == text


def test_alphabet_and_model():
    assert len(set(alphabet())) == 256 and not any(c.isspace() for c in alphabet())
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_proto=serialised_model({b"a": 0, b"b": 1, b"ab": 2, b"bb": 3}))
    assert m.encode("abb") == [2, 1] and m.encode("bb") == [3]


def test_column(spark, path, reference):
    rows = [(i, t, "x") for i, t in enumerate([*SPECIAL, None, None])] + [(0, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in encode_column(df, path).collect())
    assert got == sorted((i, reference.encode_ordinary(t or "")) for i, t, _ in rows)
    counts = sorted(tuple(r) for r in token_counts(df, path, ["doc_id"]).collect())
    assert counts == sorted((i, len(reference.encode_ordinary(t or ""))) for i, t, _ in rows)
    assert encode_column(df.limit(0), path).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test tables")
def test_test_tables(spark, path, reference):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in d.select("doc_id", "text").join(encode_column(d, path), "doc_id").collect():
        assert list(r["ids"]) == reference.encode_ordinary(r["text"] or "")
    assert encode_column(d, path).filter(F.col("ids").isNull()).count() == 0
