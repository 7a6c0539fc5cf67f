import os

import pytest

from lectern.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.isdir(tokens.VOCABULARIES), reason="no vocabularies here")


def ids(spark, rows, **kw):
    got = tokens.encode(spark.createDataFrame(rows, "doc_id bigint, text string"), **kw).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids)) for r in got)


TEXTS = ["Hello world, it's <|endoftext|> here.", "", None, "a" * 3000, " " * 777 + "x", "word " * 900, "漢字かな交じり文。" * 300, "\n\n\t x  y\r\n" * 200, "x" * 150 + " " * 150 + "don't we'll " * 100, "é\u0301🙂👩\u200d👩\u200d👧 " * 150]


def expected(texts):
    enc = tokens.encoding()
    return [enc.encode_ordinary(t or "") for t in texts]


@pytest.mark.parametrize("chunk, overlap", [(100, 40), (64, 63), (1000, 10), (tokens.CHUNK, tokens.OVERLAP)])
def test_exact(spark, chunk, overlap):
    rows = list(enumerate(TEXTS))
    assert ids(spark, rows, chunk=chunk, overlap=overlap) == list(enumerate(expected(TEXTS)))


def test_library_agrees():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(tokens.VOCABULARIES, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    assert [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS] == expected(TEXTS)


def test_repeated_and_null_keys(spark):
    rows = [(1, "ab " * 200), (1, "ab " * 200), (None, "cd " * 200), (1, "ab " * 300), (None, None)]
    got = ids(spark, rows, chunk=100, overlap=40)
    assert len(got) == 5 and got[0][0] == -1 and sum(x == (1, expected(["ab " * 200])[0]) for x in got) == 2
    assert tokens.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df, chunk=100, overlap=40)).collect()}
    assert [back[i] for i in range(len(TEXTS))] == [t or "" for t in TEXTS]


def test_sizes(spark):
    rows = [(i, "s", t) for i, t in enumerate(TEXTS)] + [(None, "s", "two words"), (0, "s", "a text of the same id"), (0, "s", "a text of the same id")]
    got = sorted(r.tokens for r in tokens.sizes(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect())
    assert got == sorted(len(x) for x in expected([t for _, _, t in rows]))


@pytest.mark.parametrize("last", [tokens.OVERLAP + 1, 3000, tokens.CHUNK, tokens.CHUNK + 1])
def test_short_last_chunk_is_stitched(spark, last):
    text = ("Ordinary words, don't they? 12 of them. " * 1000)[: 2 * tokens.CHUNK + last]
    pieces = tokens.stitched_pieces(tokens.sliced(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))).collect()
    assert len(pieces) == 3 and all(p.is_stitched and p.begin is not None for p in pieces)
    assert ids(spark, [(1, text)]) == [(1, expected([text])[0])]


def test_long_texts_of_the_corpus_are_stitched(spark, data):
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet").where(f"length(text) > {tokens.CHUNK + tokens.OVERLAP}")
    found = tokens.stitched_pieces(tokens.sliced(docs)).groupBy("r").agg({"is_stitched": "min"}).collect()
    assert found and sum(not r[1] for r in found) < 0.01 * len(found) + 1
