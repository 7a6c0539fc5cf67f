"""Problem 6: token ids of the whole corpus by a public byte-level BPE vocabulary.

A text of up to ``CHUNK`` characters is encoded where it is read.  A longer one is sliced into chunks that overlap;
the chunks are pre-tokenised in parallel, each from its own first character, and neighbours are stitched at the first
pre-token boundary that both found in their overlap: from a common boundary on, a left-to-right pre-tokeniser goes on
alike.  The pieces between stitches are then encoded in parallel and put together in order.  Where two neighbours
have no common boundary (one huge pre-token), the whole text is encoded in one go, so the result is always exact.

Defined results: null and empty texts have an empty list; strings of special tokens are ordinary text; a repeated row
is repeated in the result; rows with a null id are kept.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import map_rows
from lectern.runtime import checkpointed, spread, worker_cache

#: Folder of the vocabulary files; a parameter of every function here.
VOCABULARIES = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: How the byte-level vocabularies split text before their merges; fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK, OVERLAP = 8192, 1024


def encoding(name: str = VOCABULARY, folder: str = VOCABULARIES):
    """The vocabulary, loaded once per worker."""
    cache = worker_cache()
    if (key := ("encoding", folder, name)) not in cache:
        import tiktoken

        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cache[key] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return cache[key]


def _lists(ids: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))))


def pretoken_ends(text: str) -> list[int]:
    cache = worker_cache()
    if "pretokens" not in cache:
        import regex

        cache["pretokens"] = regex.compile(PATTERN)
    return [m.end() for m in cache["pretokens"].finditer(text)]


def _slices(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                of = [batch.column(c).slice(i, 1) for c in ("doc_id", "r")]
                starts = list(range(0, max(len(text) - overlap, 1), chunk))
                for a in range(0, len(starts), 256):  # a few MB at a time
                    some = starts[a : a + 256]
                    rows = pa.array([text[s : s + chunk + overlap] for s in some], pa.string())
                    keys = [pa.concat_arrays([x] * len(some)) for x in of]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array([s // chunk for s in some], pa.int32()), rows], ["doc_id", "r", "k", "chunk"])

    return run


def sliced(docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id, r, k, chunk)`` of each row's text; ``r`` tells rows apart, also those of null and repeated ids."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("r"), "text")
    return rows.mapInArrow(_slices(chunk, overlap), "doc_id bigint, r bigint, k int, chunk string")


def _boundaries(chunk: int, overlap: int):
    """Of each chunk: boundaries in what it shares with the chunk before, and with the one after, both counted from the
    start of the text. The last two of a chunk may depend on what follows it, so they are no evidence."""

    def of_batch(batch: pa.RecordBatch) -> dict:
        ks, heads, tails = batch.column("k").to_pylist(), [], []
        for k, text in zip(ks, batch.column("chunk").to_pylist()):
            ends = pretoken_ends(text)
            heads.append([k * chunk + e for e in ends if e <= overlap][:256] if k else [])
            tails.append([k * chunk + e for e in ends[:-2] if e > chunk])
        return {"r": batch.column("r"), "k": ks, "head": heads, "tail": tails}

    return of_batch


def _encode_pieces(name: str, folder: str, chunk: int):
    def of_batch(batch: pa.RecordBatch) -> dict:
        enc = encoding(name, folder)
        ids = []
        for k, a, b, text in zip(*(batch.column(c).to_pylist() for c in ("k", "begin", "stop", "chunk"))):
            ids.append(enc.encode_ordinary(text[a - k * chunk : None if b is None else b - k * chunk]))
        return {"doc_id": batch.column("doc_id"), "r": batch.column("r"), "k": batch.column("k"), "ids": _lists(ids)}

    return of_batch


def _encode(name: str, folder: str):
    def of_batch(batch: pa.RecordBatch) -> dict:
        enc = encoding(name, folder)
        keys = {c: batch.column(c) for c in batch.schema.names if c != "text"}
        return {**keys, "ids": _lists([enc.encode_ordinary(t or "") for t in batch.column("text").to_pylist()])}

    return of_batch


def encode(docs: DataFrame, name: str = VOCABULARY, folder: str = VOCABULARIES, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id, ids)`` for each row of ``(doc_id, text)``."""
    docs = docs.select("doc_id", "text")
    is_long = F.coalesce(F.length("text") > chunk + overlap, F.lit(False))
    short = map_rows(spread(docs.where(~is_long)), _encode(name, folder), "doc_id bigint, ids array<int>")
    return short.unionByName(_encode_long(docs.where(is_long), name, folder, chunk, overlap))


def stitched_pieces(chunks: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(r, k, begin, stop, is_stitched)``: where the piece of each chunk begins and stops, counted from the text's start.

    A text with a joint that has no stitch is not stitched; its pieces mean nothing.
    """
    bounds = map_rows(chunks, _boundaries(chunk, overlap), "r bigint, k int, head array<bigint>, tail array<bigint>")
    in_text = Window.partitionBy("r").orderBy("k")
    joint = F.array_min(F.array_intersect("head", F.lag("tail").over(in_text)))
    begun = bounds.select("r", "k", F.when(F.col("k") == 0, F.lit(0).cast("bigint")).otherwise(joint).alias("begin"))
    stitches = begun.withColumn("stop", F.lead("begin").over(in_text))
    return stitches.withColumn("is_stitched", F.min(F.col("begin").isNotNull()).over(Window.partitionBy("r")))


def _encode_long(docs: DataFrame, name: str, folder: str, chunk: int, overlap: int) -> DataFrame:
    """Long texts are read once: their chunks are written, and all that follows is made of these."""
    chunks = checkpointed(sliced(docs, chunk, overlap).repartition("r", "k"))
    parts = chunks.join(stitched_pieces(chunks, chunk, overlap), ["r", "k"])
    encoded = map_rows(parts.where("is_stitched").drop("is_stitched"), _encode_pieces(name, folder, chunk), "doc_id bigint, r bigint, k int, ids array<int>")
    joined = encoded.groupBy("r", "doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    # Without a stitch somewhere, the text is put together again and encoded in one go.
    own = F.when(F.col("stop_k"), F.col("chunk")).otherwise(F.substring("chunk", 1, chunk))
    last = Window.partitionBy("r")
    apart = parts.where("NOT is_stitched").withColumn("stop_k", F.col("k") == F.max("k").over(last)).select("doc_id", "r", "k", own.alias("own"))
    texts = apart.groupBy("r", "doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "own"))).alias("parts"))
    whole = map_rows(texts.select("doc_id", F.array_join("parts.own", "").alias("text")), _encode(name, folder), "doc_id bigint, ids array<int>", rows=1)
    return joined.select("doc_id", F.flatten("parts.ids").alias("ids")).unionByName(whole)


def _counts(name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for batch in batches:
            sizes = [len(enc.encode_ordinary(t.as_py() or "")) for t in batch.column("text")]  # one text at a time
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64())], ["doc_id", "source", "tokens"])

    return run


def sizes(docs: DataFrame, name: str = VOCABULARY, folder: str = VOCABULARIES) -> DataFrame:
    """``(doc_id, source, tokens)`` for each row of ``(doc_id, source, text)``, also of null and repeated ids.

    A count has no order to keep, so each text is counted where it is read, in one scan.
    """
    return spread(docs.select("doc_id", "source", "text")).mapInArrow(_counts(name, folder), "doc_id bigint, source string, tokens bigint")


def decode(encoded: DataFrame, name: str = VOCABULARY, folder: str = VOCABULARIES) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``: the tokens' raw bytes joined, then read as UTF-8."""

    def of_batch(batch: pa.RecordBatch) -> dict:
        enc = encoding(name, folder)
        texts = [b"".join(map(enc.decode_single_token_bytes, ids or ())).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "text": texts}

    return map_rows(encoded.select("doc_id", "ids"), of_batch, "doc_id bigint, text string")
