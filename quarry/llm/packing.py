"""Concatenate and cut: documents become one stream of token ids, cut into fixed windows.

Pass one tokenises each partition once, notes every document's place within its
partition and stores the ids. Prefix sums over the partitions' token totals give
each partition its place in the stream. Pass two adds the two and cuts at
multiples of the window: a document that crosses a boundary yields one record on
either side of it. Neither pass shuffles ids.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm.common import slices, stored, text_of

#: Texts of these characters only, without the special token, go through the faster library; others through the tokenizer itself.
_OTHER = re.compile("[^\t-\r -~À-ÖØ-öø-ɏ]|<\\|endoftext\\|>")
#: The byte-level split of the public tokenizers, written without backtracking.
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def _encoders(path: str):
    """(fast, exact) functions from a text to its ids, for a byte-level BPE in the tokenizers library's format."""
    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, pre = spec["model"]["vocab"], spec["pre_tokenizer"]
    if len(vocab) > 1 << 16 or pre["type"] != "ByteLevel" or spec["normalizer"] or pre["add_prefix_space"] or not pre["use_regex"]:
        raise ValueError("a byte-level BPE with at most 65,536 ids and without a normalizer is needed")
    # The format shows each of the 256 bytes as a printable character: those that are printable as themselves.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in special}
    fast = tiktoken.Encoding("fast", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return fast.encode_ordinary, lambda t: whole.encode(t, add_special_tokens=False).ids


def token_ids(text: str, path: str) -> bytes:
    """The ids of a text as little-endian 16-bit numbers."""
    fast, exact = _encoders(path)
    return np.array((exact if _OTHER.search(text) else fast)(text), "<u2").tobytes()


def tokenise(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(part, at, doc_id, n, ids): every document's ids and its place in its partition's stream."""

    def run(batches):
        end, at = np.array([end_id], "<u2").tobytes(), 0
        for whole in batches:
            for b in slices(whole):
                ids = [token_ids(t, tokenizer) + end for t in b.column("text").to_pylist()]
                n = np.array([len(x) // 2 for x in ids], "int64")
                yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(at + np.cumsum(n) - n), b.column("doc_id"), pa.array(n), pa.array(ids, pa.binary())], ["part", "at", "doc_id", "n", "ids"])
                at += int(n.sum())

    docs = docs.select("doc_id", text_of().alias("text"), F.spark_partition_id().alias("part"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"part int, at long, doc_id {kind}, n long, ids binary")


def _cut(placed: DataFrame, length: int, with_ids: bool) -> DataFrame:
    def run(batches):
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc, base, at, n, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "base", "at", "n", "ids")), strict=True):
                first, ids = base + at, np.frombuffer(raw, "<u2").astype("<u4")
                start = 0
                while start < n:
                    seq, offset = divmod(first + start, length)
                    took = min(length - offset, n - start)
                    piece = ids[start : start + took].tobytes()
                    for col, v in zip(out, (doc, start, took, zlib.crc32(piece), n, seq, offset, piece), strict=False):
                        col.append(v)
                    start += took
            yield pa.RecordBatch.from_arrays([pa.array(v, b.schema.field("doc_id").type if c == "doc_id" else pa.binary() if c == "ids" else pa.int64()) for c, v in zip(names, out, strict=True)], names)

    kind = placed.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: where it lies in it, and where in which sequence.

    docs needs doc_id and text; other columns are ignored. A null or empty text is
    the end id alone, so every row yields at least one piece; rows with equal or
    null doc_id are packed each for itself. An empty table gives no rows. Every
    sequence but the last is full; ids holds unsigned 32-bit little-endian ids.
    The driver sees one total per partition of the input, nothing per document.
    """
    spark = docs.sparkSession
    tokens = stored(tokenise(docs, tokenizer, end_id), "tokens")
    totals = sorted((r.part, r.total) for r in tokens.groupBy("part").agg(F.sum("n").alias("total")).collect())
    bases, base = [], 0
    for part, total in totals:
        bases.append((part, base))
        base += total
    where = spark.createDataFrame(bases, "part int, base long")
    # One row of 12 bytes per input partition: broadcast up to a million, joined beyond.
    where = F.broadcast(where) if len(bases) <= 1_000_000 else where
    return _cut(tokens.join(where, "part"), length, with_ids)


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids array<long>, spans): the packed sequences themselves, from pack(..., with_ids=True).

    Only the last can be short; it is padded to length unless it is a power of two.
    A group has at most length ids.
    """

    def unpack(batches):
        for b in batches:
            ids = [np.frombuffer(x, "<u4").astype("int64") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("sequence_id", "offset", "doc_id")] + [pa.array(ids, pa.list_(pa.int64()))], ["sequence_id", "offset", "doc_id", "ids"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    rows = pieces.select("sequence_id", "offset", "doc_id", "ids").mapInArrow(unpack, f"sequence_id long, offset long, doc_id {kind}, ids array<long>")
    one = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda p: p["ids"]))
    n = F.size(ids)
    short = (n < length) & (F.bit_count(n) != 1)
    return one.select(
        "sequence_id",
        n.alias("n_tokens"),
        F.when(short, F.concat(ids, F.array_repeat(F.lit(pad_id).cast("long"), F.lit(length) - n))).otherwise(ids).alias("ids"),
        F.transform("p", lambda p: F.struct(p["offset"].alias("offset"), F.size(p["ids"]).alias("length"), p["doc_id"].alias("doc_id"))).alias("spans"),
    )
