"""SimHash near-duplicates: 64-bit fingerprints linked by pigeonhole blocks.

A fingerprint is cut into four blocks of 16 bits. Two that differ in at most two
bits agree on two whole blocks at least, so they meet under one of the six pairs
of blocks; the Hamming distance is then verified. Only distinct fingerprints are
joined, so copies cost nothing. A bucket that is too large for pairs is split by
masks over the bits outside its key: two members within the distance agree under
the mask that hides their differing bits, and are linked through the smallest
member, which loses no connection and emits a fixed number of rows a member.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import few, stored, text_of
from quarry.llm.components import components
from quarry.llm.exact_dedup import keep_rows

BITS, BLOCK, DISTANCE = 64, 16, 2


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """SimHash of the ASCII-lower-cased text's word shingles, as a signed 64-bit number.

    bytes.lower and bytes.split do exactly what is asked: A-Z only, and words
    divided by spaces and the bytes 9 to 13.
    """
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    h, joined = xxhash.xxh64_intdigest, b" ".join(parts)
    if len(parts) <= words:
        return int(np.uint64(h(joined, seed)).view(np.int64))
    ends = (np.cumsum(np.fromiter(map(len, parts), "int64", len(parts)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends)]
    total, n = np.zeros(BITS, "int64"), len(parts) - words + 1
    for at in range(0, n, 65536):  # a very long text takes bounded memory
        some = np.array([h(joined[a:e], seed) for a, e in zip(starts[at : min(at + 65536, n)], ends[at + words - 1 : at + 65536 + words - 1], strict=False)], ">u8")
        total += np.unpackbits(some.view("u1").reshape(-1, 8), axis=1).sum(0, dtype="int64")
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, text_sha256) for every row of docs."""

    def run(batches):
        for b in batches:
            fp = [fingerprint(t, words, seed) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64()), b.column("sha")], ["doc_id", "fp", "text_sha256"])

    docs = docs.select("doc_id", text_of().alias("text"), F.sha2(text_of(), 256).alias("sha"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long, text_sha256 string")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _keys() -> list[tuple[int, int]]:
    """(number, mask) of each pair of blocks."""
    ones = (1 << BLOCK) - 1
    return [(k, _signed(ones << (i * BLOCK) | ones << (j * BLOCK))) for k, (i, j) in enumerate(combinations(range(BITS // BLOCK), 2))]


def links(fps: DataFrame, most: int = 256) -> DataFrame:
    """(u, v) between distinct fingerprints fps(fp), u < v: enough to connect all within the distance.

    Buckets of up to most members yield every link; larger ones a link from each
    member to the smallest that agrees under a mask.
    """
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in _keys()))).alias("b")).select("fp", "b.k", "b.key")
    sizes = keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    keyed = stored(keyed.join(sizes, ["k", "key"]), "buckets")
    small = keyed.where(F.col("size") <= most)
    a, b = small.select("k", "key", F.col("fp").alias("u")), small.select("k", "key", F.col("fp").alias("v"))
    near = a.join(b, ["k", "key"]).where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE)).select("u", "v")
    large = keyed.where(F.col("size") > most)
    if large.isEmpty():
        return near.distinct()
    everything = (1 << BITS) - 1
    masks = [(k, _signed(everything & ~sum(1 << x for x in hide))) for k, key in _keys() for hide in combinations([x for x in range(BITS) if not (key >> x) & 1], DISTANCE)]
    mask = fps.sparkSession.createDataFrame(masks, "k int, mask long")  # 6 x 496 rows
    hidden = large.select("k", "fp").join(F.broadcast(mask), "k").select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("seen"))
    hubs = hidden.groupBy("mask", "seen").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hubs = hidden.join(hubs, ["mask", "seen"]).where("u < fp").select("u", F.col("fp").alias("v"))
    return near.unionByName(hubs).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id, text_sha256, root.

    docs needs doc_id and text; other columns are ignored. A null text is empty;
    texts without a word have fingerprint 0, which links like any other. Equal
    fingerprints always link. component_id is the smallest doc_id of the
    component; null ids are ignored for it, unless there is no other. root is the
    smallest fingerprint of the component, which names it also where ids repeat or
    are null. Repeated rows give repeated results, an empty table none.
    """
    fps = stored(fingerprints(docs, words, seed), "fingerprints")
    reps = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "representatives")
    roots = components(links(reps.select("fp")))
    classes = stored(reps.join(roots, reps["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "classes")
    least = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id", "root")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id", "text_sha256", "root")


def drop_near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, merge_ids: bool = True) -> DataFrame:
    """One row of docs for each component: that with its smallest doc_id.

    Of rows that repeat that doc_id one stays; a component of null ids keeps one.
    With merge_ids, components with the same smallest doc_id count as one;
    without, each keeps a row.
    """
    found = stored(near_duplicates(docs, words, seed).withColumn("name", F.when(F.lit(not merge_ids) | F.col("component_id").isNull(), F.col("root"))), "near-duplicates")
    chosen = F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.struct("doc_id", "text_sha256")))
    one = stored(found.groupBy("component_id", "name").agg(chosen.alias("one"), F.count(F.lit(1)).alias("size")), "components")
    several = few(one.where("size > 1").select(F.col("component_id").alias("c"), F.col("name").alias("m"), "one"))
    marks = found.join(several, found["component_id"].eqNullSafe(several["c"]) & found["name"].eqNullSafe(several["m"]), "left")
    kept = F.col("one").isNull() | (F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("text_sha256") == F.col("one.text_sha256")))
    return keep_rows(docs, marks.select("doc_id", kept.alias("kept")), one.select("one.*", F.lit(1).alias("n")))
