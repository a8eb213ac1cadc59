"""Repeated passages by a logarithmic family of sparse suffix arrays.

Suffixes are sampled by content: of the k-byte strings in each window of the
wanted length, the one with the least hash is its anchor, so that equal windows
have equal anchors at equal places. An anchored suffix has a context, the bytes of
all windows it anchors. Contexts that are equal throughout are counted; where an
anchor stands in different contexts, a passage begins or ends, and these go
through the family: each batch's suffixes are sorted by their text, which makes its
suffix array, and merge-scanned against the array of every level for windows that
both have, byte by byte. Arrays of equal rank are then merged, so there are never
more than the logarithm of the number of batches.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices, stored, temporaries, text_of, unstored

#: Window starts that are handled at once; longer texts are read in overlapping stretches.
STRETCH = 1 << 20
_BASE, _LOW = 0x9E3779B97F4A7C15, np.uint64((1 << 24) - 1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2^64."""
    out = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, x, "u8")
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((31, 0x7FB5D329728EA185), (27, 0x81DADEF4BC2DD44D)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def anchors(data: bytes, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first, last) of each anchor: it anchors the windows that start at first to last."""
    n, wide = len(data), length - k + 1
    power, inverse = _powers(STRETCH + length)
    a = np.frombuffer(data, "u1").astype("u8") + np.uint64(1)
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(a * power[:n])])
    h = _mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])
    least, span = (h & ~_LOW) | np.arange(len(h), dtype="u8"), 1
    while span * 2 <= wide:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    starts = n - length + 1
    at = (np.minimum(least[:starts], least[wide - span : wide - span + starts]) & _LOW).astype("int64")
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return h[at[first]].view("int64"), at[first], first, np.concatenate([first[1:] - 1, [starts - 1]])


def suffixes(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(g, c, d, t, lo, hi, p) for every anchored suffix of docs (d, t, text): the anchor's hash, the context's digest of 128 bits, window starts lo to hi, anchor at p."""
    names = ["g", "c", "d", "t", "lo", "hi", "p"]

    def run(batches):
        for whole in batches:
            for b in slices(whole):
                out: list[list] = [[] for _ in names]
                for d, t, text in zip(b.column("d").to_pylist(), b.column("t").to_pylist(), b.column("text").to_pylist(), strict=True):
                    data = text.encode("utf-8", "replace")
                    for at in range(0, len(data) - length + 1, STRETCH):
                        part = data[at : at + STRETCH + length - 1]
                        g, p, lo, hi = anchors(part, length, k)
                        out[0] += g.tolist()
                        for x, a, z in zip(p.tolist(), lo.tolist(), hi.tolist(), strict=True):
                            out[1].append(hashlib.blake2b(part[a : z + length], digest_size=16, salt=(x - a).to_bytes(2, "little")).digest())
                        out[2] += [d] * len(p)
                        out[3] += [t] * len(p)
                        for col, v in zip(out[4:], (lo, hi, p), strict=True):
                            col += (v + at).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if c == "c" else pa.int64()) for c, v in zip(names, out, strict=True)], names)

    return docs.mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'c' else 'long'}" for c in names))


class SuffixArrays:
    """Levels (rank, array): arrays (g, right, left, n, d, t, p) of anchored suffixes, sorted by anchor and text within partitions.

    right is the text from the anchor on, left what stands before it in the
    suffix's windows, n how often the context occurs.
    """

    def __init__(self, length: int) -> None:
        self.length = length
        self.levels: list[tuple[int, DataFrame]] = []
        self.found: list[DataFrame] = []

    @staticmethod
    def _sorted(suffixes: DataFrame) -> DataFrame:
        return stored(suffixes.repartition("g").sortWithinPartitions("g", "right", "left"), "suffix-array")

    def add(self, batch: DataFrame) -> None:
        """Sort a batch, scan it against all levels (itself, if there is none), and merge arrays of equal rank."""
        new = self._sorted(batch)
        anchors = new.select("g").distinct()
        for _, level in self.levels:
            self.found.append(stored(_scanned(new.unionByName(level.join(anchors, "g", "left_semi")), self.length), "matches"))
        if not self.levels:
            self.found.append(stored(_scanned(new, self.length), "matches"))
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            merged = [self.levels.pop()[1], new]
            new = self._sorted(_all(merged))
            unstored(merged)
            rank += 1
        self.levels.append((rank, new))

    def matches(self) -> DataFrame:
        """(d, t, a, b): what the windows cover that different contexts share, for contexts that occur once."""
        return _all(self.found)


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _common(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def shared_windows(suffixes: list[tuple[bytes, bytes]], length: int) -> list[list[int]]:
    """Per suffix (right, left) of one anchor, sorted: how far before the anchor the windows start that another suffix has too.

    A window that starts x before the anchor is shared by suffixes that have
    length - x bytes in common after it, which is a run in sorted order, and x
    bytes before it.
    """
    shared: list[list[int]] = [[] for _ in suffixes]
    ahead = [0, *(_common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:], strict=False))]
    most = max(ahead)
    for x in range(max(0, length - most), min(length, sorted(len(left) for _, left in suffixes)[-2]) + 1):
        first: dict[bytes, int] = {}
        for i, (right, left) in enumerate(suffixes):
            if ahead[i] < length - x:
                first = {}
            if len(right) < length - x or len(left) < x:
                continue
            head = left[len(left) - x :]
            j = first.setdefault(head, i)
            if j != i:
                shared[i].append(x)
                if not shared[j] or shared[j][-1] != x:
                    shared[j].append(x)
    return shared


def _runs(starts: list[int], length: int) -> list[tuple[int, int]]:
    """The stretches that windows starting at sorted starts cover."""
    out: list[list[int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1][1] = s + length
        else:
            out.append([s, s + length])
    return [(a, b) for a, b in out]


_SPANS = ["d", "t", "a", "b"]


def _spans(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], _SPANS)


def _scanned(suffixes: DataFrame, length: int) -> DataFrame:
    """(d, t, a, b) of SuffixArrays.matches for the suffixes of some arrays. An anchor's suffixes are held at a time."""

    def group(rows):
        if len(rows) < 2:
            return []
        shared = shared_windows([(right, left) for right, left, *_ in rows], length)
        return [(d, t, a, b) for (_, _, n, d, t, p), xs in zip(rows, shared, strict=True) if n == 1 and xs for a, b in _runs(sorted(p - x for x in xs), length)]

    def run(batches):
        now, rows, done = None, [], []
        for b in batches:
            for g, *row in zip(*(b.column(c).to_pylist() for c in ("g", "right", "left", "n", "d", "t", "p")), strict=True):
                if g != now:
                    done += group(rows)
                    now, rows = g, []
                rows.append(row)
            if done:
                yield _spans(done)
                done = []
        yield _spans(done + group(rows))

    sorted_ = suffixes.repartition("g").sortWithinPartitions("g", "right", "left")
    return sorted_.select("g", "right", "left", "n", "d", "t", "p").mapInArrow(run, "d long, t long, a long, b long")


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(g, batch, n, m, d, t, p, left, right) for wanted (g, batch, n, m, d, t, lo, hi, p): the contexts' bytes, from their texts."""
    per = wanted.groupBy("d", "t").agg(F.collect_list(F.struct("g", "batch", "n", "m", "lo", "hi", "p")).alias("w"))
    names = ["g", "batch", "n", "m", "d", "t", "p", "left", "right"]

    def run(batches):
        for whole in batches:
            for b in slices(whole):
                out: list[list] = [[] for _ in names]
                for d, t, text, w in zip(*(b.column(c).to_pylist() for c in ("d", "t", "text", "w")), strict=True):
                    data = text.encode("utf-8", "replace")
                    for r in w:
                        for col, v in zip(out, (r["g"], r["batch"], r["n"], r["m"], d, t, r["p"], data[r["lo"] : r["p"]], data[r["p"] : r["hi"] + length]), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if i > 6 else pa.int64()) for i, v in enumerate(out)], names)

    return docs.join(per, ["d", "t"]).select("d", "t", "text", "w").mapInArrow(run, ", ".join(f"{c} {'binary' if i > 6 else 'long'}" for i, c in enumerate(names)))


def _by_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same as SuffixArrays finds, for anchors with very many contexts: one row per window, dealt by its digest."""
    names = ["g", "h", "c", "n", "d", "t", "s"]

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in names]
            for g, n, d, t, p, left, right in zip(*(b.column(i).to_pylist() for i in ("g", "n", "d", "t", "p", "left", "right")), strict=True):
                data, me = left + right, hashlib.blake2b(f"{d} {t} {p}".encode(), digest_size=16).digest()
                for j in range(len(data) - length + 1):
                    h = hashlib.blake2b(data[j : j + length], digest_size=16, salt=(len(left) - j).to_bytes(2, "little")).digest()
                    for col, v in zip(out, (g, h, me, n, d, t, p - len(left) + j), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if 0 < i < 3 else pa.int64()) for i, v in enumerate(out)], names)

    rows = stored(contexts.mapInArrow(run, "g long, h binary, c binary, n long, d long, t long, s long"), "windows")
    twice = rows.groupBy("g", "h").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("g", "h")
    return rows.where("n = 1").join(twice, ["g", "h"], "left_semi").select("d", "t", F.col("s").alias("a"), (F.col("s") + length).alias("b"))


def n_batches(docs: DataFrame, batch_bytes: int) -> int:
    """Two batches, and one more for each doubling of the texts beyond batch_bytes."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0
    return 2 + max(0, (size // batch_bytes).bit_length())


def covered(docs: DataFrame, length: int = 200, k: int = 100, batches: int | None = None, most_contexts: int = 4_000, batch_bytes: int = 256 << 20) -> DataFrame:
    """(d, t, a, b): stretches of bytes of docs (d, t, text) that windows occurring elsewhere cover.

    Only anchors that occur more than once are followed. Those with up to
    most_contexts different contexts go through the family, where a task holds an
    anchor's suffixes, some 300 bytes each; those with more are resolved by a
    shuffle of their windows.
    """
    spark = docs.sparkSession
    batches = batches or n_batches(docs, batch_bytes)
    with temporaries(spark):
        with temporaries(spark):
            found = stored(suffixes(docs, length, k), "suffixes")
            repeated = stored(found.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"), "repeated-anchors")
            found = stored(found.join(repeated, "g", "left_semi"), "repeated-suffixes", keep=1)
        groups = found.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "t", "lo", "hi", "p")).alias("r"))
        groups = stored(groups.select("g", "c", "n", "r.*"), "contexts", keep=1)
        several = groups.where("n > 1").select("g", "c")
        whole = stored(found.join(several, ["g", "c"], "left_semi").select("d", "t", F.col("lo").alias("a"), (F.col("hi") + length).alias("b")), "whole", keep=1)
    mixed = groups.join(groups.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "g").withColumn("batch", F.pmod(F.xxhash64("d", "t"), F.lit(batches)))
    contexts = stored(_contexts(docs, mixed, length), "context-bytes")
    arrays = SuffixArrays(length)
    for i in range(batches):
        arrays.add(contexts.where((F.col("batch") == i) & (F.col("m") <= most_contexts)).select("g", "right", "left", "n", "d", "t", "p"))
    spans = whole.unionByName(arrays.matches())
    many = contexts.where(F.col("m") > most_contexts)
    return spans if many.isEmpty() else spans.unionByName(_by_windows(many, length))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with d and t, which name a text; rows with equal ids and texts share them, and all that is found."""
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d"), F.xxhash64(text_of(), F.lit("text")).alias("t"), text_of().alias("text"))


def without_repeats(docs: DataFrame, length: int = 200, k: int = 100, batches: int | None = None, most_contexts: int = 4_000) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256, kept.

    Every byte goes that is covered by length bytes which also start anywhere else,
    in this text or another, as the input stands; copies of a text, repeated rows
    among them, take each other away. docs needs an integer doc_id and text; other
    columns are ignored. Null texts are empty; texts shorter than length stay as
    they are. kept is binary, for a cut can divide a character; spans are byte
    offsets, end exclusive. An empty table gives no rows.
    """
    rows = _keyed(docs)
    with temporaries(docs.sparkSession):
        spans = covered(rows, length, k, batches, most_contexts)
        spans = stored(spans.groupBy("d", "t").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans")), "spans", keep=1)

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.string(), pa.binary()]
        for whole in batches:
            for b in slices(whole):
                out: list[list] = [[] for _ in kinds]
                for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                    data, runs, kept, at = text.encode("utf-8", "replace"), [], [], 0
                    for s in spans or ():
                        if runs and s["a"] <= runs[-1]["b"]:
                            runs[-1]["b"] = max(runs[-1]["b"], s["b"])
                        else:
                            runs.append(dict(s))
                    for r in runs:
                        kept.append(data[at : r["a"]])
                        at = r["b"]
                    kept = b"".join([*kept, data[at:]])
                    for col, v in zip(out, (len(data), len(data) - len(kept), len(runs), runs, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(spans, ["d", "t"], "left").select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<a: long, b: long>>, kept_sha256 string, kept binary")
