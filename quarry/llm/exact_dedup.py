"""Exact duplicates by deterministic block naming, in DataFrame operations only.

Texts are cut into fixed-size blocks of bytes. The distinct blocks are sorted and
numbered, so equal blocks share an integer name and different ones never do.
Adjacent names are then paired and the distinct pairs numbered in the same way,
until one name stands for each document: equal names mean equal texts. A name is
a rank in the whole table's order, so it does not depend on partitions.

Text is shuffled once, by the distinct blocks, after duplicates have been dropped
on the map side. Blocks are ordered and found by a digest; that no two have the
same one is proved on the whole table of blocks, and a wider digest is taken
where it fails.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import few, stored, text_of

#: From the cheapest to the widest.
DIGESTS: tuple[Callable[[Column], Column], ...] = (lambda b: F.unhex(F.md5(b)), lambda b: F.unhex(F.sha2(b, 256)), lambda b: F.unhex(F.sha2(b, 512)))


def _n_blocks(text: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / size)).cast("int")


def _block(raw: Column, i: Column, size: int) -> Column:
    return F.substring(raw, i * size + 1, F.lit(size))


def _digests(digest, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda i: digest(_block(F.col("raw"), i, size)))


def _named(counted: DataFrame, key: str, hot_share: int = 256, hot_least: int = 10_000) -> tuple[DataFrame, int | None]:
    """(key, name) of counted (key, n), and the n beyond which a key is hot, if there is such a key.

    name is the key's rank over the whole table. The driver sees three numbers a
    partition. Hot keys are those of more than one in hot_share of all rows, so
    there are at most as many.
    """
    placed = counted.repartitionByRange(key).sortWithinPartitions(key)
    placed = stored(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "names")
    bases, base, total, most = [], 0, 0, 0
    for r in sorted(placed.groupBy("part").agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).collect()):
        bases.append((r[0], base))
        base, total, most = base + r[1], total + r[2], max(most, r[3])
    values = ", ".join(f"({part}, {base}L)" for part, base in bases or [(0, 0)])
    where = F.broadcast(placed.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t (part, base)"))  # a row of 12 bytes for each partition
    hot = max(hot_least, total // hot_share)
    return placed.join(where, "part").select(key, "n", (F.col("base") + F.col("at")).alias("name")), hot if most > hot else None


def _looked_up(rows: DataFrame, names: tuple[DataFrame, int | None], key: str) -> DataFrame:
    """rows with their keys' names; hot keys are looked up by broadcast, so that none fills a task."""
    table, hot = names
    rest = table.select(key, "name")
    if hot is None:
        return rows.join(rest, key)
    few_hot = F.broadcast(stored(table.where(F.col("n") > hot).select(key, "name"), "hot"))
    return rows.join(few_hot, key).unionByName(rows.join(few_hot, key, "left_anti").join(rest, key))


def _block_names(raw: DataFrame, digest, size: int) -> tuple[DataFrame, int | None] | None:
    """_named over every distinct block's digest, or None if two blocks share one."""
    blocks = raw.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda i: _block(F.col("raw"), i, size))).alias("block"))
    counted = stored(blocks.groupBy(digest(F.col("block")).alias("digest"), "block").agg(F.count(F.lit(1)).alias("n")).select("digest", "n"), "blocks")
    return _named(counted, "digest") if counted.groupBy("digest").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty() else None


def identities(docs: DataFrame, block_bytes: int = 8192, digests: Sequence = DIGESTS) -> DataFrame:
    """(row, doc_id, text_sha256, level, name): rows have equal texts exactly if level and name are equal.

    row is a number given to each row of docs, so that repeated ids stay apart.
    level is the number of pairings, which the number of blocks decides.
    """
    raw = docs.select("doc_id", text_of().alias("text")).select("doc_id", "text", F.col("text").cast("binary").alias("raw"), _n_blocks(F.col("text"), block_bytes).alias("n_blocks"))
    for digest in digests:
        rows = raw.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.sha2("text", 256).alias("text_sha256"),
            "n_blocks",
            _digests(digest, block_bytes).alias("digests"),
        )
        rows, names = stored(rows, "rows"), _block_names(raw, digest, block_bytes)
        if names is not None:
            break
    else:
        raise ValueError("every digest given names two different blocks alike")
    most = rows.agg(F.max("n_blocks")).head()[0] or 1
    parts = rows.select("row", F.col("n_blocks").alias("n"), F.posexplode("digests").alias("pos", "digest"))
    now = _looked_up(parts, names, "digest").select("row", "n", "pos", "name")
    named, level = now.where("n = 1").select("row", F.lit(0).alias("level"), "name"), 0
    while most > 1:
        left = F.col("pos") % 2 == 0
        pairs = now.where("n > 1").groupBy("row", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.floor(F.col("pos") / 2).cast("int").alias("pos"))
        pairs = pairs.agg(F.max(F.when(left, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~left, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = stored(pairs.select("row", "n", "pos", F.struct("a", "b").alias("pair")), "pairs")
        names = _named(pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair")
        now, most, level = _looked_up(pairs, names, "pair").select("row", "n", "pos", "name"), -(-most // 2), level + 1
        named = named.unionByName(now.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
    return rows.select("row", "doc_id", "text_sha256").join(named, "row")


def exact_duplicates(docs: DataFrame, block_bytes: int = 8192, digests: Sequence = DIGESTS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    docs needs doc_id and text; other columns are ignored. A null text is an empty
    one, and texts are compared unchanged. Of rows with equal texts the one with
    the largest doc_id stays (a null is below any number); if that id is
    repeated, exactly one of its rows stays. An empty table gives no rows.
    """
    ids = stored(identities(docs, block_bytes, digests), "identities")
    groups = ids.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    # A row without a copy needs no partner; groups are few beside rows, and a large group is one row here.
    found = ids.join(few(stored(groups, "groups")), ["level", "name"], "left")
    alone = F.col("last").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("last.row"))).alias("kept"),
        "text_sha256",
    )


def keep_rows(docs: DataFrame, marks: DataFrame, allow: DataFrame) -> DataFrame:
    """Rows of docs as marks (doc_id, kept; one row for each of docs) says, where an id tells a row apart.

    Of ids that are repeated or null, the rows stay that allow (doc_id,
    text_sha256, n) names: n rows of that id and text. Texts stay where they are,
    unless the ids that go are too many to broadcast; only rows with repeated and
    null ids are shuffled.
    """
    marks = stored(marks.select(F.col("doc_id").alias("__keep_r"), "kept"), "marks")
    often = stored(marks.groupBy("__keep_r").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or __keep_r is null").select("__keep_r"), "repeated")
    gone = few(stored(marks.where("not kept").select("__keep_r").distinct(), "gone"), 64 << 20)
    if often.isEmpty():
        return docs.join(gone, docs["doc_id"] == gone["__keep_r"], "left_anti")
    allow = stored(allow.select(F.col("doc_id").alias("__keep_id"), F.col("text_sha256").alias("__keep_sha"), F.col("n").alias("__keep_n")), "allow")
    known = few(often, 64 << 20)
    kept = docs.join(known, docs["doc_id"].eqNullSafe(known["__keep_r"]), "left_anti").join(gone, docs["doc_id"] == gone["__keep_r"], "left_anti")
    some = docs.join(known, docs["doc_id"].eqNullSafe(known["__keep_r"]), "left_semi").withColumn("__keep_s", F.sha2(text_of(), 256))
    some = some.withColumn("__keep_k", F.row_number().over(Window.partitionBy("doc_id", "__keep_s").orderBy("__keep_s")))
    some = some.join(allow, some["doc_id"].eqNullSafe(allow["__keep_id"]) & (some["__keep_s"] == allow["__keep_sha"]) & (some["__keep_k"] <= allow["__keep_n"]), "left_semi")
    return kept.unionByName(some.drop("__keep_s", "__keep_k"))


def drop_duplicates(docs: DataFrame, block_bytes: int = 8192) -> DataFrame:
    """The rows of docs that exact_duplicates keeps, with docs' columns."""
    found = stored(exact_duplicates(docs, block_bytes), "duplicates")
    return keep_rows(docs, found, found.where("kept").select("doc_id", "text_sha256", F.lit(1).alias("n")))
