"""Benchmark decontamination by templates, in DataFrame operations only.

Texts become templates: numbers, names and units turn into typed placeholders, all
else into lower-case words. Windows of a benchmark's templates are joined with the
documents' by hash, so a question whose numbers and names were exchanged still
meets its source. Whoever meets it is then checked in full: each slot of the
question must have one filler throughout an occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import few, stored, text_of

# How a text is read. MARK notes a sentence's first word, whose capital says nothing.
MARK = "\x01"
STARTS = r"(^|\n|[.!?]\s+)(\p{Lu})"
# A capital after any other mark (a bullet, quote, bracket or colon) may start a sentence as well.
WIDE_STARTS = r"(^\s*|\n\s*|[^\p{L}\p{M}\p{N}\s',-]\s*|\s-\s*)(\p{Lu})"
TOKEN = MARK + r"?\p{L}[\p{L}\p{M}']*|[0-9]+(?:[.,][0-9]+)*"
# Scripts without blanks between words: a literal token is one sign.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
LITERAL = rf"[{UNSPACED}]|[\p{{L}}&&[^{UNSPACED}]][\p{{L}}\p{{M}}'&&[^{UNSPACED}]]*|[0-9]+(?:[.,][0-9]+)*"
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds lb lbs ton tons "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur percent degree degrees celsius fahrenheit kmh mph watt watts volt volts joule joules"
).split()
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"


def _tokens(text: Column, starts: str = STARTS) -> Column:
    return F.regexp_extract_all(F.regexp_replace(text, starts, "$1" + MARK + "$2"), F.lit(TOKEN), F.lit(0))


def _canonical(tokens: Column) -> Column:
    """A template: the tokens with placeholders."""
    first = lambda t: F.substring(t, 1, 1)
    plain = F.transform(tokens, lambda t: F.when(first(t) == MARK, F.lower(F.substr(t, F.lit(2)))).when(first(t).between("0", "9"), NUMBER).when(F.lower(first(t)) != first(t), NAME).otherwise(t))
    return plain


def _with_units(plain: Column) -> Column:
    before = F.concat(F.array(F.lit("")), F.slice(plain, F.lit(1), F.greatest(F.size(plain) - 1, F.lit(0))))
    return F.zip_with(plain, F.slice(before, F.lit(1), F.size(plain)), lambda t, b: F.when(t.isin(UNITS) & (b == NUMBER), UNIT).otherwise(t))


def templates(docs: DataFrame, *keep: str, starts: str = STARTS) -> DataFrame:
    """keep, tokens (as written) and template of each text."""
    rows = docs.select(*keep, _tokens(text_of(), starts).alias("tokens"))
    rows = rows.withColumn("plain", _canonical(F.col("tokens")))
    return rows.withColumn("template", _with_units(F.col("plain"))).drop("plain")


def wide_templates(docs: DataFrame, *keep: str) -> DataFrame:
    """templates in which a capital after any mark may start a sentence."""
    return templates(docs, *keep, starts=WIDE_STARTS)


def literals(docs: DataFrame, *keep: str) -> DataFrame:
    """As templates, of lower-cased words and signs as they are; no placeholders."""
    rows = docs.select(*keep, F.regexp_extract_all(F.lower(text_of()), F.lit(LITERAL), F.lit(0)).alias("tokens"))
    return rows.withColumn("template", F.col("tokens"))


def _window_hashes(words: int) -> Column:
    """Hashes of all windows of column h (the template's word hashes); a shorter text is one window of its own length.

    Windows with fewer literal words than placeholders are null: they say nothing.
    """
    h, slot = F.col("h"), F.col("slot")
    at = lambda a, i, k: F.get(a, i + k)
    full = F.transform(
        F.sequence(F.lit(0), F.size(h) - words),
        lambda i: F.when(sum((at(slot, i, k) for k in range(1, words)), at(slot, i, 0)) * 2 < words, F.xxhash64(*(at(h, i, k) for k in range(words)))),
    )
    short = F.array(F.when(F.aggregate(slot, F.lit(0), lambda a, x: a + x) * 2 < F.size(h), F.xxhash64(F.lit("short"), F.col("h"))))
    return F.when(F.size(h) >= words, full).when(F.size(h) > 0, short).otherwise(F.array().cast("array<long>"))


def windows(rows: DataFrame, words: int, *keep: str) -> DataFrame:
    """keep and hashes (null for windows that do not count) of templates."""
    is_slot = lambda t: t.isin(NUMBER, NAME, UNIT).cast("int")
    rows = rows.select(*keep, F.transform("template", lambda t: F.xxhash64(t)).alias("h"), F.transform("template", is_slot).alias("slot"))
    return rows.select(*keep, _window_hashes(words).alias("hashes"))


def _slots(at: Column, words: int) -> Column:
    """The slots of the window at a position of tokens and template, as (kind, filler)."""
    filler = lambda t: F.lower(F.replace(t, F.lit(MARK), F.lit("")))
    every = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda k: F.struct(F.get("template", at + k).alias("kind"), filler(F.get("tokens", at + k)).alias("filler")))
    return F.filter(every, lambda x: x["kind"].isin(NUMBER, NAME, UNIT))


def _occurrences() -> Column:
    """The groups in which a match (shift, length of the item) votes: the document, its shift, and two bands of shifts.

    Copies of an item lie its length apart, so half-overlapping bands half as wide
    keep them apart, and hold one copy whole that has words put in or left out.
    """
    at = lambda scale, band: F.struct(F.lit(scale).alias("scale"), band.cast("long").alias("band"))
    band = F.floor(F.col("shift") / F.greatest(F.floor(F.col("length") / 4), F.lit(1)))
    return F.array(at(0, F.lit(0)), at(1, F.col("shift")), at(2, band), at(2, band - 1))


def _least_hashes(ks: Column, goal: Column) -> Column:
    """The fewest distinct hashes that can stand at goal positions; ks: how many positions each has, falling."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("j"))
    step = lambda a, k: F.when(a["at"] < goal, F.struct((a["at"] + k).alias("at"), (a["j"] + 1).alias("j"))).otherwise(a)
    return F.aggregate(ks, start, step, lambda a: a["j"])


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 5, share: float = 0.8, run: int = 9, most_broadcast: int = 64 << 20) -> DataFrame:
    """(doc_id, item_id, coverage, longest_run): the benchmark items that documents hold.

    An item is held where share of its windows of words template words stand in
    the document, or run of them one after the other (13 words), counting only
    windows whose slots agree: within an occurrence each number, name or unit of
    the item has one filler, the one most of its windows show. Occurrences are
    windows at one distance from the item's, at nearby distances, and all of the
    document's; the best one counts. docs needs doc_id and
    text, benchmark item_id and text; other columns are ignored, null texts are
    empty and match nothing, as do texts without words. Texts of fewer than words
    words match only as a whole. Tables that follow from the benchmark are broadcast
    up to most_broadcast bytes each, and joined by shuffle beyond. Rows with the same doc_id or item_id count as
    one; null ids have no row. The order of equal rows does not matter.

    Items that templates can miss though they are copied word for word are also
    looked for by literal windows, without placeholders, and by templates that
    take a capital after any mark for a sentence start: items of so few windows
    that losing one is too many, and those in scripts without blanks. The
    documents are read again for them only if there are any.
    """
    found, sizes = _held(docs, benchmark, templates, words, share, run, most_broadcast)
    most = F.coalesce(F.col("n"), F.lit(0))
    hard = stored(benchmark.where("item_id is not null").select("item_id", "text").join(sizes.select("item_id", "n"), "item_id", "left").where(text_of().rlike(f"[{UNSPACED}]") | (most - 1 < most * share - 1e-6)).select("item_id", "text"), "hard-items")
    if hard.isEmpty():
        return found
    for read in (literals, wide_templates):
        found = found.unionByName(_held(docs, hard, read, words, share, run, most_broadcast)[0])
    return found.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.max("longest_run").alias("longest_run"))


def _held(docs: DataFrame, benchmark: DataFrame, read, words: int, share: float, run: int, most_broadcast: int) -> tuple[DataFrame, DataFrame]:
    """contaminated by texts as read gives them, and (item_id, n, need) of the items that have windows."""
    # explode_outer: from explode, Spark infers a filter on the array and would compute all of it twice, lambdas within lambdas.
    items = stored(read(benchmark.where("item_id is not null"), "item_id"), "items")
    iw = windows(items, words, "item_id").select("item_id", F.posexplode_outer("hashes").alias("ipos", "hash")).where("hash is not null").distinct()
    iw = stored(iw, "item-windows")
    sizes = iw.groupBy("item_id").agg(F.countDistinct("ipos").alias("n"))
    repeats = iw.groupBy("item_id", "hash").agg(F.count(F.lit(1)).alias("k")).groupBy("item_id").agg(F.sort_array(F.collect_list("k"), asc=False).alias("ks"))
    sizes = stored(sizes.join(repeats, "item_id").select("item_id", "n", _least_hashes(F.col("ks"), F.least(F.ceil(F.col("n") * share - 1e-6), F.lit(run))).alias("need")), "sizes")
    wanted = few(iw.join(sizes, "item_id").groupBy("hash").agg(F.min("need").alias("need")), most_broadcast)
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    met = windows(read(docs, "doc_id"), words, "doc_id").select("doc_id", F.explode_outer("hashes").alias("hash"))
    met = met.where("hash is not null").join(wanted, "hash")
    suspects = stored(met.groupBy("doc_id").agg(F.countDistinct("hash").alias("n"), F.min("need").alias("need")).where("n >= need").select("doc_id"), "suspects")
    dw = _matches(read(docs.join(few(suspects, most_broadcast), "doc_id", "left_semi"), "doc_id"), iw, items, words, most_broadcast)
    dw = stored(dw, "matches")
    dw = dw.withColumn("shift", F.col("pos") - F.col("ipos")).withColumn("at", F.explode(_occurrences()))
    # The filler most windows of an occurrence show for each of the item's slots.
    key = ["doc_id", "item_id", "at"]
    seen = dw.select(*key, F.explode("pairs").alias("p")).select(*key, "p.kind", "p.slot", "p.filler")
    votes = seen.groupBy(*key, "kind", "slot", "filler").agg(F.count(F.lit(1)).alias("n"))
    chosen = votes.groupBy(*key, "kind", "slot").agg(F.max_by("filler", F.struct("n", "filler")).alias("filler"))
    chosen = chosen.groupBy(*key).agg(F.collect_set(F.struct("kind", "slot", "filler")).alias("chosen"))
    agreed = dw.join(chosen, key, "left").where(F.coalesce(F.size(F.array_except("pairs", "chosen")) == 0, F.lit(True)) | (F.size("pairs") == 0))
    covered = agreed.groupBy(*key).agg(F.countDistinct("ipos").alias("hit")).groupBy("doc_id", "item_id").agg(F.max("hit").alias("hit"))
    # Runs: windows one after the other in both texts keep pos - ipos, and within that ipos less their rank.
    line = agreed.select(*key, "shift", "ipos").distinct()
    line = line.withColumn("g", F.col("ipos") - F.row_number().over(Window.partitionBy(*key, "shift").orderBy("ipos")))
    runs = line.groupBy(*key, "shift", "g").agg(F.count(F.lit(1)).alias("k")).groupBy("doc_id", "item_id").agg(F.max("k").alias("longest_run"))
    found = covered.join(runs, ["doc_id", "item_id"]).join(few(sizes, most_broadcast), "item_id").withColumn("coverage", F.col("hit") / F.col("n"))
    return found.where((F.col("coverage") >= share) | (F.col("longest_run") >= run)).select("doc_id", "item_id", "coverage", "longest_run"), sizes


def _matches(rows: DataFrame, iw: DataFrame, items: DataFrame, words: int, most_broadcast: int) -> DataFrame:
    """(doc_id, item_id, pos, ipos, length, pairs) of the windows that suspects share with items.

    length: the item's words; pairs: what stands where the item has a slot.
    """
    hashed = windows(rows, words, "doc_id", "tokens", "template")
    cut = F.transform("hashes", lambda x, i: F.struct(x.alias("hash"), i.alias("pos"), _slots(i, words).alias("there")))
    pos = hashed.select("doc_id", F.explode_outer(F.filter(cut, lambda x: x["hash"].isNotNull())).alias("w")).select("doc_id", "w.*").where("hash is not null")
    slots = iw.join(items, "item_id").select("item_id", "ipos", "hash", F.size("tokens").alias("length"), _slots(F.col("ipos"), words).alias("slots"))
    both = pos.join(few(slots, most_broadcast), "hash")
    pairs = F.zip_with("slots", "there", lambda a, b: F.struct(a["kind"].alias("kind"), a["filler"].alias("slot"), b["filler"].alias("filler")))
    return both.select("doc_id", "item_id", "pos", "ipos", "length", pairs.alias("pairs"))


def verdicts(docs: DataFrame, benchmark: DataFrame, words: int = 5, share: float = 0.8) -> DataFrame:
    """One row per row of docs: doc_id, contaminated, n_items, item_id (the smallest), coverage (the largest)."""
    found = contaminated(docs, benchmark, words, share)
    found = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.min("item_id").alias("item_id"), F.max("coverage").alias("coverage"))
    rows = docs.select("doc_id").join(found, "doc_id", "left")
    return rows.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, each by its own text, with docs' columns; rows without an id stay.

    Null and empty texts hold nothing. Repeated rows share a verdict, an empty
    table gives no rows, an empty benchmark drops none.
    """
    rows = docs.withColumn("__held_sha", F.when(F.col("doc_id").isNotNull(), F.sha2(text_of(), 256)))
    held = contaminated(rows.select(F.col("__held_sha").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__held_sha")).distinct()
    return rows.join(few(stored(held, "held"), 64 << 20), "__held_sha", "left_anti").select(*docs.columns)
