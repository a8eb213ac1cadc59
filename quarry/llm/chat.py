"""Chat formatting with budgeted windows, in DataFrame operations only.

Prefix sums of the turns' token counts cut each conversation into spans of whole
turns. Every window starts with the system turn, repeats limited history, and
holds its span; the loss mask covers the assistant's text of the span, never a
repeated one. All of it is window functions over one shuffle by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template: a turn is OPEN role CLOSE text END.
OPEN, CLOSE, END = "<|", "|>\n", "</s>\n"
#: What a text or role must not hold as it is, and what stands for it; the first escapes the escape itself.
ESCAPES = (
    ("\\", "\\0"),
    ("<|", "\\1|"),
    ("<s>", "\\1s>"),
    ("</s>", "\\1/s>"),
    ("<<SYS>>", "\\1<SYS>>"),
    ("<</SYS>>", "\\1</SYS>>"),
    ("|>", "\\2>"),
    ("[INST]", "\\3INST]"),
    ("[/INST]", "\\3/INST]"),
)
_BACK = (("\\3", "["), ("\\2", "|"), ("\\1", "<"), ("\\0", "\\"))
#: Words, numbers and single other signs; a turn's marks count as four more.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x00-\x20]"
MARKS = 4


def escaped(text: Column) -> Column:
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescaped(text: Column) -> Column:
    for a, b in _BACK:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)) + MARKS


def _placed(turns: DataFrame, budget: int, history: int, system_role: str, tokens) -> DataFrame:
    """Adds pos, system, tokens, start (the prefix sum before the turn), room (for system and span) and window."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    whole = Window.partitionBy("conv_id").orderBy(*order)
    upto = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("pos", F.row_number().over(whole) - 1).withColumn("n", tokens(F.col("text")).cast("long"))
    rows = rows.withColumn("system", (F.col("pos") == 0) & (F.col("role") == system_role))
    own = F.when(F.col("system"), F.lit(0)).otherwise(F.col("n"))
    rows = rows.withColumn("kept", F.max(F.when(F.col("system"), F.col("n")).otherwise(F.lit(0))).over(upto)).withColumn("end", F.sum(own).over(upto))
    rows = rows.withColumn("start", F.col("end") - own).withColumn("stride", F.greatest(F.lit(1), F.lit(budget - history) - F.col("kept")))
    bucket = F.floor(F.col("start") / F.col("stride"))
    over = F.col("end") - (bucket + 1) * F.col("stride")
    # A turn that ends past its stretch joins it if history can yield the room; else it is a window of its own.
    span = F.struct(bucket.alias("k"), (over > history).alias("alone"))
    rows = rows.withColumn("span", F.when(~F.col("system"), span).otherwise(F.struct(F.lit(0).cast("long").alias("k"), F.lit(False).alias("alone"))))
    fresh = F.coalesce(F.col("span") != F.lag("span").over(whole), F.lit(False))
    return rows.withColumn("fresh", fresh.cast("int")).withColumn("window", F.sum("fresh").over(upto)).drop("fresh", "span", "stride", "end")


def windows(turns: DataFrame, budget: int = 1024, history: int = 256, system_role: str = "system", loss_role: str = "assistant", tokens=count_tokens) -> DataFrame:
    """One row per window: conv_id, window, n_repeated, n_tokens, formatted, loss array<struct<start, end>>.

    turns needs conv_id, turn, role, text; other columns are ignored. Turns are
    ordered by turn (nulls first), ties by role and text; repeated rows are
    repeated turns, null roles and texts are empty, turns with a null conv_id
    form one conversation. A system turn counts as such where it comes first.
    No window exceeds budget tokens, unless a single turn with the system turn
    does; turns are never cut. loss gives code points of formatted, end
    exclusive; n_repeated is the number of leading turns seen in earlier windows.
    """
    rows = _placed(turns, budget, history, system_role, tokens)
    near = Window.partitionBy("conv_id").orderBy("start").rangeBetween(0, history)
    rows = rows.withColumn("last", F.max("window").over(near)).withColumn("all", F.max("window").over(Window.partitionBy("conv_id")))
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(CLOSE))
    turn = F.struct("pos", "start", "n", "system", F.lit(None).cast("boolean").alias("fresh"), (F.col("role") == loss_role).alias("loss"), head.alias("head"), escaped(F.col("text")).alias("body"))
    rows = rows.select("conv_id", "kept", F.col("window").alias("own"), turn.alias("t"), F.explode(F.sequence(F.col("window"), F.when(F.col("system"), F.col("all")).otherwise(F.col("last")))).alias("window"))
    rows = rows.withColumn("t", F.col("t").withField("fresh", F.col("own") == F.col("window")))
    one = rows.groupBy("conv_id", "window").agg(F.first("kept").alias("kept"), F.array_sort(F.collect_list("t")).alias("t"))
    mine = F.filter("t", lambda t: t["fresh"] & ~t["system"])
    one = one.withColumn("new", F.aggregate(mine, F.lit(0).cast("long"), lambda a, t: a + t["n"])).withColumn("from", F.array_min(F.transform(mine, lambda t: t["start"])))
    room = F.least(F.lit(history), F.lit(budget) - F.col("kept") - F.col("new"))
    one = one.withColumn("room", room).withColumn("t", F.filter("t", lambda t: t["fresh"] | t["system"] | (F.col("from") - t["start"] <= F.col("room"))))
    size = F.transform("t", lambda t: F.length(t["head"]) + F.length(t["body"]) + len(END))
    one = one.withColumn("size", size)
    at = F.transform("t", lambda t, i: F.struct((F.aggregate(F.slice("size", F.lit(1), i), F.lit(0), lambda a, x: a + x) + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("n"), (t["fresh"] & t["loss"]).alias("loss")))
    return one.select(
        "conv_id",
        "window",
        F.size(F.filter("t", lambda t: ~t["fresh"])).alias("n_repeated"),
        F.aggregate("t", F.lit(0).cast("long"), lambda a, t: a + t["n"]).alias("n_tokens"),
        F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.transform(F.filter(at, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["n"]).alias("end"))).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns array<struct<role, text>> (those not repeated) and loss_text to windows, from formatted and loss alone."""
    piece = F.split("formatted", END)
    fresh = F.slice(piece, F.col("n_repeated") + 1, F.size(piece) - 1 - F.col("n_repeated"))
    # The opening mark goes first: with a role that starts with the rest of a closing mark it would look like one.
    both = F.transform(fresh, lambda p: F.split(F.substr(p, F.lit(len(OPEN) + 1)), r"\|>\n", 2))
    turns = F.transform(both, lambda p: F.struct(unescaped(p[0]).alias("role"), unescaped(p[1]).alias("text")))
    texts = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.withColumn("turns", turns).withColumn("loss_text", F.array_join(texts, ""))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows, as read back."""
    rows = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = rows.select("conv_id", F.struct("window", F.size("turns").cast("long").alias("n"), said.alias("said"), "loss_text", F.length("formatted").cast("long").alias("chars")).alias("w"))
    one = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    total = lambda name: F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + w[name])
    loss = F.array_join(F.transform("w", lambda w: w["loss_text"]), "")
    return one.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(F.array_join(F.transform("w", lambda w: w["said"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
        F.size("w").cast("long").alias("n_windows"),
    )
