"""Toxic passages: maximum-scoring segments of token log-odds.

Tokens are scored by the log-odds between toxic and clean labelled texts under an
informative Dirichlet prior (Monroe et al., 2008), less a constant that makes clean
text drift down. One linear scan (Ruzzo and Tompa, 1999) finds every maximal
segment of a text; extreme-value statistics (Karlin and Altschul, 1990) say how
many such segments clean text of that length would hold by chance, and a logistic
curve over that calibrates the document's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import few, slices, stored, text_of

WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows of which the two-parameter calibration is fitted, at most (expected).
FIT_ROWS = 50_000


#: A word that is not itself significant is scored by its first letters, marked by an asterisk.
STEM = 5
#: Words that a task holds at once, in counting before it passes on what it has and in scoring before it looks up anew.
HELD = 50_000


@dataclass(frozen=True)
class Model:
    """table (token, odds): the words and stems that score; rest: the score of all others; lam: the scale of the extreme-value law.

    scores is table as a dictionary, or None if it is too large for one.
    """

    table: DataFrame
    scores: dict[str, float] | None
    drift: float
    lam: float


def score_of(word: str, scores: dict[str, float], drift: float) -> float:
    s = scores.get(word)
    return (scores.get(word[:STEM] + "*", 0.0) if s is None else s) - drift


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, t1, t0, d1, d0): occurrences of words and stems in docs (text, toxic) of either kind, and texts that hold them."""

    def run(batches):
        terms: dict[int, Counter] = {0: Counter(), 1: Counter()}
        texts: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def out():
            rows = [(w, k, n, texts[k][w]) for k, c in terms.items() for w, n in c.items()]
            for c in (*terms.values(), *texts.values()):
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["token", "toxic", "t", "d"])

        for b in (part for whole in batches for part in slices(whole)):
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                once = Counter(WORD.findall(text.lower()))
                stems = Counter()
                for w, n in once.items():
                    stems[w[:STEM] + "*"] += n
                for c in (once, stems):
                    terms[toxic].update(c)
                    texts[toxic].update(c.keys())
                if sum(map(len, terms.values())) > HELD:
                    yield out()
        yield out()

    some = docs.select(text_of().alias("text"), F.col("toxic").cast("int").alias("toxic"))
    n = lambda c, k: F.sum(F.when(F.col("toxic") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}")
    return some.mapInArrow(run, "token string, toxic int, t long, d long").groupBy("token").agg(n("t", 1), n("t", 0), n("d", 1), n("d", 0))


def _odds(y1, y0, n1, n0, size):
    """Log-odds and their deviation under a prior of size pseudo-counts, spread as both classes together spread theirs."""
    prior = F.lit(size / (n1 + n0)) * (y1 + y0)
    a, b = y1 + prior, y0 + prior
    odds = F.log(a / (F.lit(float(n1 + size)) - a + 1)) - F.log(b / (F.lit(float(n0 + size)) - b + 1))
    return odds, odds / F.sqrt(1 / a + 1 / b)


def token_model(docs: DataFrame, most_bytes: int = 64 << 20, drift: float = 0.1) -> Model | None:
    """Learned from all of docs (text, toxic 0 or 1); None without tokens of both kinds.

    Log-odds are computed for every word and stem. Those score whose frequency
    among texts lies further out than the largest of as many standard normal
    variables would; all others are neutral. The prior has as many pseudo-counts
    as the smaller class has counts. Up to most_bytes of scores are sent to the
    tasks; a larger table is joined instead, with equal results.
    """
    by = stored(token_counts(docs), "tokens")
    t1, t0, d1, d0, tokens = by.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("t1", "t0", "d1", "d0")), F.count(F.when(F.col("d1") + F.col("d0") >= 5, 1))).head()
    if not t1 or not t0:
        return None
    odds, _ = _odds(F.col("t1"), F.col("t0"), t1, t0, min(t1, t0))
    _, z = _odds(F.col("d1"), F.col("d0"), d1, d0, min(d1, d0))
    least_z = math.sqrt(2 * math.log(max(tokens, 1000)))
    table = stored(by.select("token", "t0", odds.alias("odds"), z.alias("z")).where(F.abs("z") >= least_z).select("token", "t0", "odds"), "scores")
    # lambda solves sum p exp(lambda s) = 1 over clean text's words, where the mean score is below zero. Words of a
    # significant stem count as the stem. Odds are binned by thousandths, which bounds what the driver sees.
    bins = table.groupBy(F.round("odds", 3).alias("s")).agg(F.sum(F.col("t0") + 0.5).alias("n"), F.sum(F.octet_length("token") + 100).alias("size")).collect()
    s = np.array([*(r.s for r in bins), 0.0]) - drift
    known = np.array([r.n for r in bins], float)
    p = np.append(known, max(1.0, t0 / 2 - known.sum()))
    p /= p.sum()
    high = 1.0
    if (s > 0).any():
        while (p * s).sum() >= 0:  # rare: let text drift down faster
            s, drift = s - 0.1, drift + 0.1
        low = 0.0
        with np.errstate(over="ignore"):
            while (p * np.exp(high * s)).sum() < 1:
                low, high = high, 2 * high
            for _ in range(60):
                mid = (low + high) / 2
                low, high = (mid, high) if (p * np.exp(mid * s)).sum() < 1 else (low, mid)
    table = table.select("token", "odds")
    small = sum(r.size for r in bins) <= most_bytes
    return Model(table, {r.token: r.odds for r in table.collect()} if small else None, drift, high)


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """(start, end, score) of every maximal scoring segment, in order and in linear time."""
    kept: list[list] = []  # start, end, sum before, sum after, index of the last with a smaller sum before
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total, -1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= new[3]:
                new[4] = j
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3], -1]
            del kept[j:]
    return [(a, b, y - x) for a, b, x, y, _ in kept]


def _found(text: str, get, drift: float) -> tuple[int, float | None, list[dict]]:
    """(words, the best segment's score, all maximal segments): of a text without a segment, its best word's score counts."""
    low = text.lower()
    low = low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    words = WORD.findall(low)
    scores = list(map(get, words))
    top = max(scores, default=None)
    got = maximal_segments(scores) if scores and top > 0 else []
    if not got:
        return len(words), top, []
    spans = [x.span() for x in WORD.finditer(low)]
    return len(words), max(s for _, _, s in got), [{"start": spans[i][0], "end": spans[j - 1][1], "score": s} for i, j, s in got]


def _with_scores(docs: DataFrame, table: DataFrame) -> DataFrame:
    """docs with scores map<token, odds>: those of table that its text has, by a join of its distinct words and stems."""
    rows = stored(docs.select(F.monotonically_increasing_id().alias("_row"), "*"), "rows")

    def run(batches):
        for b in batches:
            at, tokens = [], []
            for row, text in zip(b.column("_row").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = set(WORD.findall("".join(c.lower() if len(c.lower()) == 1 else c for c in text))) | set(WORD.findall(text.lower()))
                words |= {w[:STEM] + "*" for w in words}
                at += [row] * len(words)
                tokens += words
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(tokens, pa.string())], ["_row", "token"])

    held = rows.select("_row", "text").mapInArrow(run, "_row long, token string").join(table, "token")
    return rows.join(held.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("token", "odds"))).alias("scores")), "_row", "left").drop("_row")


def segments(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """Adds n_tokens, best (the best segment's score, null without words) and segments array<struct<start, end, score>> (code points) to docs' doc_id and keep (strings); one row per row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.scores, model.drift))  # bounded by token_model's most_bytes

    def run(batches):
        scores, drift = shared.value
        memory: dict[str, float] = {}

        def known(word):
            s = memory.get(word)
            if s is None:
                if len(memory) > HELD:
                    memory.clear()
                s = memory[word] = score_of(word, scores, drift)
            return s

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for b in (part for whole in batches for part in slices(whole)):
            texts = b.column("text").to_pylist()
            if scores is None:
                own = [dict(m or ()) for m in b.column("scores").to_pylist()]
                got = [_found(t, lambda w, m=m: score_of(w, m, drift), drift) for t, m in zip(texts, own, strict=True)]
            else:
                got = [_found(t, known, drift) for t in texts]
            n, best, found = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(best, pa.float64()), pa.array(found, kind)], ["doc_id", *keep, "n_tokens", "best", "segments"])

    docs = docs.select("doc_id", *keep, text_of().alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    if model.scores is None:
        docs = _with_scores(docs, model.table)
    return docs.mapInArrow(run, f"doc_id {id_type}, {''.join(f'{c} string, ' for c in keep)}n_tokens long, best double, segments array<struct<start: long, end: long, score: double>>")


def _evidence(model: Model, k: float):
    """-ln E of the best segment, -20 to 60: E is the number of its like that chance puts into clean text of this length."""
    e = F.col("best") * model.lam - F.log(F.lit(k)) - F.log(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))
    return F.when(F.col("best").isNull(), F.lit(-20.0)).otherwise(F.greatest(F.lit(-20.0), F.least(F.lit(60.0), e)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Intercept and slopes by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _rising(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and slopes of which none is negative: what would fall counts for nothing."""
    use, slopes = np.ones(x.shape[1], bool), np.zeros(x.shape[1])
    while len(x):
        a, *b = _logistic(x[:, use], y)
        if not use.any() or min(b) >= 0:
            slopes[use] = b
            return float(a), slopes
        use[np.flatnonzero(use)[int(np.argmin(b))]] = False
    return 0.0, slopes


def known_labels(labels: DataFrame, fold) -> DataFrame:
    """(doc_id, toxic): one 0 or 1 for each id that fold lets be learned from."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    return known.where(F.col("toxic").isin(0, 1) & fold(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def labelled(docs: DataFrame, labels: DataFrame, fold, most_broadcast: int = 32 << 20) -> DataFrame:
    """(doc_id, text, toxic) of docs with a 0 or 1 label that fold(doc_id) lets be learned from.

    An id with several labels counts as its largest. labels is broadcast up to
    most_broadcast bytes, and joined by shuffle beyond.
    """
    known = known_labels(labels, fold)
    return docs.select("doc_id", "text").join(few(known, most_broadcast), "doc_id")


def one_of_each(train: DataFrame) -> DataFrame:
    """train without further copies of a text with the same label, which would count as evidence anew. Only ids and hashes are shuffled."""
    train = train.withColumn("h", F.xxhash64("text"))
    keys = train.select("doc_id", "toxic", "h")
    copies = stored(keys.groupBy("h", "toxic").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    later = keys.join(few(copies), ["h", "toxic"]).where("doc_id <> first").select("doc_id", "h", "toxic").distinct()
    return train.join(few(stored(later, "later-copies")), ["doc_id", "h", "toxic"], "left_anti").select("doc_id", "text", "toxic")


def score(docs: DataFrame, labels: DataFrame, fold, significant: float = 0.01, keep: tuple[str, ...] = (), most_bytes: int = 64 << 20) -> DataFrame:
    """One row per row of docs: doc_id, keep (string columns of docs), score (0 to 1), predicted, n_tokens, passages.

    docs needs doc_id and text, labels doc_id and toxic; other columns are
    ignored. Only labels whose doc_id passes fold are learned from, and no label
    is an input of a score. passages lists the segments expected less than
    significant times by chance, with their E-values. A text without a segment is
    scored by its best word; empty and null texts get the lowest score. Very long
    texts are read whole, equal rows get equal results. The words' scores are
    broadcast up to most_bytes and joined beyond. Without labels of both kinds every
    score is 0. An empty table gives no rows.
    """
    train = labelled(docs, labels, fold)
    model = token_model(one_of_each(train), most_bytes)
    if model is None:
        return docs.select("doc_id", *keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0).cast("long").alias("n_tokens"), F.array().cast("array<struct<start: long, end: long, score: double, expected: double>>").alias("passages"))
    found = stored(segments(docs, model, *keep), "segments")
    known = stored(found.join(known_labels(labels, fold), "doc_id"), "labelled")
    # K from the mean of a Gumbel variable: of clean texts with a segment, lambda S - ln n is ln K + 0.5772 on average.
    mean, n = known.where((F.col("toxic") == 0) & (F.size("segments") > 0)).agg(F.avg(F.col("best") * model.lam - F.log(F.col("n_tokens").cast("double"))), F.count(F.lit(1))).head()
    k = math.exp(min(0.0, mean - 0.5772)) if n else 0.1
    found, known = found.withColumn("evidence", _evidence(model, k)), known.withColumn("evidence", _evidence(model, k))
    share = min(1.0, FIT_ROWS / max(1, known.count()))
    rows = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("evidence", "toxic", (F.size("segments") > 0).alias("some")).collect()
    x, y = np.array([r.evidence for r in rows], float), np.array([r.toxic for r in rows], float)
    some = np.array([r.some for r in rows], float)
    a, b = _rising(np.column_stack([x / 10, some]), y)
    odds = F.lit(float(a)) + F.lit(float(b[0])) * (F.col("evidence") / 10) + F.lit(float(b[1])) * (F.size("segments") > 0).cast("double")
    expected = lambda s: F.exp(-s["score"] * model.lam) * k * F.col("n_tokens")
    passages = F.filter(F.transform("segments", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), expected(s).alias("expected"))), lambda s: s["expected"] < significant)
    found = found.withColumn("score", 1 / (1 + F.exp(-odds)))
    return found.select("doc_id", *keep, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_tokens", passages.alias("passages"))


def drop_toxic(docs: DataFrame, labels: DataFrame, fold) -> DataFrame:
    """The rows of docs whose text is not predicted toxic, with docs' columns.

    The text decides, so rows without an id or with a repeated one are told
    apart, and equal texts share a verdict; null and empty texts stay unless
    empty labelled texts are toxic. An empty table gives no rows. Texts stay
    where they are, unless the digests of those that go are too many to broadcast.
    """
    rows = docs.withColumn("__toxic_sha", F.sha2(text_of(), 256))
    bad = score(rows, labels, fold, keep=("__toxic_sha",)).where("predicted = 1").select("__toxic_sha").distinct()
    return rows.join(few(stored(bad, "toxic"), 64 << 20), "__toxic_sha", "left_anti").select(*docs.columns)
