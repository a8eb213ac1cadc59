"""Language identification by unigram pieces, summed over all segmentations.

The vocabulary is a public tokenizer's and fixed. For each language, expectation
maximisation learns the pieces' probabilities from words with their counts; a
forward pass then gives a word's probability as the sum over all ways to cut it
into pieces, and a text's is the product over its words.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices, stored, text_of

WORD = re.compile(r"[^\W\d_]+")
#: The vocabulary's mark of a word's start. Words of up to SHORT letters are summed together and as they are, longer ones each for itself and in logarithms.
START, SHORT = "▁", 30
#: Piece 0 is any single letter that the vocabulary lacks.
UNKNOWN = 0


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """All lower-case pieces of letters, numbered from 1."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    good = sorted({p for p in pieces if p == p.lower() and (p.removeprefix(START).isalpha() or p == START)})
    return {p: i for i, p in enumerate(good, 1)}


_matchers: list[tuple[dict, ahocorasick.Automaton]] = []


def _matcher(vocab: dict[str, int]) -> ahocorasick.Automaton:
    """Finds every piece in a text. Made once for a vocabulary."""
    for v, a in _matchers:
        if v is vocab:
            return a
    a = ahocorasick.Automaton()
    for p, i in vocab.items():
        a.add_word(p, (len(p), i))
    a.make_automaton()
    _matchers[:] = [*_matchers[-1:], (vocab, a)]
    return a


def lattice(words: list[str], vocab: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(end, length, word, piece) of every piece that stands in a word, sorted by end and length. Words start with START, so no piece spans two."""
    joined, sizes = "".join(words), np.array([len(w) for w in words])
    ends = np.cumsum(sizes)
    found = np.array([(e, k, p) for e, (k, p) in _matcher(vocab).iter(joined)], "int64").reshape(-1, 3)
    whole = np.arange(len(joined))
    missing = np.setdiff1d(whole, found[found[:, 1] == 1, 0], assume_unique=True)
    at = np.concatenate([found[:, 0], missing])
    k = np.concatenate([found[:, 1], np.ones(len(missing), "int64")])
    p = np.concatenate([found[:, 2], np.full(len(missing), UNKNOWN)])
    word = np.searchsorted(ends, at, "right")
    end = at - (ends - sizes)[word] + 1
    order = np.lexsort((k, end))
    return end[order], k[order], word[order], p[order]


def _steps(end: np.ndarray, k: np.ndarray, word: np.ndarray, piece: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """The lattice by (end, length): each word occurs once in a step."""
    cut = np.flatnonzero((np.diff(end) != 0) | (np.diff(k) != 0)) + 1
    starts = np.concatenate([[0], cut])
    return [(int(end[a]), int(k[a]), word[a:z], piece[a:z]) for a, z in zip(starts, [*cut, len(end)], strict=True)]


def _forward(steps, n: int, most: int, probs: np.ndarray) -> np.ndarray:
    """a[i, w, l]: the probability of the first i letters of word w in language l, over all segmentations."""
    a = np.zeros((most + 1, n, probs.shape[1]))
    a[0] = 1
    for i, k, w, p in steps:
        a[i, w] += a[i - k, w] * probs[p]
    return a


def _long_forward(word: str, vocab: dict[str, int], logs: np.ndarray) -> tuple[np.ndarray, list]:
    """(log a[i, l], steps) of one word of any length."""
    steps = _steps(*lattice([word], vocab))
    a = np.full((len(word) + 1, logs.shape[1]), -np.inf)
    a[0] = 0
    for i, k, _, p in steps:
        a[i] = np.logaddexp(a[i], a[i - k] + logs[p[0]])
    return a, steps


def _groups(words: list[str]):
    """Numbers of short words, in groups of similar length, and those of long ones."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    short = [i for i in order if len(words[i]) <= SHORT]
    return [short[at : at + 4096] for at in range(0, len(short), 4096)], order[len(short) :]


def log_probs(words: list[str], vocab: dict[str, int], probs: np.ndarray) -> np.ndarray:
    """log P of each marked word in each language, summed over all its segmentations."""
    out = np.empty((len(words), probs.shape[1]))
    groups, long = _groups(words)
    for some in groups:
        mine = [words[i] for i in some]
        a = _forward(_steps(*lattice(mine, vocab)), len(mine), len(mine[-1]), probs)
        out[some] = np.log(a[[len(w) for w in mine], np.arange(len(mine))])
    if long:
        logs = np.log(probs)
        for i in long:
            out[i] = _long_forward(words[i], vocab, logs)[0][-1]
    return out


def expected_counts(words: list[str], counts: np.ndarray, vocab: dict[str, int], probs: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, over all segmentations of counted marked words under one language's probs."""
    out = np.zeros(len(probs))
    groups, long = _groups(words)
    for some in groups:
        mine = [words[i] for i in some]
        lengths = np.array([len(w) for w in mine])
        steps = _steps(*lattice(mine, vocab))
        a = _forward(steps, len(mine), len(mine[-1]), probs[:, None])[:, :, 0]
        b = np.zeros_like(a)
        b[lengths, np.arange(len(mine))] = 1
        for i, k, w, p in reversed(steps):
            b[i - k, w] += b[i, w] * probs[p]
        share = counts[some] / a[lengths, np.arange(len(mine))]
        for i, k, w, p in steps:
            out += np.bincount(p, a[i - k, w] * probs[p] * b[i, w] * share[w], len(out))
    logs = np.log(probs)
    for j in long:
        a, steps = _long_forward(words[j], vocab, logs[:, None])
        b = np.full(len(a), -np.inf)
        b[-1] = 0
        for i, k, _, p in reversed(steps):
            b[i - k] = np.logaddexp(b[i - k], b[i] + logs[p[0]])
        for i, k, _, p in steps:
            out[p[0]] += counts[j] * np.exp(a[i - k, 0] + logs[p[0]] + b[i] - a[-1, 0])
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over docs (lang, text); words are lower-cased and marked."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            rows = list(counts.items())
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0][0] for x in rows], pa.string()), pa.array([x[0][1] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.int64())], ["lang", "word", "n"])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                counts.update((lang, START + w) for w in WORD.findall(text.lower()))
                if len(counts) > 200_000:
                    yield out()
        yield out()

    return docs.select("lang", text_of().alias("text")).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, path: str, most_docs: int = 2000, rounds: int = 3) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities [piece, language]) learned from docs (doc_id, lang, text).

    For each language, about most_docs rows chosen by a hash of doc_id are used,
    whole; that bounds the fitting. Each round's expectations are computed in
    tasks, and no more than one number per piece and language comes back.
    """
    known = docs.where(F.col("lang").isNotNull())
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    vocab = vocabulary(path)
    if not langs:
        return [], np.ones((len(vocab) + 1, 0))
    share = F.create_map(*(F.lit(x) for lang in langs for x in (lang, min(1.0, most_docs / sizes[lang]))))
    some = known.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    counts = stored(word_counts(some), "words")
    probs = np.full((len(vocab) + 1, len(langs)), 1 / (len(vocab) + 1))
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(probs)  # pieces x languages

        def expect(batches, shared=shared):
            p, v = shared.value, vocabulary(path)
            total = np.zeros_like(p)
            for b in batches:
                lang, word, n = b.column("lang").to_numpy(zero_copy_only=False), np.array(b.column("word").to_pylist(), object), b.column("n").to_numpy()
                for k, name in enumerate(langs):
                    at = np.flatnonzero(lang == name)
                    if len(at):
                        total[:, k] += expected_counts(list(word[at]), n[at].astype(float), v, p[:, k])
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype("int32")), pa.array(lang.astype("int32")), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        got = counts.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        new = np.zeros_like(probs)
        new[got["piece"], got["lang"]] = got["n"]
        shared.unpersist()
        # Smoothed towards what all languages share, and a little towards any piece.
        whole = new.sum(1, keepdims=True)
        new = new + 5 * whole / max(1.0, whole.sum()) * 100 + 0.01
        probs = new / new.sum(0)
    return langs, probs


def identify(docs: DataFrame, train: DataFrame, path: str, most_docs: int = 2000) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (0 to 1: the language's share of the probability).

    docs needs doc_id and text, train doc_id, lang and text; other columns are
    ignored. Whole texts and whole words are scored, however long. Texts that are null or have no letter are
    `und` with score 0, as are all if train names no language. Repeated rows give
    repeated results, ties go to the first language by name, empty tables give
    no rows.
    """
    langs, probs = fit(train, path, most_docs)
    shared = docs.sparkSession.sparkContext.broadcast(probs)

    def run(batches):
        p, v = shared.value, vocabulary(path)
        place: dict[str, int] = {}
        table = np.empty((0, len(langs)))
        for whole in batches:
            for b in slices(whole):
                texts = [[START + w for w in WORD.findall((t or "").lower())] for t in b.column("text").to_pylist()]
                new = list(set().union(*texts).difference(place))
                if len(place) + len(new) > 300_000:
                    place, table = {}, np.empty((0, len(langs)))
                    new = list(set().union(*texts))
                if new and langs:
                    place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
                    table = np.concatenate([table, log_probs(new, v, p)])
                pred, score = [], []
                for words in texts:
                    if not langs or not words:
                        pred.append("und")
                        score.append(0.0)
                        continue
                    total = table[[place[w] for w in words]].sum(0)
                    best = int(total.argmax())
                    pred.append(langs[best])
                    score.append(float(1 / np.exp(total - total[best]).sum()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
