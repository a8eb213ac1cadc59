"""The training-data operators against brute force, on small tables with every awkward row."""

import hashlib
import io
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import chat, decontaminate, exact_dedup, language, packing, pii, simhash, suffix_dedup, toxicity, warc
from quarry.llm.common import trained_on
from quarry.llm.components import components

R = random.Random(5)
WORDS = [f"{a}{b}" for a in ("lo", "ren", "tas", "mi", "vor", "pel") for b in ("na", "sti", "co", "rum", "dal")]


def prose(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n))


PASSAGE = prose(60)
TEXTS = [
    (1, None), (2, ""), (3, "  \n"), (4, "Ä"), (5, prose(30)), (6, None), (7, "same text"), (8, "same text"), (9, "same text"), (9, "same text"),
    (10, prose(4000)), (11, prose(20) + PASSAGE + prose(25)), (12, prose(9) + PASSAGE), (None, "same text"), (None, "another text"), (13, "1" * 500), (14, "日本語 " * 40), (15, "x<|endoftext|>y  z"), (5, prose(31)),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(TEXTS, SCHEMA).repartition(3)
    for c in ("n", "name", "row", "kept", "fp", "score", "hash", "part", "g", "d", "t", "spans", "component_id", "lang", "label", "toxic"):
        df = df.withColumn(c, F.lit("extra"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return (x is not None, x if x is not None else 0)


# ---- exact dedup


def check_copies(df, blocks):
    got = sorted((key(r.doc_id), key(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(df, **blocks).collect())
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[t or ""].append(i)
    want, seen = [], set()
    for i, t in TEXTS:
        top = max(groups[t or ""], key=key)
        want.append((key(i), key(top), len(groups[t or ""]), i == top and (t or "", i) not in seen, hashlib.sha256((t or "").encode()).hexdigest()))
        if i == top:
            seen.add((t or "", i))
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in sorted(want)]
    assert sorted(g[4] for g in got if g[3]) == sorted(w[4] for w in want if w[3])


@pytest.mark.parametrize("blocks", [{}, {"block_bytes": 7}, {"block_bytes": 64, "digests": (lambda b: F.lit("c"), F.octet_length, F.md5)}])
def test_exact_duplicates(docs, blocks):
    check_copies(docs, blocks)


def test_drop_duplicates(docs, empty):
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted({t or "" for _, t in TEXTS})
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_duplicates(empty).count() == 0
    with pytest.raises(ValueError, match="digest"):
        exact_dedup.identities(docs, digests=(F.octet_length,))


# ---- SimHash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(rows, near):
    """rows: (id, value); near says whether two values link. Smallest id reachable, for each row."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near(rows[i][1], rows[j][1]):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    return [min((x for x in ids[find(i)] if x is not None), default=None) for i in range(len(rows))]


def test_simhash(docs, empty):
    rows = [(i, slow_fingerprint(t)) for i, t in TEXTS]
    want = sorted((key(i), f"{fp:016x}", key(c)) for (i, fp), c in zip(rows, slow_components(rows, lambda a, b: (a ^ b).bit_count() <= 2), strict=True))
    got = sorted((key(r.doc_id), f"{r.fp & (1 << 64) - 1:016x}", key(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({c if c[0] else (c, fp) for _, fp, c in want})


@pytest.mark.parametrize("most", [256, 2])
def test_links_connect_all_near_fingerprints(spark, most):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(4)]
    fps = {b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 3))) for b in base for _ in range(25)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), most)
    assert all(((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 2 for r in links.collect())
    roots = {r.node: r.root for r in components(links).collect()}
    want = slow_components([(x, x) for x in signed], lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert [roots.get(x, x) for x in signed] == want


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (100, 101)]
    R.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys((100, 101, 102), 100)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- packing


def test_packing(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, length=256, with_ids=True)
    rows = pieces.collect()
    ids = defaultdict(list)
    for i, x in TEXTS:
        ids[i].append(t.encode(x or "", add_special_tokens=False).ids + [1])
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        part = np.frombuffer(r.ids, "<u4").tolist()
        assert len(part) == r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.offset + r.length <= 256
        if r.start == 0:
            got[r.doc_id].append([])
        assert len(got[r.doc_id][-1]) == r.start
        got[r.doc_id][-1] += part
        if r.start + r.length == r.doc_tokens:
            assert len(got[r.doc_id][-1]) == r.doc_tokens
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in ids.items()}
    total = sum(r.length for r in rows)
    fill = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert sorted(fill) == list(range(-(-total // 256))) and all(fill[s] == 256 for s in range(len(fill) - 1))
    seqs = packing.sequences(pieces, 256).collect()
    assert all(len(s.ids) == 256 or s.n_tokens.bit_count() == 1 for s in seqs) and sum(s.n_tokens for s in seqs) == total
    assert packing.pack(empty, path).count() == 0


# ---- suffix dedup


def slow_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for b in data:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] += 1
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = 1
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), len(b) - len(kept), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("how", [{}, {"batches": 5, "most_contexts": 1}, {"length": 40, "k": 20}])
def test_suffix_dedup(docs, empty, how):
    want = sorted((key(i), *w) for (i, _), w in zip(TEXTS, slow_repeats([t for _, t in TEXTS], how.get("length", 200)), strict=True))
    got = sorted((key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.without_repeats(docs, **how).collect())
    assert got == want
    if not how:
        assert suffix_dedup.without_repeats(empty).count() == 0


def test_long_texts_are_read_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 1 << 20)
    r = random.Random(1)
    long = "".join(r.choice("abcdefgh ") for _ in range((1 << 20) + 5000))
    texts = [(1, long), (2, long[(1 << 20) - 400 : (1 << 20) + 300]), (3, "q" + long[10:300])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.without_repeats(spark.createDataFrame(texts, SCHEMA)).collect()}
    assert got == {1: (990, 2), 2: (700, 1), 3: (290, 1)}


# ---- personal data


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_spans(text, kind):
    out = []
    for m in re.finditer(PATTERNS[kind], text):
        d = re.sub("[^0-9]", "", m[0])
        if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
            out.append(m.span())
    return out


def test_base_spans():
    r = random.Random(2)
    texts = ["".join(r.choice("0123456789.+-() @ab") for _ in range(120)) for _ in range(1500)] + ["a@b.c@d.e f.g@h", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111x", "+1 (555) 010-9999"]
    for t in texts:
        assert pii.base_spans(t) == {k: slow_spans(t, k) for k in pii.KINDS}, t


def test_pii(spark, empty):
    rows = [(1, None), (1, None), (2, "mail a@b.org, call +49 (30) 1234-5678 or 0049 30 123 4567"), (3, "write anna [at] firma [dot] de"), (None, "clean words, 12 of them")]
    got = {(r.doc_id, r.n_email, r.n_phone): r for r in pii.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert pii.find(spark.createDataFrame(rows, SCHEMA)).count() == 5 and pii.find(empty).count() == 0
    two = got[2, 1, 1]
    assert two.base_sha256 == hashlib.sha256(b"email:5:12,phone:19:37").hexdigest()
    assert {"email:5:12", "phone:19:37", "phone:41:57"} == set(two.spans.split(","))
    assert got[3, 0, 0].spans == "email:6:30" and got[None, 0, 0].spans == ""


def test_field_on_fresh_sentences():
    r, w = random.Random(77), pii.trained()
    hit = wrong = missed = 0
    for _ in range(200):
        text, gold = pii._sentence(r)
        found, want = set(pii.all_spans(text, w)[1]), {(pii.KINDS.index(k), a, b) for k, a, b in gold}
        hit, wrong, missed = hit + len(found & want), wrong + len(found - want), missed + len(want - found)
    assert hit / (hit + wrong) > 0.9 and hit / (hit + missed) > 0.9


# ---- WARC


def test_warc(spark, tmp_path):
    rows = [(3, "u", "<p>a</p>"), (1, "http://x/\r\nWARC-Type: evil", "<p>a</p>"), (2, None, None), (5, "v", ""), (1, "w", "<p>a</p>"), (None, "n", "<p>a</p>"), (None, "n", "alone ü"), (9, "big", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("refers_to", F.lit(2))
    for size in (1, 32 << 20):
        folder = f"file://{tmp_path}/w{size}"
        paths = spark.createDataFrame(warc.write_archives(pages, folder, archive_bytes=size).collect(), "path string, records long")
        read = warc.read_archives(paths).where("record_type <> 'warcinfo'")
        read = read.withColumn("page", warc.page_of(F.col("record_id"))).withColumn("to", warc.page_of(F.col("refers_to")))
        got = [(r.page, r.payload_bytes, r.payload_digest, r.record_type, r.to, None if r.payload is None else r.payload.decode()) for r in read.collect()]
        want = []
        for i, _, h in rows:
            ids = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
            to = min(ids) if ids and i != min(ids) else None
            b = (h or "").encode()
            want.append((i, len(b), warc.digest(b), "response" if to is None else "revisit", to, h or "" if to is None else None))
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert warc.write_archives(pages.limit(0), folder).count() == 0


def test_warc_reader_validates():
    good = warc.page_record("<urn:page:1>", "u", b"<p>x</p>", None, "2026-01-01T00:00:00Z")
    data = warc.archive([good] * 30)
    assert [warc.parsed(r)["payload"] for r in warc.frames(io.BytesIO(data), 1 << 20)] == [b"<p>x</p>"] * 30
    plain = zstandard.ZstdCompressor().compress(good)
    raw = b"dictionary" * 9
    packed = zstandard.ZstdCompressor().compress(raw)
    compressed = struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)).compress(good)
    assert len(list(warc.frames(io.BytesIO(compressed), 1 << 20))) == 1
    for bad, what in ((plain, "dictionary"), (data[:-5], "within a frame"), (data[:10], "within its dictionary")):
        with pytest.raises(ValueError, match=what):
            list(warc.frames(io.BytesIO(bad), 1 << 20))
    with pytest.raises(ValueError, match="more than"):
        list(warc.frames(io.BytesIO(data), 100))
    for a, b, what in ((b"WARC/1.1", b"WARC/9", "not a WARC"), (b"WARC-Date", b"X-Date", "missing"), (b"<p>x", b"<p>xy", "as long"), (b"<p>x</p>", b"<p>y</p>", "digest")):
        with pytest.raises(ValueError, match=what):
            warc.parsed(good.replace(a, b))


# ---- chat


def test_chat(spark):
    r = random.Random(4)
    marks = ["</s>", "<s>", "[INST]", "[/INST]", "<|", "|>", "\\", "\\1", "<<SYS>>", "<</SYS>>", "\n", "<|a|>\n", "", "word ", "ä日 "]
    turns = []
    for conv in range(40):
        if r.random() < 0.5:
            turns.append((conv, 0, "system", prose(r.randint(0, 40), r)))
        turns += [(conv, t, r.choice(("user", "assistant", "<|odd|>")), "".join(r.choice(marks) for _ in range(r.randint(0, 9))) + prose(r.choice((0, 3, 50, 200)), r)) for t in range(1, r.randint(2, 25))]
    turns += [(None, None, None, None), (None, 1, "assistant", None), (7, 1, "user", "tie"), (7, 1, "user", "tie")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(0)).withColumn("window", F.lit("x")).withColumn("pos", F.lit("y"))
    made = chat.windows(df, budget=200, history=60)
    by = defaultdict(list)
    for c, t, role, x in turns:
        by[c].append((t is not None, t or 0, role or "", x or ""))
    for row in chat.digests(made).collect():
        said = sorted(by[row.conv_id])
        loss = "".join(x for _, _, role, x in said if role == "assistant")
        assert (row.n_turns, row.loss_chars) == (len(said), len(loss))
        assert row.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, _, role, x in said).encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    windows = made.collect()
    assert {w.conv_id for w in windows} == set(by)
    assert sum(w.n_repeated > 0 for w in windows) > 20
    for w in windows:
        parts = w.formatted.split(chat.END)[:-1]
        assert w.n_tokens <= 200 or len(parts) - w.n_repeated == 1
        said = sorted(by[w.conv_id])
        if said[0][2] == "system":
            assert parts[0].startswith("<|system|>")
        body = w.formatted
        for mark in ("[INST]", "[/INST]", "<s>", "<<SYS>>"):
            assert mark not in body
        assert body.count("</s>") == len(parts) == body.count("<|")
    assert chat.windows(df.limit(0)).count() == 0


# ---- toxicity


def test_segments_are_maximal():
    """Each segment is a maximal one by definition: no positive prefix or suffix missing, and all positives covered."""
    r = random.Random(8)
    for _ in range(300):
        s = [r.choice((-3, -2, -1, -1, 1, 2, 3)) for _ in range(r.randint(0, 30))]

        def slow(a, b, s=s):
            best = max(((sum(s[i:j]), i - j, -i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] <= 0:
                return []
            i, j = -best[2], best[3]
            return [*slow(a, i), (i, j, best[0]), *slow(j, b)]

        assert toxicity.maximal_segments(s) == slow(0, len(s))


def test_toxicity(spark, empty):
    r = random.Random(6)
    bad = ["scumbag", "moronic", "trashy"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = prose(r.randint(10, 60), r)
        if toxic:
            words = text.split()
            words[3:3] = [r.choice(bad) for _ in range(3)]
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, int(toxic)))
    rows += [(None, None), (1000, ""), (1000, ""), (1001, "scumbag MORONIC Trashy")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("toxic", F.lit(3)).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([*labels, (None, 1), (3, None), (5, 7)], "doc_id long, toxic int").withColumn("text", F.lit("no input"))
    got = {r.doc_id: r for r in toxicity.score(docs, labels, trained_on).collect()}
    assert len(got) == 603 and toxicity.score(docs, labels, trained_on).count() == 604
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == (i % 5 == 0) for i in held) / len(held) > 0.95
    assert got[1001].predicted == 1 and got[1000].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())
    p = got[1001].passages[0]
    assert (p.start, p.end) == (0, 22)
    assert {r.doc_id for r in toxicity.drop_toxic(docs, labels, trained_on).collect()} >= {None, 1000, 1, 2}
    assert toxicity.score(empty, labels, trained_on).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.limit(0), trained_on).collect()} == {0.0}


# ---- language


def test_forward_sums_all_segmentations():
    vocab, probs = {"▁": 1, "a": 2, "b": 3, "ab": 4, "▁a": 5, "ba": 6}, np.array([[0.01], [0.2], [0.1], [0.15], [0.2], [0.14], [0.2]])

    def slow(s):
        if not s:
            return 1.0
        out = sum(probs[vocab[s[:k]], 0] * slow(s[k:]) for k in range(1, len(s) + 1) if s[:k] in vocab)
        return out + (0 if s[0] in vocab else probs[0, 0] * slow(s[1:]))

    words = ["▁abab", "▁b", "▁xaba", "▁"]
    assert np.allclose(np.exp(language.log_probs(words, vocab, probs))[:, 0], [slow(w) for w in words])
    counts = language.expected_counts(["▁ab"], np.array([2.0]), vocab, probs[:, 0])
    ways = {(1, 2, 3): 0.2 * 0.1 * 0.15, (1, 4): 0.2 * 0.2, (5, 3): 0.14 * 0.15}
    assert np.isclose(counts[4], 2 * ways[1, 4] / sum(ways.values())) and np.isclose(counts[3], 2 * (ways[1, 2, 3] + ways[5, 3]) / sum(ways.values()))


def test_language(spark, empty):
    r = random.Random(9)
    syllables = {"xx": ["the", "ing", "and", "ly"], "yy": ["que", "ment", "eau", "les"], "zz": ["keit", "sch", "ung", "der"]}
    text = lambda k: " ".join("".join(r.choice(syllables[k]) for _ in range(r.randint(1, 3))) for _ in range(20))
    train = [(i, k, text(k)) for i, k in enumerate(list(syllables) * 60)] + [(999, None, "the"), (998, "xx", None)]
    test = [(i, k, text(k)) for i, k in enumerate(list(syllables) * 20)]
    path = public_tokenizers.path("piece_bpe_32k.model")
    train = spark.createDataFrame(train, "doc_id long, lang string, text string")
    docs = spark.createDataFrame([(i, t) for i, _, t in test] + [(500, None), (501, "12 !?"), (501, "12 !?"), (None, "ß" * 100)], SCHEMA)
    got = {r.doc_id: r for r in language.identify(docs, train, path).collect()}
    assert sum(got[i].lang_pred == k for i, k, _ in test) >= 58
    assert (got[500].lang_pred, got[500].score, got[501].lang_pred) == ("und", 0.0, "und") and got[None].lang_pred in syllables
    assert language.identify(empty, train, path).count() == 0
    assert {r.lang_pred for r in language.identify(docs, train.limit(0), path).collect()} == {"und"}


# ---- decontamination


ITEM = "Today Tom has 5 apples and Tom gives 2 apples to Mary. How many apples does Tom have after walking 3 km with the heavy basket?"


def test_decontamination(spark, empty):
    item2 = prose(30)
    bench = [(1, ITEM), (2, item2), (3, None), (4, ""), (5, "short one"), (None, "nobody " * 20), (1, ITEM)]
    copy = ITEM.replace("Tom", "Ann").replace("Mary", "Bob").replace("5", "7").replace("3 km", "9 miles")
    broken = copy.replace("does Ann have", "does Zoe have").replace("Ann gives", "Eve gives")
    cases = {
        10: ("Intro words here. " + ITEM + " And more.", [1]),
        11: ("Some other start.\n" + copy, [1]),
        12: (prose(50) + " " + item2 + " " + prose(50), [2]),
        13: (" ".join(item2.split()[5:24]), [2]),
        14: (" ".join(item2.split()[5:12]), []),
        15: (prose(400), []),
        16: ("short one", [5]),
        17: ("a short one too", []),
        18: ("", []),
        19: (None, []),
    }
    docs = [(i, t) for i, (t, _) in cases.items()] + [(None, ITEM), (10, ITEM)]
    docs = spark.createDataFrame(docs, SCHEMA).withColumn("item_id", F.lit("x")).withColumn("hash", F.lit("y"))
    bench = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for most in (2_000_000, 0):
        found = defaultdict(set)
        for r in decontaminate.contaminated(docs, bench, most_broadcast=most).collect():
            found[r.doc_id].add(r.item_id)
        assert {i: sorted(found[i]) for i in cases} == {i: want for i, (_, want) in cases.items()}
    strict = spark.createDataFrame([(1, broken), (2, copy)], SCHEMA)
    cover = {r.doc_id: r.coverage for r in decontaminate.contaminated(strict, bench, share=0.1).collect()}
    assert cover[1] < cover[2]
    got = {(r.doc_id, r.contaminated, r.item_id) for r in decontaminate.verdicts(docs, bench).collect()}
    assert (10, True, 1) in got and (None, False, None) in got and decontaminate.verdicts(docs, bench).count() == 12
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {None, 14, 15, 17, 18, 19}
    assert decontaminate.verdicts(empty, bench).count() == 0 and not decontaminate.verdicts(docs, bench.limit(0)).where("contaminated").count()


def held(spark, docs, bench):
    rows = decontaminate.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(bench, "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id): r.coverage for r in rows}


def test_decontamination_votes_by_occurrence(spark):
    item = "Today Tom has 5 red apples and Tom gives Mary 2 of them. How many of 5 apples does Tom have left when 2 are with Mary?"
    swap = lambda **to: re.sub(r"Tom|Mary|\b[52]\b", lambda m: to.get({"5": "five", "2": "two"}.get(m[0], m[0]), m[0]), item)
    one, two = swap(Tom="Al", five="9", Mary="Zoe", two="1"), swap(Tom="Zed", five="7", Mary="Ann", two="4")
    # A generic window of the item, often and with another filler.
    long = prose(300) + "\n" + item + "\n" + "\n".join("how many of 77 apples does Wim have left when 88 are with Eve " + prose(5) for _ in range(30))
    docs = [(1, item + "\n" + one), (2, one + "\n" + two), (3, long), (4, one), (5, prose(200))]
    got = held(spark, docs, [(1, item)])
    assert got == dict.fromkeys([(1, 1), (2, 1), (3, 1), (4, 1)], 1.0)


def test_decontamination_of_repetitive_items(spark):
    sums = " ".join(f"Add {i} and {i + 1}." for i in range(3, 21, 2))
    bench = [(1, sums), (2, "buffalo " * 20)]
    docs = [(1, prose(20) + ".\n" + sums), (2, prose(20) + " " + "buffalo " * 20), (3, "Add 3 and 4."), (4, "buffalo " * 6), (5, prose(80))]
    got = held(spark, docs, bench)
    assert {k for k in got if k[0] in (1, 2, 3, 5)} == {(1, 1), (2, 2)}


def test_decontamination_of_items_without_template_windows(spark):
    items = {
        1: "12 15 18 21 24 27 30 33",
        2: "Anna Bertha Carla Dora Emil Frida Gustav",
        3: "WHICH PLANET IS THE LARGEST OF ALL",
        4: "小明有五个苹果，他给了小红两个，请问他还剩几个？",
        5: "How many moons does that planet have?",
        6: "มีแอปเปิ้ลห้าผลให้ไปสองผลเหลือกี่ผล",
    }
    around = {1: "see {} there", 2: "met {} there", 3: "say: {} now", 4: "前文题目{}以后", 5: "Q: {} 63", 6: "ข้อ{}ครับ"}
    docs = [(i, prose(20) + " " + around[i].format(t) + " " + prose(20)) for i, t in items.items()]
    docs += [(7, prose(9) + " (" + items[5].replace("planet", "comet") + ")"), (8, "Numbers 12 18 15 24 21 30 27 33 here"), (9, "Anna met Bertha and Carla"), (10, "小明有很多朋友")]
    assert held(spark, docs, list(items.items())) == dict.fromkeys([(i, i) for i in items], 1.0)
    # One more name after a colon: the wide template finds it, not the words.
    assert held(spark, [(1, "Q: How many coins does Ann have?")], [(1, "How many coins does Tom have?")]) == {(1, 1): 1.0}


# ---- rows that share an id or have none


def test_stages_tell_rows_apart(spark):
    texts = [prose(40) for _ in range(5)]
    docs = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (6, texts[4])], SCHEMA)
    kept = simhash.drop_near_duplicates(docs, merge_ids=False)
    assert sorted(r.text for r in kept.collect()) == sorted(texts)
    assert sorted(r.text for r in simhash.drop_near_duplicates(docs).where("doc_id is null").collect()) == sorted(texts[:2])
    bad = "scumbag moronic trashy"
    rows = [(i, prose(20) + (f" {bad} " + prose(5)) * (i % 5 == 0)) for i in range(300)]
    twins = [(1000, bad + " one"), (1000, texts[0]), (None, bad + " two"), (None, texts[1])]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    clean = toxicity.drop_toxic(spark.createDataFrame(rows + twins, SCHEMA), labels, trained_on)
    assert clean.columns == ["doc_id", "text"]
    assert sorted(r.text for r in clean.where("doc_id is null or doc_id = 1000").collect()) == sorted(texts[:2])
    bench = spark.createDataFrame([(1, texts[2])], "item_id long, text string")
    assert sorted(r.text for r in decontaminate.drop_contaminated(docs, bench).collect()) == sorted([*texts[:2], texts[1], *texts[3:]])
