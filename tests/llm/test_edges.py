"""Every operator and stage on null, empty, repeated, very long and tied rows, with columns whose names clash, and on empty tables."""

import random
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import chat, decontaminate, exact_dedup, language, packing, pii, simhash, suffix_dedup, toxicity, warc
from quarry.llm.common import trained_on

R = random.Random(31)
prose = lambda n: " ".join(R.choice("lorem ipsum dolor sit amet quis nulla magna ut erat velit porta".split()) + R.choice("abcdefgh") for _ in range(n))
LONG = prose(30_000)
ITEM = "How many red apples does the farmer sell on the market if 12 of 30 are green and the rest are red?"
ROWS = [(1, None), (2, ""), (3, LONG), (3, LONG), (4, LONG + " x"), (None, None), (None, "only here"), (5, "mail a@b.org"), (5, "mail a@b.org"), (5, "another text"), (6, "Intro. " + ITEM), (7, prose(50))]
CLASH = ("n", "name", "row", "kept", "fp", "score", "hash", "part", "at", "g", "d", "t", "batch", "spans", "component_id", "label", "toxic", "predicted", "ids", "token", "scores", "_row", "best", "h", "shift", "window", "start", "root")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("lang", F.when(F.col("doc_id") < 5, "xx")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASH)).repartition(2)


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 8)] + [(None, None, None), (3, 1, None)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    benchmark = spark.createDataFrame([(1, ITEM), (2, None), (None, "x"), (3, "")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    return labels, benchmark


TOKENS, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PER_ROW = {
    "pii": lambda d, labels, bench: pii.find(d),
    "toxicity": lambda d, labels, bench: toxicity.score(d, labels, trained_on),
    "exact": lambda d, labels, bench: exact_dedup.exact_duplicates(d),
    "simhash": lambda d, labels, bench: simhash.near_duplicates(d),
    "language": lambda d, labels, bench: language.identify(d, d, PIECES),
    "suffix": lambda d, labels, bench: suffix_dedup.without_repeats(d),
    "decontaminate": lambda d, labels, bench: decontaminate.verdicts(d, bench),
}


@pytest.mark.parametrize("name", list(PER_ROW))
def test_a_row_for_every_row(docs, tables, name):
    got = PER_ROW[name](docs, *tables).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, _ in ROWS)
    assert PER_ROW[name](docs.limit(0), *tables).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    if name == "suffix":
        assert {r.n_bytes - r.n_removed for r in by[3]} == {0} and {r.n_removed for r in by[4]} == {len(LONG)}
    if name == "language":
        assert [r.lang_pred for r in by[1] + by[2]] == ["und", "und"] and by[3][0].lang_pred == "xx"
    if name == "decontaminate":
        assert [r.contaminated for r in by[6] + by[7]] == [True, False]
    if name == "pii":
        assert [r.n_email for r in sorted(by[5], key=lambda r: r.n_email)] == [0, 1, 1]


def test_pieces_and_archives(docs, spark, tmp_path):
    pieces = packing.pack(docs, TOKENS)
    assert pieces.where("start = 0").count() == len(ROWS) and packing.pack(docs.limit(0), TOKENS).count() == 0
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), *CLASH)
    paths = spark.createDataFrame(warc.write_archives(pages, f"file://{tmp_path}/w").collect(), "path string, records long")
    read = warc.read_archives(paths).where("record_type <> 'warcinfo'")
    assert read.count() == len(ROWS) and read.agg(F.max("payload_bytes")).head()[0] == len(LONG) + 2


def test_very_long_turns(spark):
    turns = spark.createDataFrame([(1, 1, "user", LONG), (1, 2, "assistant", LONG), (1, 3, None, None), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.windows(turns.withColumn("w", F.lit(1)).withColumn("t", F.lit(2)))).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[None].n_turns) == (3, len(LONG), 1)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(docs, tables, spark, tmp_path, name):
    labels, benchmark = tables
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    if name == "packing":
        assert sum(r.start == 0 for r in rows) == len(ROWS)
        return
    assert out.columns == docs.columns and Path(tmp_path).exists()
    ids = sorted((str(r.doc_id), (r.text or "")[:20]) for r in rows)
    if name == "exact_dedup":
        assert len(ids) == len({t or "" for _, t in ROWS})
    if name == "simhash":
        assert len(ids) == 7 and ("None", "only here") in ids and ("5", "another text") in ids
    if name == "decontamination":
        assert len(ids) == len(ROWS) - 1
