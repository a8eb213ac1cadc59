"""The registered operator queries against SQL or held-out labels, and the pipeline stage by stage, on the sample tables."""

import re
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from test_llm import slow_components, slow_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import registry
from quarry.llm.common import stored, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no sample tables")


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    df = registry.QUERIES[name](spark, SF).select(*names)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want.fetchall()))


def test_language_on_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in table(spark, sf, "documents").collect()}
    got = [r for r in registry.op8_language(spark, sf).collect() if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) / len(got) > 0.95


def test_pipeline(spark):
    docs, kept = table(spark, SF, "documents"), []
    kept.append({r.doc_id: r.text for r in docs.collect()})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), name)
        assert out.columns == table(spark, SF, "documents").columns
        docs = out
        kept.append({r.doc_id: r.text for r in docs.collect()})
    start, mild, unique, apart, clean = kept
    predicted = {r.doc_id for r in registry.op4_toxicity(spark, SF).collect() if r.predicted}
    assert set(mild) == set(start) - predicted
    last = {}
    for i, t in mild.items():
        last[t] = max(i, last.get(t, -1))
    assert set(unique) == set(last.values())
    rows = sorted((i, slow_fingerprint(t)) for i, t in unique.items())
    assert set(apart) == set(slow_components(rows, lambda a, b: (a ^ b).bit_count() <= 2))
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    items = [words(r.text) for r in table(spark, SF, "benchmark").collect()]
    held = defaultdict(float)
    for i, t in apart.items():
        w = words(t)
        there = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for item in items:
            windows = {tuple(item[k : k + 5]) for k in range(len(item) - 4)}
            held[i] = max(held[i], len(windows & there) / len(windows))
    assert {i for i in apart if held[i] > 0.9} <= set(apart) - set(clean) <= {i for i in apart if held[i] > 0.2}
    tokens = Tokenizer.from_file(registry.public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.packed(spark, docs, SF).collect()
    assert {r.doc_id: r.doc_tokens for r in pieces} == {i: len(tokens.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    assert max(r.sequence_id for r in pieces) == -(-sum(r.length for r in pieces) // 2048) - 1
