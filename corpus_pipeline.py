"""A corpus pipeline of five stages, each of which works on what the one before kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), where
docs has the columns of documents, and returns a DataFrame with the same columns,
the last one the packing's. run() writes each stage's result and reads it again,
and removes what the stage stored besides. In every stage null texts are empty,
rows are told apart by id and text where ids repeat or are null, other columns
(whatever their names) go along unread, very long texts are read whole, and an
empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, exact_dedup, packing, simhash, toxicity
from quarry.llm.common import stored, table, temporaries, trained_on


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is predicted toxic go; the labels beside the corpus teach what toxic is. Equal texts share a verdict; an empty one is not toxic unless labels say so."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), trained_on)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, the one with the largest doc_id stays (a null is below any); of rows equal in both, one."""
    return exact_dedup.drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the row with the smallest doc_id stays; components are told apart by fingerprint, so equal or null ids do not merge them."""
    return simhash.drop_near_duplicates(docs, merge_ids=False)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, each by its own text; rows without an id stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as sequences of 2048 tokens, one row per piece of a document; rows with equal ids are packed each for itself."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", not_toxic),
    ("exact_dedup", without_copies),
    ("simhash", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: The scores, fingerprints and token ids of the stages are beyond SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    with temporaries(spark):
        for name, stage in STAGES[:-1]:
            with temporaries(spark):
                docs = stored(stage(spark, docs, sf_dir), name, keep=1)
        name, stage = STAGES[-1]
        return stored(stage(spark, docs, sf_dir), name, keep=1)
