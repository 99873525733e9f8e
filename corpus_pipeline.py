"""A training-data pipeline over ``documents``: toxic documents, exact copies, near
copies and documents that hold benchmark passages go; the rest is tokenised.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of ``docs``.  Defined results: a table without rows stays
empty; repeated rows and rows whose doc_id is null or repeats are judged each on
their own; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabforge.llm import decontaminate, exact_dedup, jaccard_join, sentencepiece_wfst, toxicity
from tabforge.llm.common import filter_rows, materialise, prepare, table
from tabforge.llm.registry import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return filter_rows(docs, exact_dedup.dropped_ids)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return filter_rows(docs, jaccard_join.dropped_ids)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    items = table(spark, sf_dir, "benchmark")
    return filter_rows(docs, lambda d: decontaminate.contaminated_ids(d, items))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, ids, n_tokens, lossless."""
    prepare(spark)
    return sentencepiece_wfst.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenise),
]

#: Learned scores, shingle hashes and piece ids have no SQL form; tests/llm holds run()
#: against a brute-force version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
