"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (decontaminate, exact_dedup, jaccard_join, phrases, pii, quality, sentencepiece_wfst, sharding, suffixes,
               super_minhash, token_alignment, token_files, toxicity)
from .common import prepare, table

#: Folder of the public tokenizers' files; None takes the installed package's.
TOKENIZERS: str | None = None

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    """Registers ``fn`` under its own name."""
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file(name: str, folder: str | None = None) -> bytes:
    """Content of a tokenizer's file, read on the driver and shipped with the tasks (a
    vocabulary is a few MB and does not grow with the data)."""
    import os
    import public_tokenizers
    folder = folder or TOKENIZERS
    path = os.path.join(folder, name) if folder else public_tokenizers.path(name)
    with open(path, "rb") as f:
        return f.read()


@query
def op1_sentencepiece_wfst(spark, sf_dir):
    prepare(spark)
    return sentencepiece_wfst.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query
def op2_interleaved_shards(spark, sf_dir):
    prepare(spark)
    return sharding.assign(table(spark, sf_dir, "documents"))


ORACLES["op2_interleaved_shards"] = sharding.ORACLE


@query
def op3_pfor_token_files(spark, sf_dir):
    prepare(spark)
    model = tokenizer_file("word_bpe_49k.json").decode("utf-8")
    return token_files.round_trip(table(spark, sf_dir, "documents"), model)


@query
def op4_exact_dedup_radix(spark, sf_dir):
    prepare(spark)
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


@query
def op10_ngram_jaccard(spark, sf_dir):
    prepare(spark)
    return jaccard_join.groups(table(spark, sf_dir, "documents"))


@query
def op5_spaced_seed_decontamination(spark, sf_dir):
    prepare(spark)
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_quality_embeddings(spark, sf_dir):
    prepare(spark)
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_pii_information(spark, sf_dir):
    prepare(spark)
    return pii.digests(table(spark, sf_dir, "documents"))


@query
def op8_sparse_suffix_dedup(spark, sf_dir):
    prepare(spark)
    return suffixes.repeats(table(spark, sf_dir, "documents"))


@query
def op9_toxicity_mil(spark, sf_dir):
    prepare(spark)
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_super_minhash(spark, sf_dir):
    prepare(spark)
    return super_minhash.groups(table(spark, sf_dir, "documents"))


@query
def op12_phrase_streams(spark, sf_dir):
    prepare(spark)
    return phrases.phrases(table(spark, sf_dir, "documents"))


ORACLES["op12_phrase_streams"] = phrases.ORACLE


@query
def op11_token_alignment(spark, sf_dir):
    prepare(spark)
    return token_alignment.alignments(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json").decode("utf-8"),
                                      tokenizer_file("piece_bpe_32k.model"))
