"""A training-corpus pipeline out of five of the operators.

Each stage reads what the one before wrote and works on all of it.
"""

from __future__ import annotations

import functools
import threading

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from threadlake.llm import bpe, exact_dedup, minhash, mixing, toxicity
from threadlake.llm._common import new_path, noting, release

#: Tables that stages so far have written for themselves, by thread and folder; the next stage of that run removes them, as its input is what they led to.
_left: dict[tuple[int, str], list[str]] = {}


def _stage(f):
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left.setdefault((threading.get_ident(), sf_dir), [])
        release(spark, left)
        with noting(left):
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the labels of this folder.  A null or empty text is scored too; repeated rows are judged alike; an empty table stays empty; all columns stay."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id; null counts as empty, and all empty texts are one group."""
    return exact_dedup.keep_one(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one with the smallest id; documents without words all stay."""
    return minhash.keep_one(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document comes as often as it is drawn."""
    return mixing.rows(mixing.mix(docs)).select("rec.*")


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's tokens with their count and digests; a null text is encoded as the empty one."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL cannot express the learnt, hashed and encoded stages; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's ``documents``; what a stage wrote goes once the next has read it, only the last output stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, before)
        before.append(path)
        docs = spark.read.parquet(path)
    release(spark, _left.pop((threading.get_ident(), sf_dir)))
    return docs
