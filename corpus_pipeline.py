"""From raw documents to token ids in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet in the shared folder and reads it as the next stage's docs.  All but the last return the
columns of documents.

Defined results: a null text is scored, encoded and counted as the empty text and stays null until it is
encoded; a null doc_id is linked with nothing and stays; a null source is a source of its own; rows that repeat
a doc_id and a set of shingles stay once; other columns, null or not, are carried untouched, but for n_chars
of masked texts; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from krigstone.llm import bpe, compression_quality, mixing, secret_scan, setsketch
from krigstone.llm.common import materialize, table

VOCABULARY = "byte_bpe_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold go."""
    return compression_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, that with the smallest doc_id; those without a doc_id stay,
    and of rows that repeat the id one for each set of shingles."""
    return setsketch.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that a rule finds is masked; no document goes."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their target weights."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of every copy."""
    return bpe.encode(docs, bpe.load(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN))


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("secret scans", secrets),
    ("mixing", mix),
    ("byte-level BPE", tokens),
]

#: The classifier and the sketches can't be expressed in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return materialize(STAGES[-1][1](spark, docs, sf_dir))
