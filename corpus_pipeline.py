"""The corpus pipeline: documents to packed token sequences in five stages, each one operator.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes it as Parquet to the
shared folder and reads it again as the next stage's documents.  All stages but the last return the
columns of documents.  Nulls, empty texts, repeated rows and empty tables are as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import exact_dedup, language_id, mixing, packing, similar, token_counts
from tidelake.llm._shared import written

#: Target weights of languages, and the tokens to keep in shares of what there is.
WEIGHTS = {"lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}}
FRACTION = 0.95


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told apart clearly; the others go."""
    return language_id.in_known_languages(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts, that with the largest id."""
    return exact_dedup.distinct_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, that with the smallest id; links are pairs
    with near fingerprints and a Jaccard similarity of 0.8 or more over shingles of five words."""
    return similar.representatives(docs, words=5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the sources by target weights, each at most once, in tokens as operator 1 counts
    them."""
    domain = F.when(F.col("source").rlike("^src[0-9]$"), "large").otherwise("small")
    return mixing.mixed_documents(docs, WEIGHTS, FRACTION, domain, lambda rows, carry: token_counts.with_counts(rows, public_tokenizers.path("word_bpe_49k.json"), carry))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixed", mixed), ("packed", packed)]

#: Compression, fingerprints and tokenizers are beyond SQL; the tests hold the stages against plain
#: Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
