"""The thin ``opN_<name>`` queries: each applies its operator, with production parameters, to its
whole table and derives the columns that are asked for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidelake.llm import ann, exact_dedup, language_id, mixing, packing, pii, quality, simhash, suffix_tree, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keeps one row of equal texts; see ``exact_dedup``."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


ORACLES["op3_exact_dedup"] = """
with t as (select doc_id, coalesce(text, '') as text from documents),
g as (select text, max(doc_id) as keep_id, count(*) as group_size from t group by text)
select t.doc_id, g.keep_id, cast(g.group_size as bigint) as group_size, t.doc_id = g.keep_id as kept, sha256(t.text) as text_sha256
from t join g on t.text = g.text
"""


@_query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text by the word tokenizer; see ``token_counts``.  The cache begins empty."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in sequences of at most 2048; see ``packing``."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents; see ``simhash``."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text; see ``pii``."""
    return pii.summary(pii.find_pii(table(spark, sf_dir, "documents")))


@_query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text; learned from two folds of three; see ``language_id``."""
    return language_id.held_out_languages(table(spark, sf_dir, "documents"))


@_query
def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth; see ``ann``."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_query
def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text, learned from all folds but one of seven; see ``suffix_tree``."""
    return suffix_tree.score_texts(table(spark, sf_dir, "documents"), suffix_tree.fold() != 2)


#: Target weights of the languages and of one large source, for ``op2_mixing``.
MIX = {"lang": {"en": 0.4, "de": 0.25, "fr": 0.2, "es": 0.15}, "source": {"src0": 2.0}}


@_query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in a mix of 80 % of the tokens, two epochs at most; domains by the
    source's number; tokens as operator 1 counts them; see ``mixing``."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"), F.lit(0))
    domain = F.concat(F.lit("domain"), (number % 4).cast("string"))
    columns = {c: F.col(c) for c in ("doc_id", "lang", "source")} | {"domain": domain}
    counted = token_counts.with_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), columns)
    return mixing.mix(counted, MIX, 0.8, F.col("domain"), F.col("n_tokens")).drop("row_key")


@_query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; sources are its hosts, their languages the paths; see ``quality``."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline``."""
    return corpus_pipeline.run(spark, sf_dir)
