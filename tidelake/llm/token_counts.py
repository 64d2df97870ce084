"""Token counts by a digest cache (operator 1).

The cache is a table in a folder that outlives a run: for each tokenizer (by the digest of its file
and the library's version) the digest of a normalised text and its number of tokens, one row a
digest.  A run digests its texts, joins the digests to the cache, encodes one text of each digest
that is missing, appends the new counts and joins every row to its count.  Only the texts to encode
are moved, by id and digest, so many copies of one text meet in no task; rows that share both are
next to each other there, and one of them is encoded.

Null texts count as empty.  Repeated rows each get a row; ids may repeat or be null.  A very long
text is cut into words, never shortened.  A text's count doesn't depend on other columns, whatever
their names.  An empty table gives no rows and an empty cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm import _chunks
from tidelake.llm._shared import exists, ship, table_path, trimmed, written

CACHE = "digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Stands for the tokenizer: its file's bytes and the library's version."""
    import tokenizers

    return hashlib.sha256(Path(path).read_bytes() + tokenizers.__version__.encode()).hexdigest()[:32]


def as_it_is(text: Column) -> Column:
    """The normalisation that leaves a text unchanged."""
    return text


def with_counts(docs: DataFrame, tokenizer_path: str, carry: dict[str, Column], cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = as_it_is) -> DataFrame:
    """One row for each input row: the columns to carry, by name, and ``n_bytes``, ``n_tokens``.

    tokenizer_path: a .json file, there on all executors, of a tokenizer that drops white space.
    cache_path: the cache's folder; None makes a new one under the shared folder."""
    spark = docs.sparkSession
    ship(spark)
    cache_path = f"{cache_path or table_path(spark, 'token-cache')}/tokenizer={tokenizer_digest(tokenizer_path)}"
    if not exists(spark, cache_path):
        spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_path)
    cache = lambda: spark.read.schema(CACHE).parquet(cache_path)

    plain = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    carried = F.struct(*(c.alias(n) for n, c in carry.items())).alias("row")
    src = docs.select(carried, F.col(f"`{id_col}`").alias("id"), F.octet_length(plain).cast("long").alias("n_bytes"), normalise(plain).alias("text"))
    src = src.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    keyed = written(src.select("row", "id", "n_bytes", "digest"), "digests")
    first = keyed.groupBy("digest").agg(F.min("id").alias("first"))
    missing = first.join(cache(), "digest", "left_anti").hint("merge")
    todo = src.alias("s").join(missing.alias("m"), F.col("s.id").eqNullSafe(F.col("m.first")) & (F.col("s.digest") == F.col("m.digest")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last = _chunks.counter(tokenizer_path), None
        for b in batches:
            digests, counts = [], []
            for digest, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if digest != last:  # rows of one id and text are neighbours
                    digests.append(digest)
                    counts.append(count(text.as_py()))
                last = digest
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    new = todo.select("digest", F.col("text").cast("binary").alias("text")).mapInArrow(trimmed(run), CACHE)
    new.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).write.mode("append").parquet(cache_path)  # where neighbours were parted
    wanted = keyed.select("digest").distinct()  # of the cache, which may hold much more
    counts = written(cache().join(wanted, "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return keyed.join(counts, "digest").select("row.*", "n_bytes", "n_tokens")


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, normalise: Callable[[Column], Column] = as_it_is) -> DataFrame:
    """One row for each input row: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``; the options
    are those of ``with_counts``."""
    counted = with_counts(docs, tokenizer_path, {"doc_id": F.col(f"`{id_col}`")}, cache_path, id_col, text_col, normalise)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
