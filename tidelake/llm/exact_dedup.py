"""Exact deduplication by deterministic block naming (operator 3), with DataFrame functions only.

Texts are cut into fixed-size blocks of bytes.  The distinct blocks of the whole corpus are sorted
and numbered: a block's number is its name.  Then adjacent names are paired, the distinct pairs are
numbered in the same way, and so on until one name is left for each text.  Numbers stand for
distinct contents, never for hashes, so two texts have the same (level, name) if and only if they
are equal byte for byte.

What moves: each text's bytes once (for the distinct blocks), after that rows of a few integers.
Numbers are ranks: rows are dealt to tasks by ranges, sorted there, and each task's ranks begin where
the one before ended; they don't depend on how many tasks there are.  Blocks are ranked by their
64-bit hash where that hash belongs to one distinct block of the corpus only, and found by it; the
distinct blocks that share a hash, and only those, are moved once more, ranked behind the others and
found by content.  So names stay free of collisions whatever the hashes are.

Null texts count as empty; very long ones are more blocks.  Rows with the same id are different rows; a null id is smaller than any
other.  Other columns of the input are ignored, whatever their names.  An empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm._shared import written

#: Bytes of a block.  Most texts have one block, so that few rows take part in the pairing.
BLOCK_BYTES = 8192


def _blocks(text: Column, block_bytes: int) -> Column:
    """The text's blocks in order, as (position, bytes); an empty text has one empty block."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    last = F.greatest(F.ceil(F.octet_length(data) / block_bytes), F.lit(1)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pos"), data.substr(i * block_bytes + 1, F.lit(block_bytes)).alias("block")))


def _numbered(distinct: DataFrame, *by: str, first: int = 0) -> DataFrame:
    """Adds ``name``: the rank of each row in the order of the columns, from ``first`` on."""
    sorted_ = distinct.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    sorted_ = written(sorted_, "sorted").withColumn("part", F.shiftright("at", 33))
    sizes = sorted_.groupBy("part").count()  # a row for each task
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count") + first).alias("before"))
    return sorted_.join(F.broadcast(before), "part").select(*distinct.columns, (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("name"))


def name_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each input row: ``rid`` (its key here), ``doc_id``, ``text_sha256``, and the
    text's identity ``level``, ``name``."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    cut = src.select(F.explode(_blocks(F.col("text"), block_bytes)).alias("b")).select(F.xxhash64("b.block").alias("h"), F.col("b.block").alias("block"))
    # partial sums first: a block that many texts share is moved once a task
    hashes = written(cut.distinct().groupBy("h").agg(F.count("*").alias("n")), "block-hashes")
    names = written(_numbered(hashes.filter("n = 1").select("h"), "h"), "block-names")

    rows = src.withColumn("rid", F.monotonically_increasing_id()).select(
        "rid", "doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), F.posexplode(_blocks(F.col("text"), block_bytes)).alias("pos", "b")
    )
    rows = rows.select("rid", "doc_id", F.when(F.col("pos") == 0, F.col("text_sha256")).alias("text_sha256"), "pos", F.xxhash64("b.block").alias("h"), F.col("b.block").alias("block"))
    doubtful = hashes.filter("n > 1").select("h")
    if doubtful.isEmpty():
        named = rows.drop("block").join(names, "h").drop("h")
    else:  # a block whose hash isn't its own comes with its content, the others without
        known = written(rows.join(doubtful.withColumn("shared", F.lit(True)), "h", "left").withColumn("block", F.when(F.col("shared"), F.col("block"))).drop("shared"), "block-rows")
        full = written(_numbered(known.filter("block is not null").select("h", "block").distinct(), "h", "block", first=names.count()), "block-names")
        own = known.filter("block is null").drop("block").join(names, "h").drop("h")
        named = own.unionByName(known.filter("block is not null").join(full, ["h", "block"]).drop("h", "block"))
    current = written(named, "level-0")
    done, level = [], 0
    sha = current.filter("pos = 0").select("rid", "doc_id", "text_sha256")
    last = current.agg(F.max("pos")).first()[0] or 0
    current = current.select("rid", "pos", "name", F.max("pos").over(Window.partitionBy("rid")).alias("last")) if last else current.select("rid", "pos", "name", F.lit(0).alias("last"))
    for level in range(math.ceil(math.log2(last + 1)) + 1):
        done.append(current.filter("last = 0").select("rid", F.lit(level).alias("level"), "name"))
        if 2**level > last:
            break
        pairs = (
            current.filter("last > 0").groupBy("rid", (F.col("pos") / 2).cast("int").alias("pos"), (F.col("last") / 2).cast("int").alias("last"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        )
        pairs = written(pairs, f"pairs-{level}")
        numbered = _numbered(pairs.select("a", "b").distinct(), "a", "b")
        current = written(pairs.join(numbered, ["a", "b"]).select("rid", "pos", "last", "name"), f"level-{level + 1}")
    ids = done[0]
    for more in done[1:]:
        ids = ids.unionByName(more)
    return sha.join(ids, "rid")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the largest id stays; of rows with that id too, one."""
    named = written(name_texts(docs, id_col, text_col, block_bytes), "text-names")
    groups = named.groupBy("level", "name").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size"))
    groups = written(groups, "text-groups")  # so that the join can split a group with very many copies
    return named.join(groups, ["level", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), "text_sha256"
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The input's rows that stay, with all their columns."""
    named = written(exact_dedup(docs, id_col, text_col, block_bytes), "kept-texts")
    stay = named.filter("kept").select(F.col("doc_id").alias("__tl_id"), F.col("text_sha256").alias("__tl_sha"))
    sha = F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), 256)
    joined = docs.join(stay, F.col(f"`{id_col}`").eqNullSafe(F.col("__tl_id")) & (sha == F.col("__tl_sha")), "left_semi")
    if named.groupBy("doc_id", "text_sha256").count().filter("count > 1").isEmpty():
        return joined
    nth = F.row_number().over(Window.partitionBy(F.col(f"`{id_col}`"), sha).orderBy(F.lit(0)))  # rows that repeat with their id
    return joined.withColumn("__tl_nth", nth).filter("__tl_nth = 1").drop("__tl_nth")
