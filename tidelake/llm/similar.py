"""Near-duplicates by SimHash candidates that exact Jaccard similarity confirms (the pipeline's near
stage).

Two documents link where the sets of their shingles of ``words`` words have a Jaccard similarity of
``SHARE`` or more and their fingerprints differ in at most ``RADIUS`` bits.  The fingerprints are
those of ``simhash`` over a text's distinct words, not over its shingles: an edited word changes one
word of many but as many shingles as it has places, so texts of similarity 0.8 are much nearer by
their words.  (README has the share of similar pairs within each radius.)

First the links that hold each group of fingerprints together are confirmed, and those make
components.  Then the fingerprints that have neighbours are compared once more, and only pairs of
different components are looked at, all of them.  So a group of very many near copies costs one link
a copy.  Sketches (parities of the shingles that fall on each bit) go along and rule out most pairs
that aren't similar where they are met; the others are confirmed on the full sets, which are made for
such documents only.

Shingles are compared by their 64-bit hashes, and documents of one set are one node, the 64-bit hash
of the set.  Texts are lower-cased and cut at white space as in ``simhash``; a text of fewer words
than a shingle is one shingle, and null and empty texts are equal.  Very long texts are whole.  Rows
with the same id are different rows, and stay or go together.  A null id is never the smallest of a
component with other ids.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm._components import components
from tidelake.llm._shared import bitmap_of, holds, ship, trimmed, written
from tidelake.llm.simhash import fingerprint
from tidelake.llm.simhash import links as simhash_links

#: The similarity from which on documents link, as a fraction.
SHARE = (4, 5)
#: Bits in which fingerprints of candidates differ, at most.
RADIUS = 8
#: Shingles hashed at a time, and shingles of documents gathered before they are passed on.
SHINGLES = 1 << 17
GATHER = 1 << 19
#: Pairs of sketches compared at a time.
PAIRS = 1 << 16
#: Words of 64 bits in a set's sketch.
SKETCH = 16


def shingle_set(text: bytes | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted hashes of a UTF-8 text's distinct shingles; never empty."""
    import xxhash

    hashed, tokens = xxhash.xxh64_intdigest, (text or b"").lower().split()
    if len(tokens) <= words:
        return np.array([hashed(b" ".join(tokens), seed)], dtype=np.uint64)
    parts = []
    for at in range(0, len(tokens) - words + 1, SHINGLES):
        part = tokens[at : at + SHINGLES + words - 1]
        parts.append(np.array([hashed(b" ".join(s), seed) for s in zip(*(part[i:] for i in range(words)), strict=False)], dtype=np.uint64))
    return np.unique(np.concatenate(parts))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    id_ = F.col(f"`{id_col}`")
    return docs.select(id_.alias("doc_id"), F.xxhash64(F.coalesce(id_.cast("string"), F.lit(""))).alias("key"), F.col(f"`{text_col}`").cast("binary").alias("text"))


def node_of(sets: list[np.ndarray]) -> np.ndarray:
    """The number of each set, by its content."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the shingles that fall on each bit: two sketches differ in no more bits than the
    sets have shingles that only one of them has."""
    odd = np.bincount((s & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _cut(texts: pa.Array, words: int, seed: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sets of the texts, some at a time, each time with the place of the first."""
    at, sets, size = 0, [], 0
    for row, t in enumerate(texts, 1):
        sets.append(shingle_set(t.as_py(), words, seed))
        size += len(sets[-1])
        if size >= GATHER or row == len(texts):
            yield at, sets
            at, sets, size = row, [], 0


def _nodes(texts: DataFrame, words: int, seed: int) -> DataFrame:
    """``doc_id``, ``key`` (a hash of it), ``node``, ``n`` (the set's size), ``sketch`` and ``fp`` for each text."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), 1, seed, distinct=True) for t in b.column(2)), dtype=np.uint64, count=b.num_rows)
            for at, sets in _cut(b.column(2), words, seed):
                k = len(sets)
                sketches = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * SKETCH), pa.array(np.concatenate([sketch(s) for s in sets])))
                sizes = pa.array(np.array([len(s) for s in sets], dtype=np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, k), b.column(1).slice(at, k), pa.array(node_of(sets)), sizes, sketches, pa.array(fps[at : at + k].view(np.int64))], names=["doc_id", "key", "node", "n", "sketch", "fp"])

    return written(texts.mapInArrow(trimmed(run), f"doc_id {kind}, key long, node long, n long, sketch array<long>, fp long"), "similar-nodes")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_fingerprints(nodes: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """The fingerprints, ``fp``, ``least`` and ``most`` (of their nodes), and links ``a``, ``b`` that hold
    together those that are near."""
    per = written(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.max("node").alias("most")), "similar-fingerprints")
    return per, written(simhash_links(per, radius), "similar-near")


def first_pairs(nodes: DataFrame, per: DataFrame, near: DataFrame) -> DataFrame:
    """``a`` > ``b``: the pairs that hold together the nodes whose fingerprints are near or equal."""
    same = nodes.select("node", "fp").join(per.filter("least <> most").select("fp", "least"), "fp").select(F.col("node").alias("a"), F.col("least").alias("b"))
    end = lambda c: per.select(F.col("fp").alias(c), F.col("least").alias(f"node_{c}"))
    met = near.join(end("a"), "a").join(end("b"), "b")
    return _ordered(same.unionByName(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))))


def other_pairs(nodes: DataFrame, per: DataFrame, near: DataFrame, roots: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a`` > ``b``: all pairs of nodes of different components whose fingerprints are near or equal and
    whose sketches allow it.  roots: ``node``, ``root`` of nodes that have links."""
    met = per.filter("least <> most").select("fp").unionByName(near.select(F.explode(F.array("a", "b")).alias("fp"))).distinct()
    of = nodes.join(met, "fp", "left_semi").groupBy("node").agg(*(F.first(c).alias(c) for c in ("fp", "n", "sketch")))
    of = written(of.join(roots, "node", "left").select("node", "fp", "n", "sketch", F.coalesce("root", "node").alias("label")), "similar-labels")

    def keep(x: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        label, n = x.column("label").to_numpy(), x.column("n").to_numpy()
        use = label[i] != label[j]
        at = np.flatnonzero(use)
        sketches = pa.concat_arrays(x.column("sketch").chunks).flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH)
        for lo in range(0, len(at), PAIRS):
            a, b = i[at[lo : lo + PAIRS]], j[at[lo : lo + PAIRS]]
            apart = np.bitwise_count(sketches[a] ^ sketches[b]).sum(1, dtype=np.int64)
            use[at[lo : lo + PAIRS]] = apart * (SHARE[1] + SHARE[0]) <= (n[a] + n[b]) * (SHARE[1] - SHARE[0])
        return use

    return _ordered(simhash_links(of, radius, keep=keep))


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that can be similar by their sketches; no similar pair is left out."""
    known = nodes.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("k"))
    side = lambda end: known.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("k").alias(f"k{end}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = F.aggregate(F.zip_with("ka", "kb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    most = (F.col("na") + F.col("nb")) * (SHARE[1] - SHARE[0])  # (n_a + n_b) (1 - share) / (1 + share)
    return both.filter(apart * (SHARE[1] + SHARE[0]) <= most).select("a", "b")


def _sets(texts: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, seed: int) -> DataFrame:
    """``node``, ``hs``: the sets that pairs need, and some that they don't.  Texts are told by a bitmap
    of their ids, of bounded size; where it is too full, more sets move."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    asked_for = texts.sparkSession.sparkContext.broadcast(bitmap_of(nodes.join(ends, "node", "left_semi").select("key").distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b.column(1).take(pa.array(np.flatnonzero(holds(asked_for.value, b.column(0).to_numpy().view(np.uint64)))))
            for _, sets in _cut(wanted, words, seed):
                lengths = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(node_of(sets)), pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "hs"])

    made = texts.select("key", "text").mapInArrow(trimmed(run), "node long, hs array<long>").join(ends, "node", "left_semi")
    return written(made.groupBy("node").agg(F.first("hs").alias("hs")), "similar-sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar."""
    side = lambda end: sets.select(F.col("node").alias(end), F.col("hs").alias(f"h{end}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("shared", F.size(F.array_intersect("ha", "hb")))
    union = F.size("ha") + F.size("hb") - F.col("shared")
    return both.filter(F.col("shared") * SHARE[1] >= union * SHARE[0]).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, seed: int = 42, radius: int = RADIUS) -> DataFrame:
    """One row for each input row: ``doc_id``, ``component_id``, the smallest id of its component."""
    ship(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    nodes = _nodes(texts, words, seed)

    def confirmed(pairs: DataFrame) -> DataFrame:
        return written(_verified(pairs, _sets(texts, nodes, pairs, words, seed)), "similar-links")

    per, near = near_fingerprints(nodes, radius)
    good = confirmed(written(possible(first_pairs(nodes, per, near), nodes), "similar-possible"))
    pairs = written(other_pairs(nodes, per, near, components(good), radius), "similar-pairs")
    one_each = written(_ordered(pairs.groupBy("a").agg(F.min("b").alias("b")).unionByName(pairs.groupBy("b").agg(F.max("a").alias("a")))), "similar-first")
    good = good.unionByName(confirmed(one_each))  # a pair or two a node, then what these leave apart
    of = written(components(good), "similar-parts")
    end = lambda c: of.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    rest = pairs.join(one_each, ["a", "b"], "left_anti").join(end("a"), "a", "left").join(end("b"), "b", "left")
    rest = rest.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    good = good.unionByName(confirmed(written(rest, "similar-rest")))
    root = components(good)
    rows = written(nodes.select("doc_id", "node").join(root, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root")), "similar-roots")
    return rows.join(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay, with all their columns: of each component the one with the smallest id."""
    found = near_duplicates(docs, id_col, text_col, **options)
    stays = F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id")))
    go = written(found.groupBy("doc_id").agg(stays.alias("stays")).filter("not stays").select(F.col("doc_id").alias("__tl_id")), "similar-go")
    return docs.join(go, F.col(f"`{id_col}`").eqNullSafe(F.col("__tl_id")), "left_anti")
