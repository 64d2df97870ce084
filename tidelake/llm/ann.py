"""Nearest neighbours by randomly rotated one-bit codes (operator 10).

A vector is scaled to length one, turned by a seeded random rotation and coded by its signs, packed
into words; two scalars go with the code: the vector's length and the product of the turned unit
vector with its code.  A query is turned too and rounded to a few bits, so its product with a code
is a sum of bit counts over bit planes.  Divided by the code's scalar it estimates the inner product,
with an error bound from the scalar and from the query's rounding.  The best estimates are computed
exactly first; then every vector whose upper bound reaches the k-th exact product is computed.

The candidates are dealt into groups of about ``GROUP_BYTES``, and all queries pass each group in
blocks: a task holds one group and one block of queries, and groups are dealt to tasks by range, one
each.  The work is queries times rows: no coarse partitions leave candidates out.  Equal vectors of a group are one entry with
its smallest ids, so a very common vector costs no more than a rare one; no neighbour is lost by it.

Vectors that are null, empty, zero, or hold null or non-finite components take no part.  Only vectors
of one dimension are compared.  Rows that share an id are candidates each, but never of
a query with their id; a query id that several rows have gets the k best of all their products, in
which a candidate may come up for each of them.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm._shared import ship

#: Bytes of a group's candidates in double precision, about; and below how many rows no further groups are made.
GROUP_BYTES, LEAST = 32 << 20, 4_096
#: Queries of a block.
BLOCK = 64
#: Bits of a rounded query component.
QUERY_BITS = 6
#: Deviations of the estimate that the bound allows.
DEVIATIONS = 2.5


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    pad = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1, bitorder="little").view("<u8")


class Codes:
    """One-bit codes of a group of vectors, and exact search among those that the bounds leave."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, seed: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        raw = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel()
        _, first, self.of = np.unique(raw, return_index=True, return_inverse=True)
        by = np.argsort(self.of, kind="stable")
        starts = np.r_[0, np.cumsum(np.bincount(self.of))]
        self.members = [ids[by[a : min(b, a + k + 1)]] for a, b in zip(starts, starts[1:], strict=False)]  # k and the query itself
        self.vectors = vectors[first].astype(np.float64)
        self.k, self.dim = k, vectors.shape[1]
        self.turn = rotation(self.dim, seed)
        self.length = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        unit = (self.vectors / self.length[:, None]) @ self.turn
        bits = unit > 0
        self.codes, self.ones = _packed(bits), bits.sum(1)
        self.fit = np.abs(unit).sum(1) / np.sqrt(self.dim)  # the unit vector's product with its code
        self.spread = np.sqrt(np.maximum(0, 1 - self.fit**2)) / self.fit / np.sqrt(max(1, self.dim - 1))

    def estimates(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of each query with each vector, and how far off they may be."""
        size = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        turned = (queries / size[:, None]) @ self.turn
        low = turned.min(1, keepdims=True)
        step = np.maximum((turned.max(1, keepdims=True) - low) / ((1 << QUERY_BITS) - 1), 1e-300)
        whole = np.rint((turned - low) / step).astype(np.int64)
        rest = np.sqrt(((turned - low - step * whole) ** 2).sum(1))
        summed = np.zeros((len(queries), len(self.codes)), dtype=np.int64)
        for b in range(QUERY_BITS):
            plane = _packed((whole >> b & 1).astype(bool))
            for w in range(plane.shape[1]):
                summed += np.bitwise_count(plane[:, None, w] & self.codes[None, :, w]).astype(np.int64) << b
        product = (2 * (step * summed + low * self.ones) - (step * whole.sum(1, keepdims=True) + low * self.dim)) / np.sqrt(self.dim)
        scale = size[:, None] * self.length
        return scale * product / self.fit, scale * (DEVIATIONS * self.spread + rest[:, None] / self.fit)

    def search(self, ids: np.ndarray, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query the k nearest ids and their products, nearest first, ties to smaller ids."""
        queries = queries.astype(np.float64)
        about, off = self.estimates(queries)
        want, out = min(self.k + 1, len(self.vectors)), []
        for q, own, a, o in zip(queries, ids, about, off, strict=True):
            upper = a + o
            head = np.argpartition(-a, want - 1)[: min(2 * want, len(a))] if want < len(a) else np.arange(len(a))
            exact = np.einsum("ij,j->i", self.vectors[head], q)
            bar = np.partition(exact, len(exact) - want)[len(exact) - want]
            near = np.flatnonzero(upper >= bar - abs(bar) * 1e-12)
            near = np.union1d(near, head)
            exact = np.einsum("ij,j->i", self.vectors[near], q)
            bar = np.partition(exact, len(exact) - want)[len(exact) - want]
            kept = np.flatnonzero(exact >= bar)
            found = np.concatenate([self.members[near[j]] for j in kept])
            score = np.repeat(exact[kept], [len(self.members[near[j]]) for j in kept])
            found, score = found[found != own], score[found != own]
            order = np.lexsort((found, -score))[: self.k]
            out.append((found[order], score[order]))
        return out


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, seed: int = 7, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest of each row for which ``queries``
    holds, among all rows but itself, by the largest inner product."""
    spark = vectors.sparkSession
    ship(spark)
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.filter(usable(F.col("vector")) & F.col("vec_id").isNotNull()).withColumn("dim", F.size("vector"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(8 * F.col("dim")), F.lit(0))).first()
    groups = max(1, -(-size // group_bytes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // LEAST))
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("g"), "dim", F.lit(0).alias("kind"), "vec_id", "vector")
    asked = rows.filter("asks").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), "dim", F.lit(1).alias("kind"), "vec_id", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, parts, codes = None, [], [], None
        for b in batches:
            g, dim, which, vec = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            flat, offsets = b.column(4).flatten().to_numpy(zero_copy_only=False), b.column(4).offsets.to_numpy()
            offsets = offsets - offsets[0]
            cuts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (dim[1:] != dim[:-1]) | (which[1:] != which[:-1])])
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(g)], strict=True):
                if at != (g[lo], dim[lo]):
                    at, ids, parts, codes = (g[lo], dim[lo]), [], [], None
                block = flat[offsets[lo] : offsets[hi]].reshape(hi - lo, dim[lo])
                if which[lo] == 0:
                    ids.append(vec[lo:hi])
                    parts.append(block)
                    continue
                if codes is None and parts:
                    codes, parts = Codes(np.concatenate(ids), np.concatenate(parts), k, seed), []
                for i in range(0, hi - lo if codes else 0, BLOCK):
                    own = vec[lo:hi][i : i + BLOCK]
                    found = codes.search(own, block[i : i + BLOCK])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, [len(x) for x, _ in found])), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([s for _, s in found]))], names=["query_id", "vec_id", "score"])

    both = dealt.unionByName(asked).withColumn("vector", F.col("vector").cast(f"array<{kind}>"))
    found = both.repartitionByRange(groups, "g").sortWithinPartitions("g", "dim", "kind", "vec_id").mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
