"""Packing of token sequences by Karmarkar-Karp multiway differencing (operator 4).

A document's ids are cut into pieces: whole sequences of ``capacity`` ids, and the rest into pieces
of at most ``piece`` ids.  Whole sequences stand alone.  The other pieces are dealt into bins of
about ``BIN`` pieces by a hash, and each bin is divided into windows: every piece begins as a partial
partition (itself in one window, nothing in the others), and the two partial partitions with the
largest imbalance are merged again and again, the heaviest windows of one with the lightest of the
other.  The windows come out nearly equal; where one is above the capacity, the bin is divided into
one window more.  A bin's windows are as many as its ids need, so padding is under a sequence a bin
plus what the imbalance costs.

Null texts count as empty (one id, the end).  Rows with the same id are different documents.  Other
columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm import _chunks
from tidelake.llm._shared import ship, written

#: Pieces of a bin, about.
BIN = 1536
#: Ids of a piece of a document's rest, at most.
PIECE = 512
#: Sequences that are one piece are numbered from here, above all windows of bins.
WHOLE = 1 << 62


def karmarkar_karp(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item, by largest differencing over that many windows."""
    n = len(sizes)
    if windows == 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    loads: list[np.ndarray | None] = []
    heap = []
    for i, s in enumerate(sizes):
        load = np.zeros(windows, dtype=np.int64)
        load[-1] = s
        loads.append(load)
        heap.append((-int(s), i))
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        load = loads[a] + loads[b][::-1]  # both rise: the lightest meets the heaviest
        loads[a] = loads[b] = None
        order = np.argsort(load, kind="stable")
        load = load[order]
        merges.append((a, b, order))
        heapq.heappush(heap, (int(load[0] - load[-1]), len(loads)))
        loads.append(load)
    places: dict[int, np.ndarray] = {n + len(merges) - 1: np.arange(windows)}
    out = np.zeros(n, dtype=np.int64)
    for k in reversed(range(len(merges))):
        a, b, order = merges[k]
        at = np.empty(windows, dtype=np.int64)
        at[order] = places.pop(n + k)
        for child, own in ((a, at), (b, at[::-1])):
            if child < n:
                out[child] = own[-1]
            else:
                places[child] = own
    if not merges:
        out[0] = 0
    return out


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, with no window above the capacity (no item may be).  Where one is,
    there are more windows: as many as leave room for what the fullest was above the mean."""
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    while True:
        found = karmarkar_karp(sizes, k)
        most = np.bincount(found, weights=sizes).max() if len(found) else 0
        if most <= capacity:
            return found
        above = most - total / k
        k = max(k + 1, min(int(total / (capacity - above)) if above < capacity else k + 1, k + 1 + k // 64))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, piece: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = _chunks.encoder(tokenizer_path), end_id.to_bytes(4, "little")
        for b in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                ids = memoryview(ids_of(t.as_py()) + end)
                n = len(ids) // 4
                at = 0
                while at < n:
                    m = capacity if n - at >= capacity else min(piece, n - at)
                    row.append(i)
                    start.append(at)
                    length.append(m)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + m)]))
                    total.append(n)
                    at += m
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, piece: int = PIECE, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``.

    tokenizer_path: a byte-level .json file, there on all executors."""
    ship(docs.sparkSession)
    cut = pieces(docs, tokenizer_path, capacity, piece, end_id, id_col, text_col).withColumn("key", F.monotonically_increasing_id())
    cut = written(cut, "pieces")
    whole = cut.filter(F.col("length") == capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.lit(WHOLE) + F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.filter(F.col("length") < capacity)
    bins = max(1, round(rest.count() / BIN))
    kind = cut.schema["doc_id"].dataType.simpleString()

    def divide(x: pa.Table) -> pa.Table:
        x = x.sort_by([("key", "ascending")])
        sizes = x.column("length").to_numpy()
        window = windows(sizes, capacity)
        order = np.argsort(window, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.r_[True, window[order][1:] != window[order][:-1]]
        offset = before - np.maximum.accumulate(np.where(first, before, 0))
        x = x.take(pa.array(order))
        return x.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).append_column("sequence_id", pa.array((x.column("bin").to_numpy() << 32) + window[order])).append_column("offset", pa.array(offset))

    dealt = rest.withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(bins)))
    packed = dealt.groupBy("bin").applyInArrow(divide, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return whole.unionByName(packed)
