"""Near-duplicates by SimHash fingerprints and bit-sliced comparison (operator 9).

A text's fingerprint has a bit set where more than half of its shingles' 64-bit hashes have it.
Fingerprints link where at most ``radius`` bits differ.  Candidates meet in tables: the 64 bits are
cut into ``radius + agree`` blocks, and two linked fingerprints agree in at least ``agree`` of them,
so each fingerprint is filed under every choice of so many blocks; no link is missed.  ``agree`` is
2 or as many as it takes for an even table's groups to stay below ``CROWD`` fingerprints.  Within a group of one key the
fingerprints are compared bit-sliced: plane b holds bit b of 64 fingerprints to a word, a query's
planes are xor-ed with all of them at once, carry-save counters add up the differing bits of all
lanes, and the block is abandoned once every lane has passed the radius.

Only distinct fingerprints are compared, so copies cost nothing.  Groups above ``TILE`` members are
cut into tiles and every pair of tiles becomes a group of its own: whole, with bounded memory.  A
group returns one link for each linked member, to the member of its local component that is nearest
to the majority of their bits.

Null and empty texts have fingerprint zero and link like others.  Rows with the same id are
different rows; where whole documents are kept, all rows of an id stay or go together.  A null id
is never the smallest of a component with other ids.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm._components import components
from tidelake.llm._shared import ship, trimmed, written

#: Members of a group that are compared without cutting it into tiles.
TILE = 1024
#: Members of a group that an even table has at most.
CROWD = 512
#: Shingles hashed at a time, so that a very long text needs bounded memory.
SHINGLES = 1 << 17
#: Rows of groups gathered before they are compared.
GATHER = 1 << 16
#: Planes added between two looks at whether all lanes have passed the radius.
LOOK = 8

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACES = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42, distinct: bool = False) -> int:
    """The 64-bit fingerprint of a UTF-8 text, as an unsigned integer; distinct: with shingles of
    one word, words that repeat count once."""
    import xxhash

    hashed, tokens = xxhash.xxh64_intdigest, (text or b"").lower().split()
    if not tokens:
        return 0
    if distinct and words == 1:
        tokens = list(dict.fromkeys(tokens))
    if len(tokens) <= words:
        return hashed(b" ".join(tokens), seed)
    counts, total = np.zeros((8, 256), dtype=np.int64), len(tokens) - words + 1
    for at in range(0, total, SHINGLES):
        part = tokens[at : at + SHINGLES + words - 1]
        h = np.array([hashed(b" ".join(s), seed) for s in zip(*(part[i:] for i in range(words)), strict=False)], dtype="<u8")
        counts += np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=2048).reshape(8, 256)
    bits = (counts @ _BITS).ravel() * 2 > total
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint as a signed long) for each row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words, seed) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def masks(radius: int, agree: int = 2) -> list[int]:
    """The bits of each table: so many of radius + agree blocks."""
    cuts = np.linspace(0, 64, radius + agree + 1).round().astype(int)
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [sum(some) for some in combinations(blocks, agree)]


def blocks_to_agree(fingerprints: int, radius: int) -> int:
    """How many blocks a table's key holds for so many distinct fingerprints."""
    return next((c for c in range(2, 64 - radius) if fingerprints / 2 ** (64 * c / (radius + c)) <= CROWD), 64 - radius)


def _planes(fps: np.ndarray, starts: np.ndarray, lanes: np.ndarray, bits: list[int]) -> np.ndarray:
    """Bit planes: a row for each bit, a word for each 64 lanes; starts: where each word's lanes begin."""
    return np.stack([np.bitwise_or.reduceat(((fps >> np.uint64(b)) & np.uint64(1)) << lanes, starts) for b in bits])


def _near(planes: np.ndarray, query: np.ndarray, valid: np.ndarray, radius: int) -> np.ndarray:
    """Lanes within the radius.  planes: (bit, word...), query: the query's bits spread to words, of
    a shape that goes with it; valid: the lanes that count."""
    width = int(radius + 1).bit_length()
    counters, dead = [np.zeros(valid.shape, dtype=np.uint64) for _ in range(width)], ~valid
    for i in range(len(planes)):
        carry = planes[i] ^ query[i]
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        dead |= carry  # past what the counters hold
        if i % LOOK == LOOK - 1 or i == len(planes) - 1:
            over, equal = np.zeros_like(dead), np.full_like(dead, ~np.uint64(0))
            for k in reversed(range(width)):  # lanes that count more than the radius
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    over |= equal & counters[k]
                    equal &= ~counters[k]
            if (dead | over == ~np.uint64(0)).all():
                return np.zeros_like(dead)
    return ~(dead | over)


def _spread(bit: np.ndarray) -> np.ndarray:
    return (~bit.astype(np.uint64)) + np.uint64(1)  # 0 or all ones


def near_pairs(fps: np.ndarray, group: np.ndarray, radius: int, bits: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of rows of one group within the radius.  group: sorted numbers."""
    bits, one = bits or list(range(64)), np.uint64(1)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, dtype=int)
    sizes = np.diff(np.r_[starts, len(group)])
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64),) * 2]
    small = (sizes > 1) & (sizes <= 64)
    if small.any():  # a word for each group, all groups at once; query k is each group's k-th member
        order = np.argsort(-sizes[small], kind="stable")
        s0, n0 = starts[small][order], sizes[small][order]
        begin = np.r_[0, np.cumsum(n0)[:-1]]
        lane = np.arange(n0.sum()) - np.repeat(begin, n0)
        planes = _planes(fps[np.repeat(s0, n0) + lane], begin, lane.astype(np.uint64), bits)
        full = np.where(n0 == 64, ~np.uint64(0), (one << (n0 % 64).astype(np.uint64)) - one)
        for k in range(n0[0] - 1):
            m = int(np.searchsorted(-n0, -(k + 1)))  # groups with a member after k
            later = full[:m] & ~((one << np.uint64(k + 1)) - one)
            near = _near(planes[:, :m], _spread((planes[:, :m] >> np.uint64(k)) & one), later, radius)
            hit = np.flatnonzero(near)
            if len(hit):
                lanes = np.unpackbits(near[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                g, j = np.nonzero(lanes)
                found.append((s0[hit[g]] + k, s0[hit[g]] + j))
    for s, n in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        own, lane = fps[s : s + n], np.arange(n)
        planes = _planes(own, np.arange(0, n, 64), (lane % 64).astype(np.uint64), bits)
        for q in range(0, n - 1, 64):
            rest = planes[:, q // 64 :]  # lanes from this word on
            query = np.stack([_spread((own[q : q + 64] >> np.uint64(b)) & one)[:, None] for b in bits])
            valid = np.full((query.shape[1], rest.shape[1]), ~np.uint64(0))
            valid[:, -1] &= ~np.uint64(0) >> np.uint64(-n % 64)
            valid[:, 0] &= ~(((one << np.arange(query.shape[1], dtype=np.uint64)) - one) | (one << np.arange(query.shape[1], dtype=np.uint64)))
            near = _near(rest[:, None, :], query, valid, radius)
            if near.any():
                i, j = np.nonzero(np.unpackbits(near.astype("<u8").view(np.uint8), axis=1, bitorder="little"))
                found.append((s + q + i, s + q + j))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place of its component of the links."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _centres(fps: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each place the place of its component's member that is nearest to the component's majority
    of bits; label: as from ``_smallest``.  Of near copies of one text that is most like the text."""
    order = np.argsort(label, kind="stable")
    starts = np.flatnonzero(np.r_[True, label[order][1:] != label[order][:-1]])
    sizes = np.diff(np.r_[starts, len(order)])
    bits = np.unpackbits(fps[order].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    major = np.add.reduceat(bits, starts, axis=0, dtype=np.int64) * 2 > sizes[:, None]
    which = np.repeat(np.arange(len(starts)), sizes)
    apart = (bits.astype(bool) ^ major[which]).sum(1)
    best = np.lexsort((fps[order], apart, which))[starts]  # ties: the smallest
    out = np.empty(len(order), dtype=np.int64)
    out[order] = order[best][which]
    return out


def links(fps: DataFrame, radius: int = 2, tile: int = TILE, keep: Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``a``, ``b``: links between different fingerprints of column ``fp`` that hold every component
    together.  fps: distinct fingerprints.

    With ``keep`` fps has rows with columns ``fp``, ``node`` (long) and others, and the result has the
    nodes of all pairs of rows within the radius, once, for which keep says so: it takes a table of
    rows and the pairs' places in it, and returns a mask."""
    ship(fps.sparkSession)
    if keep is None:
        fps = fps.select("fp")
    tables = masks(radius, blocks_to_agree(fps.count(), radius))
    signed = [m - (1 << 64) if m >> 63 else m for m in tables]
    other = [[b for b in range(64) if not m >> b & 1] for m in tables]
    own_columns = fps.columns
    filed = fps.select(*own_columns, F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("t", "key"))
    large = filed.groupBy("t", "key").count().filter(F.col("count") > tile)
    n = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / tile).cast("int")
    own = F.pmod(F.xxhash64("fp" if keep is None else "node", F.lit(1)), n).cast("int")
    group = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    filed = filed.join(large, ["t", "key"], "left").select(*own_columns, "t", "key", n.alias("tiles"), own.alias("own"))
    filed = filed.select(*own_columns, "t", "key", F.explode(group).alias("g")).select("t", "key", "g.i", "g.j", *own_columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for b in batches:
            kept.append(b)
            if sum(x.num_rows for x in kept) >= GATHER:
                done, rest = split(pa.Table.from_batches(kept))
                kept = rest.to_batches()
                yield from compared(done)
        if kept:
            yield from compared(pa.Table.from_batches(kept))

    def split(x: pa.Table) -> tuple[pa.Table, pa.Table]:
        """The groups that are whole, and the last one."""
        ids = numbers(x)
        cut = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0
        return x.slice(0, cut), x.slice(cut).combine_chunks()

    def numbers(x: pa.Table) -> np.ndarray:
        cols = [x.column(c).to_numpy() for c in ("t", "key", "i", "j")]
        change = np.zeros(x.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        return np.cumsum(change)

    def compared(x: pa.Table) -> Iterator[pa.RecordBatch]:
        if not x.num_rows:
            return
        ids, fp, t = numbers(x), np.ascontiguousarray(x.column("fp").to_numpy()), x.column("t").to_numpy()
        for k in np.unique(t):
            at = np.flatnonzero(t == k)
            i, j = near_pairs(fp[at].view(np.uint64), ids[at], radius, other[k])
            if keep is not None:
                i, j = at[i], at[j]
                for earlier in signed[:k]:  # found there
                    new = (fp[i] ^ fp[j]) & earlier != 0
                    i, j = i[new], j[new]
                use = keep(x, i, j)
                node = x.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(node[i[use]]), pa.array(node[j[use]])], names=["a", "b"])
            elif len(i):
                centre = _centres(fp[at].view(np.uint64), _smallest(len(at), i, j))
                out = np.flatnonzero(centre != np.arange(len(at)))
                yield pa.RecordBatch.from_arrays([pa.array(fp[at][out]), pa.array(fp[at][centre[out]])], names=["a", "b"])

    dealt = filed.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "fp")
    return dealt.mapInArrow(trimmed(run), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, radius: int = 2, tile: int = TILE) -> DataFrame:
    """One row for each input row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``."""
    of = written(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    per = written(of.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    root = components(links(per.select("fp"), radius, tile)).select(F.col("node").alias("fp"), "root")
    joined = per.join(root, "fp")
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = joined.join(smallest, "root").select("fp", "component_id")
    per = written(per.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "fingerprint-components")
    return of.join(per, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay, with all their columns: of each component the one with the smallest id."""
    found = near_duplicates(docs, id_col, text_col, **options)
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__tl_id")).distinct()
    return docs.join(stay, F.col(f"`{id_col}`").eqNullSafe(F.col("__tl_id")), "left_semi")
