"""Language-model scores by a probabilistic suffix tree over words (operator 6).

A text is its words, lower case, then one end.  The tree's root is the add-one unigram distribution
over the training tokens and one unknown token.  Its other states are contexts: the last d words
before a token, across the whole text, with no limit to d.

* The tree grows level by level.  A context of d words is looked at where its suffix of d - 1 words
  was retained and its first two words, and its first three as far as they were counted, were seen
  together ``MIN_COUNT`` times; it is retained if it was seen ``MIN_COUNT`` times and its next tokens diverge from
  those after its suffix: their log-likelihood under the context's smoothed distribution, each
  occurrence left out in turn, is ``GAIN`` nats above that under the suffix's distribution.  Growth
  ends at the first level that retains nothing, so a longer or more regular corpus has a deeper tree.
* Smoothing: of a context's tokens those seen once go to the suffix's share.  With n >= 2 for the
  others, p(x | c) = (n + share p(x | suffix)) / (sum of n + share), where share is the number of
  different tokens after c.  A token is scored in the longest retained context before it.
* So a text's score is a sum over keys: its tokens, its retained contexts, and its (context, token)
  pairs seen twice or more.  The most frequent keys, ``HEAD`` at most, are sent to all tasks; the
  text's rarer keys join the tree by key and are summed by text.  A key that isn't sent is too rare
  to make a task uneven.  How often rarer keys occur is known from the counts; the texts are scored in
  as many portions as it takes to move one of them for ``APART`` tokens at a time, so what lies on disk
  follows the tokens, however small the share of keys is that tasks hold.

Counting: each task adds up its own texts and passes on packed lists of contexts and next tokens, one
for each bucket of contexts, in which words are ranks by frequency; contexts whose last word, or last two words, were seen more than ``PART``
times are cut into parts by their next token.  Others are whole in their bucket and dropped there if
they were seen less than ``MIN_COUNT`` times; their sums are known there, so their pairs aren't moved by
context.  Pairs meet those of the suffix by key, in portions like the texts.  There are as many buckets as it takes for about ``ADD`` tokens each.  What tasks
are sent is bounded: ``HEAD`` keys, and bitmaps of at most ``FILTER_BITS`` bits by which they leave out
what isn't in the tree; a full bitmap costs more rows, never a wrong score.  Contexts have a bitmap of
their own, since a longer context is looked for wherever a shorter one seems to be there.

Words are compared by 64-bit hashes.  Null texts count as empty: one end.  A null id counts as the
empty text for its fold.  Repeated rows each get a row.  Very long texts are hashed in pieces.
Without training texts counts are zero and the tree is its root.  Other columns are ignored.  An
empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm._shared import FILTER_BITS, bitmap_of, bucketed, forget, holds, release, ship, trimmed, written

MIN_COUNT, GAIN = 32, 8.0
#: Contexts that are joined by sending them to all tasks, at most.
FEW = 1 << 16
#: Keys that every task holds, at most.
HEAD = 1 << 21
#: Occurrences of a context from which its next tokens are counted in parts.
PART = 1 << 20
#: Bytes hashed at a time, bytes of texts scored at a time and counted at a time, and tokens of a bucket.
PIECE, BLOCK, GATHER, ADD = 1 << 17, 1 << 21, 1 << 22, 1 << 20
#: Tokens for each key that is moved at a time while the tree is joined or texts are scored, and keys of a bucket of the tree.
APART, JOINED = 8, 1 << 18
#: Depths that are counted in one pass over the texts, by the first of them: far fewer contexts are deep.
SPAN = {1: 1, 2: 1}
SPAN_DEEP = 4
#: Buckets at least, and at most (they are numbered by an int).
BUCKETS = (64, 1 << 30)

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_ODD, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


END, ROOT = mix(np.array([[1], [2]], dtype=np.uint64))  # arrays of one
_powers: list[np.ndarray] = []


def _powers_of(n: int) -> list[np.ndarray]:
    """The first n powers of an odd number and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        ones = lambda base: np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(n, PIECE), base, dtype=np.uint64)])
        _powers[:] = [ones(_STEP), ones(pow(_STEP, -1, 1 << 64))]
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes and where they begin."""
    hashes, begins, at = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], 0
    data = data.lower()
    while at < len(data):
        space = _SPACE.search(data, at + PIECE)
        end = space.start() if space else len(data)
        buf = np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)
        up, down = _powers_of(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.multiply(buf, up[: len(buf)], out=sums[1:])
        np.cumsum(sums[1:], out=sums[1:])
        blank = np.ones(len(buf) + 2, dtype=bool)
        blank[1:-1] = (buf == 32) | (buf - np.uint8(9) < 5)
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        lo, hi = edges[0::2], edges[1::2]
        hashes.append(mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64) * np.uint64(_ODD)))
        begins.append(lo + at)
        at = end
    return np.concatenate(hashes), np.concatenate(begins)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' tokens, one text after the other: hash, the text's number, the place in the text."""
    h, begin = word_hashes(b"\n".join(texts))
    sizes = np.diff(np.r_[np.searchsorted(begin, np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])), len(h)]) + 1
    of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    ends = np.cumsum(sizes)
    out = np.full(len(of), END, dtype=np.uint64)
    is_word = np.ones(len(of), dtype=bool)
    is_word[ends - 1] = False
    out[is_word] = h
    return out, of, np.arange(len(of), dtype=np.int32) - np.repeat((ends - sizes).astype(np.int32), sizes)


def _longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a context with one word more before it."""
    return mix(context * np.uint64(_ODD) + word)


def gram(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The key of a token after a context."""
    return mix(context + token * np.uint64(_STEP))


def _kinds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers, and for each number which of them it is."""
    coded = _signed(x).dictionary_encode()
    return coded.dictionary.to_numpy().view(np.uint64), coded.indices.to_numpy()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _gathered(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[tuple[list[pa.RecordBatch], list[bytes]]]:
    """Rows, some at a time, and their texts."""
    rows, texts, size = [], [], 0
    for b in batches:
        at = 0
        for i, t in enumerate(b.column(column), 1):
            texts.append(t.as_py())
            size += len(texts[-1])
            if size >= most:
                yield [*rows, b.slice(at, i - at)], texts
                rows, texts, size, at = [], [], 0, i
        if at < b.num_rows:
            rows.append(b.slice(at))
    if texts:
        yield rows, texts


def count_tokens(texts: DataFrame) -> DataFrame:
    """texts: ``text`` (binary).  ``key``, ``n``: the occurrences of each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _gathered(batches, 0, GATHER):
            key, n = np.unique(tokens(part)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(key), pa.array(n.astype(np.int64))], names=["key", "n"])

    return texts.select("text").mapInArrow(trimmed(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


#: A word in a list is three bytes: its rank among the head's words, or that it stands elsewhere in the list.
ELSEWHERE = (1 << 24) - 1
#: What a list holds, one after the other: of each of its contexts the suffix, the part, how many tokens belong to it and the
#: first word; of each of its tokens the rank and the count; the contexts' and the tokens' words that stand elsewhere.
#: Numbers of bytes are a list of all first bytes, then of all second ones and so on.
_CONTEXTS, _TOKENS, _WORDS, _OTHERS = range(4)
PACKED = {"pctx": (8, _CONTEXTS), "part": (8, _CONTEXTS)} | {f"kinds{i}": (1, _CONTEXTS) for i in range(4)} | {f"words{i}": (1, _CONTEXTS) for i in range(3)}
PACKED |= {f"xs{i}": (1, _TOKENS) for i in range(3)} | {"ns": (1, _TOKENS), "words": (8, _WORDS), "others": (8, _OTHERS)}
_SIZES = struct.Struct("<4I")


def _planes(name: str, x: np.ndarray, n: int) -> dict[str, bytes]:
    """The first n bytes of 32-bit numbers, one list for each."""
    return {f"{name}{i}": np.ascontiguousarray(x.astype("<u4").view(np.uint8)[i::4]).tobytes() for i in range(n)}


def _whole(columns: dict[str, bytes], name: str, n: int) -> np.ndarray:
    """The numbers of ``_planes``."""
    out = np.zeros((len(columns[f"{name}0"]), 4), dtype=np.uint8)
    for i in range(n):
        out[:, i] = np.frombuffer(columns[f"{name}{i}"], dtype=np.uint8)
    return out.view("<u4").ravel()


def _lists(columns: dict[str, bytes], cuts: list[np.ndarray]) -> list[bytes]:
    """The columns cut into lists; cuts: where each list begins and ends, by what the column is of."""
    codec, out = pa.Codec("zstd", compression_level=1), []
    cuts = [c.tolist() for c in cuts]
    for i in range(len(cuts[0]) - 1):
        raw = b"".join([_SIZES.pack(*(c[i + 1] - c[i] for c in cuts)), *(columns[k][w * cuts[of][i] : w * cuts[of][i + 1]] for k, (w, of) in PACKED.items())])
        out.append(len(raw).to_bytes(4, "little") + codec.compress(raw, asbytes=True))
    return out


def _unpacked(lists: list[bytes]) -> dict[str, bytes]:
    """The lists' columns, one list after the other."""
    codec, columns = pa.Codec("zstd"), {k: [] for k in PACKED}
    for data in lists:
        raw = codec.decompress(memoryview(data)[4:], int.from_bytes(data[:4], "little"), asbytes=True)
        sizes, at = _SIZES.unpack_from(raw), _SIZES.size
        for k, (w, of) in PACKED.items():
            end = at + w * sizes[of]
            columns[k].append(raw[at:end])
            at = end
    return {k: b"".join(v) for k, v in columns.items()}


def _next_tokens(texts: DataFrame, depth: int, span: int, filter_, together, triples, hot, head, buckets: int) -> DataFrame:
    """The contexts of ``depth`` words, and of up to span - 1 more, whose suffixes of less than ``depth``
    words pass the filter, and the tokens after them, as far as one task sees them: ``bucket``, and
    ``data``, a list by ``PACKED`` in which a part is 0 where it is all of a context.  together: pairs of words that are
    frequent.  triples, from depth 3: the words after which pairs were counted by what follows, and the
    frequent ones of these.  hot: words, from depth 2 pairs of words, and bits of their parts."""

    def contexts(h: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """The places to count at, their contexts, the contexts' suffixes and their first words."""
        at, found = np.arange(len(h), dtype=np.int32), []
        ctx = np.full(len(at), ROOT)
        for d in range(1, depth + span):
            live = place[at] >= d
            if depth == 1:
                live[live] = holds(filter_.value, h[at[live] - 1])
            elif d > 1:
                live[live] = holds(together.value, gram(_longer(ROOT, h[at[live] - d]), h[at[live] - d + 1]))
            if d > 2 and triples is not None:
                counted, frequent = triples[0].value, triples[1].value
                second = _longer(ROOT, h[at[live] - d + 1])
                live[live] = ~holds(counted, second) | holds(frequent, gram(_longer(second, h[at[live] - d]), h[at[live] - d + 2]))
            at, before = at[live], ctx[live]
            ctx = _longer(before, h[at - d])
            if d >= depth:
                found.append((at, ctx, before, h[at - d]))
            else:
                live = holds(filter_.value, ctx)
                at, ctx = at[live], ctx[live]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_words, hot_bits = hot.value
        places, ranks = Places(head.value[0]), np.empty(len(head.value[0]) + 1, dtype="<u4")
        ranks[head.value[2]] = np.minimum(np.arange(len(head.value[2])), ELSEWHERE)
        ranks[-1] = ELSEWHERE  # of a word that isn't there
        for _, part in _gathered(batches, 0, GATHER):
            h, _, place = tokens(part)
            at, ctx, before, word = contexts(h, place)
            if not len(at):
                continue
            last, x = h[at - 1], h[at]
            if depth > 1 and len(hot_words):
                last = gram(_longer(ROOT, h[at - 2]), last)
            if depth == 1:
                x_kinds, ids = _kinds(h)
                xi, own = ids[at], ids[at - 1]
                del ids
            else:
                x_kinds, xi = _kinds(x)
            del h, place, at
            cut = np.zeros(len(x), dtype=np.uint64)
            if len(hot_words):
                i = np.minimum(np.searchsorted(hot_words, last), len(hot_words) - 1)
                bits = np.where(hot_words[i] == last, hot_bits[i], 0).astype(np.uint64)
                cut = np.where(bits > 0, (x >> (np.uint64(64) - np.maximum(bits, np.uint64(1)))) + np.uint64(1), np.uint64(0))
            if depth == 1 and not cut.any():  # a group is a word
                there = np.unique(own)
                number = np.zeros(len(x_kinds), dtype=np.int64)
                number[there] = np.arange(len(there))
                g, first = number[own], np.zeros(len(there), dtype=np.int64)
                first[g] = np.arange(len(g))
            else:
                _, first, g = np.unique(_longer(ctx, cut), return_index=True, return_inverse=True)  # parts of contexts
            ctx, before, word, cut = ctx[first], before[first], word[first], cut[first]
            bucket = (_longer(ctx, cut) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable") if depth == 1 else np.lexsort((before, bucket))
            rank = np.empty(len(order), dtype=np.uint64)
            rank[order] = np.arange(len(order))
            before, word, cut, bucket = before[order], word[order], cut[order], bucket[order]
            pairs, n = np.unique(rank[g] << np.uint64(32) | xi.astype(np.uint64), return_counts=True)
            del last, x, g, xi
            copies = -(-n // 255)  # a count is a byte
            many = np.repeat(np.arange(len(pairs)), copies)
            rest = n[many] - 255 * (np.arange(len(many)) - np.repeat(np.cumsum(copies) - copies, copies))
            pairs, n = pairs[many], np.minimum(rest, 255).astype(np.uint8)
            kinds = np.bincount((pairs >> np.uint64(32)).astype(np.int64), minlength=len(before)).astype(np.uint32)
            xi = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
            xs, firsts = ranks[places.of(x_kinds)][xi], ranks[places.of(word)]
            other, far = xs == ELSEWHERE, firsts == ELSEWHERE
            others = x_kinds[xi[other]]
            del pairs, many, rest, copies, xi
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            groups = np.r_[starts, len(before)]
            items = np.r_[0, np.cumsum(kinds, dtype=np.int64)][groups]
            columns = {"pctx": before.tobytes(), "part": cut.tobytes(), "ns": n.tobytes(), "words": word[far].tobytes(), "others": others.tobytes()}
            columns |= _planes("kinds", kinds, 4) | _planes("words", firsts, 3) | _planes("xs", xs, 3)
            data = _lists(columns, [groups, items, np.r_[0, np.cumsum(far)][groups], np.r_[0, np.cumsum(other)][items]])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(data, type=pa.binary())], names=["bucket", "data"])

    return texts.select("text").mapInArrow(trimmed(run), "bucket int, data binary")


def _merged(lists: DataFrame, head, min_count: int) -> DataFrame:
    """Adds up the tasks' lists; whole contexts seen less than ``min_count`` times end here.  A row for
    each context's part, where ``key`` is null: ``pctx``, ``once``, ``twice``
    (numbers of tokens seen so often), ``kinds`` (tokens seen twice or more), ``sum`` (of their counts);
    and a row for each token seen twice or more: ``n``, its key ``key``, ``pkey``, the key of the token
    after the context's suffix, or, where that is the root, ``x``, the token, and ``xn``, its own
    count where it is one of the head's, else null.  All rows of a whole context have its ``share`` and
    ``z``, the sum and the share; the others null."""
    names = ["ctx", "pctx", "once", "twice", "kinds", "sum", "x", "n", "key", "xn", "pkey", "share", "z"]

    def added(t: pa.Table) -> pa.Table:
        columns = _unpacked(t.column("data").to_pylist())
        words, counts, by_rank = head.value

        def hashes(ranks: np.ndarray, others: bytes) -> np.ndarray:
            there = ranks != ELSEWHERE
            out = np.empty(len(ranks), dtype=np.uint64)
            out[there], out[~there] = words[by_rank[ranks[there]]], np.frombuffer(others, dtype=np.uint64)
            return out

        pctx, part, n = (np.frombuffer(columns[c], dtype=k) for c, k in (("pctx", np.uint64), ("part", np.uint64), ("ns", np.uint8)))
        kinds, x = _whole(columns, "kinds", 4), hashes(_whole(columns, "xs", 3), columns["others"])
        ctx = _longer(pctx, hashes(_whole(columns, "words", 3), columns["words"]))
        del columns
        _, first, group = np.unique(_longer(ctx, part), return_index=True, return_inverse=True)
        ctx, pctx, part, g, n = ctx[first], pctx[first], part[first], np.repeat(group, kinds), n.astype(np.int32)
        stays = (part > 0) | (np.bincount(g, weights=n, minlength=len(first)) >= min_count)
        number = np.cumsum(stays) - 1
        ctx, pctx, part = ctx[stays], pctx[stays], part[stays]
        there = stays[g]
        g, n, x = number[g[there]], n[there], x[there]
        x_kinds, xi = _kinds(x)
        pair = g.astype(np.uint64) << np.uint64(32) | xi.astype(np.uint64)
        del x, xi, g, there
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
        starts = np.flatnonzero(np.r_[len(pair) > 0, pair[1:] != pair[:-1]])
        n, pair = np.add.reduceat(n, starts, dtype=np.int64) if len(starts) else n.astype(np.int64), pair[starts]
        g, x = (pair >> np.uint64(32)).astype(np.int64), x_kinds[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        del pair, order
        count = lambda mask, w=None: np.rint(np.bincount(g[mask], weights=None if w is None else w[mask], minlength=len(ctx))).astype(np.int64)
        many = n >= 2
        none = lambda k: pa.nulls(k, pa.int64())
        once, of_many, total = count(n == 1), count(many), count(many, n)
        share, z, cut = once + of_many, once + of_many + total, part > 0
        sizes = pa.table([_signed(ctx), _signed(pctx), *(pa.array(c) for c in (once, count(n == 2), of_many, total)), *(none(len(ctx)) for _ in range(5)), pa.array(share, mask=cut), pa.array(z, mask=cut)], names=names)
        g, x, n = g[many], x[many], n[many]
        at = np.minimum(np.searchsorted(words, x), max(0, len(words) - 1))
        known = words[at] == x if len(words) else np.zeros(len(x), dtype=bool)
        first = pctx[g] == ROOT
        own = pa.array(counts[at] if len(words) else np.zeros(len(x), dtype=np.int64), mask=~(known & first))
        pairs = [pa.array(x.view(np.int64), mask=~first), pa.array(n), _signed(gram(ctx[g], x)), own, pa.array(gram(pctx[g], x).view(np.int64), mask=first), pa.array(share[g], mask=cut[g]), pa.array(z[g], mask=cut[g])]
        return pa.concat_tables([sizes, pa.table([_signed(ctx[g]), *(none(len(g)) for _ in range(5)), *pairs], names=names)])

    return lists.groupBy("bucket").applyInArrow(added, ", ".join(f"{c} long" for c in names))


def _head(keys: DataFrame, head: int) -> int:
    """The smallest count ``n`` that at most ``head`` keys reach."""
    step = F.greatest(F.floor(F.log2("n")).cast("int") - 6, F.lit(0))
    low = F.expr("shiftleft(shiftright(n, step), step)")
    sizes = keys.withColumn("step", step).groupBy(low.alias("low")).count().orderBy(F.col("low").desc()).collect()  # 64 rows a power of two
    least, n = (1 << 62), 0
    for r in sizes:
        n += r["count"]
        if n > head:
            break
        least = r["low"]
    return least


def _sorted(table: pa.Table) -> tuple[np.ndarray, ...]:
    """The columns, by the key as an unsigned number."""
    key = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    return (key[order], *(table.column(c).to_numpy()[order] for c in table.column_names if c != "key"))


class Places:
    """Where keys are in a sorted array of them.  They are hashes, so a key's first bits lead to it."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, len(keys).bit_length())
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.starts = np.r_[np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift), len(keys)].astype(np.int32)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it isn't there."""
        out = np.full(len(keys), -1, dtype=np.int64)
        first = (keys >> self.shift).astype(np.int64)
        at, end = self.starts[first], self.starts[first + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.keys[at[left]] == keys[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


def portions_of(rows: int, tokens: int) -> int:
    """In how many portions rows are moved, so that it is one for ``APART`` tokens at a time."""
    return max(1, -(-APART * rows // max(tokens, 1)))


def _of_kept(pairs: DataFrame, judged: DataFrame) -> DataFrame:
    """The pairs whose context stays.  Bitmaps of the contexts that stay and of those that don't tell of
    most pairs; only the pairs of contexts that both seem to hold are joined."""
    spark = pairs.sparkSession
    kept, dropped = (judged.filter(c).select(F.col("ctx").alias("key")) for c in ("stays", "not stays"))
    staying = kept.withColumnRenamed("key", "ctx")
    if judged.count() <= FEW:
        return pairs.join(F.broadcast(staying), "ctx", "left_semi")
    filters = spark.sparkContext.broadcast((bitmap_of(kept), bitmap_of(dropped)))

    def told(sure: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yes, no = filters.value
            for b in batches:
                ctx = b.column(b.schema.get_field_index("ctx")).to_numpy().view(np.uint64)
                yield b.filter(pa.array(holds(yes, ctx) & (holds(no, ctx) != sure)))

        return pairs.mapInArrow(trimmed(run), pairs.schema)

    return told(True).unionByName(told(False).join(staying, "ctx", "left_semi"))


def grow(texts: DataFrame, words: DataFrame, total: int, min_count: int = MIN_COUNT, gain: float = GAIN, head: int = HEAD) -> list[tuple[DataFrame, DataFrame]]:
    """The tree's levels: contexts by ``ctx``, and pairs by ``key``, with ``n`` (occurrences) and ``delta``
    (what it adds to a score).  texts: the training texts; words: ``key``, ``n``; total: tokens, kinds and one."""
    spark = texts.sparkSession
    send = spark.sparkContext.broadcast
    least = _head(words, head // 2)
    known, counts = _sorted(words.filter(F.col("n") >= least).toArrow())
    frequent = send((known, counts, np.argsort(-counts, kind="stable").astype(np.int32)))
    parts = lambda keys: send(_sorted(keys.filter(F.col("n") > PART).select("key", F.ceil(F.log2(F.col("n") / PART)).cast("int").alias("bits")).toArrow()))
    hot = parts(words)
    buckets = min(BUCKETS[1], max(BUCKETS[0], total // ADD))
    rare = words.filter(F.col("n") < least).select(F.col("key").alias("x"), F.col("n").alias("xn"))
    passing = together = send(bitmap_of(words.filter(F.col("n") >= min_count).select("key")))
    triples = None
    tree: list[tuple[DataFrame, DataFrame]] = []
    contexts, parents, depth = None, None, 1
    merged, until = None, 1
    while True:
        if depth == until:
            until = depth + SPAN.get(depth, SPAN_DEEP)
            merged = written(_merged(_next_tokens(texts, depth, until - depth, passing, together, triples, hot, frequent, buckets), frequent, min_count), "next-tokens")
            release(spark)
            cut = len(hot.value[0]) > 0
        rows, z = merged.filter("key is null"), F.col("sum") + F.col("share")
        sizes = rows.filter("share is not null").select("ctx", "pctx", "once", "twice", "kinds", "sum")
        if cut:
            of_parts = rows.filter("share is null").groupBy("ctx").agg(F.max("pctx").alias("pctx"), *(F.sum(c).alias(c) for c in ("once", "twice", "kinds", "sum")))
            sizes = sizes.unionByName(of_parts.filter(F.col("once") + F.col("sum") >= min_count))
        if parents is not None:
            sizes = sizes.join(kept.select(F.col("ctx").alias("pctx")), "pctx", "left_semi")
        sizes = written(sizes.drop("pctx").withColumn("share", F.col("once") + F.col("kinds")), "contexts")
        pairs = merged.filter("key is not null").select("ctx", "pkey", "x", "n", "key", "xn", "share", "z")
        if depth == 1:
            together = send(bitmap_of(pairs.filter(F.col("n") >= min_count).select("key")))
            hot.unpersist()
            hot = parts(pairs)
        elif depth == 2:
            triples = passing, send(bitmap_of(pairs.filter(F.col("n") >= min_count).select("key")))
        if cut:
            of_parts = pairs.filter("share is null").drop("share", "z").join(sizes.select("ctx", "share", z.alias("z")), "ctx")
            pairs = pairs.filter("share is not null").unionByName(of_parts)
        if parents is None:
            found = pairs.filter("xn is not null").unionByName(pairs.filter("xn is null").drop("xn").join(rare, "x"))
            pairs = found.withColumn("ps", (F.col("xn") + 1) / F.lit(float(total)))
        # each occurrence left out: of two one is left, which goes to the share
        left = F.when(F.col("n") > 2, F.col("n") * F.log((F.col("n") - 1 + F.col("share") * F.col("ps")) / (F.col("ps") * (F.col("z") - 1)))).otherwise(0.0)
        columns = "ctx", "n", "key", "share", "z", "ps"
        if parents is None:
            seen = [written(pairs.select(*columns), "tree-pairs")]
            release(spark)
        else:
            seen, count = [], portions_of(pairs.count() + parents.count(), total)
            of = F.pmod("pkey", F.lit(count))
            for i in range(count):
                seen.append(written(pairs.filter(of == i).join(parents.filter(of == i), "pkey").select(*columns), "tree-pairs"))
                release(spark)
        pairs = functools.reduce(DataFrame.unionByName, seen)
        if depth + 1 == until:
            forget(merged)
        of_pairs = pairs.groupBy("ctx").agg(F.sum(left).alias("gained"))
        some = F.lit(0.5)
        twice = 2 * F.col("twice") * F.log(F.col("share") / F.greatest(z - 2, some))
        once = F.col("once") * F.log(F.greatest(F.col("share") - 1, some) / F.greatest(z - 1, some))
        gained = F.coalesce("gained", F.lit(0.0)) + F.when(F.col("twice") > 0, twice).otherwise(0.0) + F.when(F.col("once") > 0, once).otherwise(0.0)
        judged = written(sizes.join(of_pairs, "ctx", "left").select("ctx", (F.col("once") + F.col("sum")).alias("n"), F.log10(F.col("share") / z).alias("delta"), (gained >= gain).alias("stays")), "retained")
        kept = judged.filter("stays").drop("stays")
        kept._tidelake_path = judged._tidelake_path
        if kept.isEmpty():
            for b in (frequent, hot, passing, together, *(triples or ())):
                b.unpersist()
            if depth + 1 != until:
                forget(merged)
            forget(*seen, sizes, kept)
            release(spark)
            return tree
        z = F.col("z")
        p = (F.col("n") + F.col("share") * F.col("ps")) / z
        pairs = written(_of_kept(pairs, judged).select("key", "n", p.alias("p"), (F.log10(p / F.col("ps")) - F.log10(F.col("share") / z)).alias("delta")), "tree-level")
        forget(*seen, sizes)
        release(spark)
        tree.append((kept, pairs))
        parents = pairs.select(F.col("key").alias("pkey"), F.col("p").alias("ps"))
        contexts = kept.select(F.col("ctx").alias("key")) if contexts is None else contexts.unionByName(kept.select(F.col("ctx").alias("key")))
        depth += 1
        if depth == until:
            if triples is None or passing is not triples[0]:
                passing.unpersist()
            passing = send(bitmap_of(contexts))
            release(spark)


def score_texts(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, min_count: int = MIN_COUNT, gain: float = GAIN, bits: int = FILTER_BITS) -> DataFrame:
    """One row for each input row: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` (add-one unigrams), ``score`` (the tree's log10 probability).

    trains: which rows the model learns from."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), F.coalesce(trains, F.lit(False)).alias("trains"))
    training = src.filter("trains").select("text")
    words = written(count_tokens(training), "token-counts")
    known = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = known["n"] or 0, known["v"]
    release(spark)
    keys = words.select("key", "n", F.log10(F.col("n") + 1).alias("value"), F.lit("word").alias("kind"))
    levels = grow(training, words, n + v + 1, min_count, gain, head)
    for contexts, pairs in levels:
        keys = keys.unionByName(contexts.select(F.col("ctx").alias("key"), "n", F.col("delta").alias("value"), F.lit("context").alias("kind")))
        keys = keys.unionByName(pairs.select("key", "n", F.col("delta").alias("value"), F.lit("pair").alias("kind")))
    keys = written(keys, "suffix-tree")
    forget(words, *(t for level in levels for t in level))
    least = _head(keys, head)
    is_word = (F.col("kind") == "word").alias("is_word")
    sent = spark.sparkContext.broadcast(_sorted(keys.filter(F.col("n") >= least).select("key", "value", is_word).toArrow()))
    there = spark.sparkContext.broadcast(bitmap_of(keys.select("key"), bits))
    states = spark.sparkContext.broadcast(bitmap_of(keys.filter("kind = 'context'").select("key"), bits))
    rare = keys.filter(F.col("n") < least).select(F.col("key").alias("rare"), "value", is_word)
    found = keys.filter(F.col("n") < least).agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).first()
    portions = portions_of(found["n"] or 0, n)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rare, drop = bucketed(rare, "rare-keys", "rare", min(100_000, max(shuffles, -(-found["kinds"] // JOINED))), portions_of(found["kinds"], n))
    forget(keys)
    release(spark)
    names = ["rid", "key", "doc_id", "held_out", "n_tokens", "n_known", "base", "delta"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (sent_keys, value, is_word), bitmap, contexts = sent.value, there.value, states.value
        places = Places(sent_keys)
        for rows, texts in _gathered(batches, 1, BLOCK):
            h, of, place = tokens(texts)
            sums, rest = np.zeros((3, len(texts))), [(np.zeros(0, dtype=np.int32), h[:0])]

            def add(kinds: np.ndarray, which: np.ndarray, of: np.ndarray) -> None:
                """Sums up keys: different ones, which of them, and of which text."""
                in_tree, i = holds(bitmap, kinds), places.of(kinds)
                mine = in_tree & (i >= 0)
                if mine.any():
                    worth, word = np.where(mine, value[i], 0.0), mine & is_word[i]
                    for k, w in enumerate((word, np.where(word, worth, 0.0), np.where(word, 0.0, worth))):
                        sums[k] += np.bincount(of, weights=w[which], minlength=len(texts))  # noqa: B023
                others = np.flatnonzero((in_tree & ~mine)[which])
                rest.append((of[others], kinds[which[others]]))  # noqa: B023

            kinds, ids = _kinds(h)
            add(kinds, ids, of)
            first = _longer(ROOT, kinds)
            at = np.flatnonzero(place >= 1)
            at = at[holds(contexts, first)[ids[at - 1]]]
            add(first, ids[at - 1], of[at])
            ctx, d = first[ids[at - 1]], 1
            while len(at):
                g = gram(ctx, h[at])
                seen = holds(bitmap, g)
                add(*_kinds(g[seen]), of[at[seen]])
                d += 1
                far = place[at] >= d
                at, ctx = at[far], _longer(ctx[far], h[at[far] - d])
                live = holds(contexts, ctx)
                at, ctx = at[live], ctx[live]
                add(*_kinds(ctx), of[at])
            t = pa.Table.from_batches(rows).combine_chunks()
            column = lambda c: pa.concat_arrays(t.column(c).chunks)  # noqa: E731, B023
            m, rid = len(texts), column("rid").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(rid), _signed(mix(rid.view(np.uint64))), column("doc_id"), column("held_out"), pa.array(np.bincount(of, minlength=m).astype(np.int64)), pa.array(np.rint(sums[0]).astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=names)
            text, key = (np.concatenate(x) for x in zip(*rest, strict=True))
            k = len(key)
            yield pa.RecordBatch.from_arrays([pa.array(rid[text]), _signed(key), pa.nulls(k, t.schema.field("doc_id").type), pa.nulls(k, pa.bool_()), *(pa.nulls(k, x) for x in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=names)

    plus = lambda a, on, b: F.sum(F.coalesce(F.col(a), F.when(on, b), F.lit(0)))
    word, no_word = F.col("is_word"), ~F.col("is_word")
    portion = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(portions))  # by what a row holds: each portion reads the table anew
    sums = []
    for i in range(portions):
        keyed = src.filter(portion == i).select(F.monotonically_increasing_id().alias("rid"), "text", "doc_id", (~F.col("trains")).alias("held_out"))
        out = keyed.mapInArrow(trimmed(run), f"rid long, key long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, delta double")
        met = out.join(rare.hint("shuffle_hash"), (F.col("key") == F.col("rare")) & F.col("n_tokens").isNull(), "left")
        total = met.groupBy("rid").agg(
            F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), plus("n_known", word, F.lit(1)).cast("long").alias("n_known"),
            plus("base", word, F.col("value")).alias("base"), plus("delta", no_word, F.col("value")).alias("delta"),
        )
        sums.append(written(total.drop("rid"), "scores"))
        del keyed, out, met, total
        release(spark)
    drop()
    for b in (sent, there, states):
        b.unpersist()
    total = functools.reduce(DataFrame.unionByName, sums)
    base = F.col("base") - F.col("n_tokens") * math.log10(n + v + 1)
    return total.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("delta")).alias("score"))


def fold(id_col: str = "doc_id", folds: int = 7) -> Column:
    """The fold of a row by its id's CRC-32; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
