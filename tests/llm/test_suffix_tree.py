"""Scores by the suffix tree against a plain one made of dictionaries."""

import collections
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake.llm import suffix_tree as st


def low(text):
    return [*(text or "").encode().lower().split(), None]


class Plain:
    """The tree as its docstring says; counts by tuples of words, root last word first."""

    def __init__(self, texts, min_count, gain):
        self.uni = collections.Counter(w for t in texts for w in low(t))
        self.total = sum(self.uni.values()) + len(self.uni) + 1
        self.states = {}  # context, as it is read -> next tokens
        live = {()}
        while live:
            counts = collections.defaultdict(collections.Counter)
            for t in texts:
                w = low(t)
                for i in range(1, len(w)):
                    for d in range(1, i + 1):
                        if tuple(w[i - d + 1 : i]) not in live:
                            continue
                        counts[tuple(w[i - d : i])][w[i]] += 1
            counts = {c: n for c, n in counts.items() if c[1:] in live and sum(n.values()) >= min_count and self.gain(c, n) >= gain}
            self.states.update(counts)
            live = set(counts)

    def root(self, x):
        return (self.uni[x] + 1) / self.total

    def p(self, context, x):
        if context not in self.states:
            return self.p(context[1:], x) if context else self.root(x)
        return self.of(self.states[context], x, self.p(context[1:], x))

    @staticmethod
    def of(n, x, before):
        seen, share = sum(k for k in n.values() if k > 1), len(n)
        return ((n[x] if n[x] > 1 else 0) + share * before) / (seen + share)

    def gain(self, c, n):
        out = 0.0
        for x, k in n.items():
            rest = n.copy()
            rest[x] -= 1
            rest = collections.Counter({a: b for a, b in rest.items() if b})
            before = self.p(c[1:], x)
            share, seen = len(rest), sum(b for b in rest.values() if b > 1)
            if k == 1:
                out += math.log(max(share, 0.5) / max(seen + share, 0.5))
            elif k == 2:
                out += 2 * math.log(share / max(seen + share, 0.5))
            else:
                out += k * math.log(self.of(rest, x, before) / before)
        return out

    def score(self, text):
        w, longest = low(text), max(map(len, self.states), default=0)
        out = 0.0
        for i, x in enumerate(w):
            d = 0
            while d < min(i, longest) and tuple(w[i - d - 1 : i]) in self.states:
                d += 1
            out += math.log10(self.p(tuple(w[i - d : i]), x))
        return out, sum(math.log10(self.root(x)) for x in w), sum(self.uni[x] > 0 for x in w)


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


OPTIONS = [("docs", {}), ("docs", {"head": 5, "min_count": 3, "gain": 0.5}), ("docs", {"min_count": 2, "gain": 0.1, "bits": 1 << 15}), ("edge", {"min_count": 2, "gain": 0.1}), ("nothing", {})]


@pytest.mark.parametrize("table,options", OPTIONS)
def test_scores(table, options, request):
    df = request.getfixturevalue(table)
    if table == "edge":
        df = df.filter("doc_id is null or doc_id not in (5, 6)")  # plain Python takes too long on these
    rows = [(r.doc_id, r.text) for r in df.collect()]
    plain = Plain([t for i, t in rows if not held(i)], options.get("min_count", st.MIN_COUNT), options.get("gain", st.GAIN))
    assert not options or table != "docs" or max(map(len, plain.states)) >= 2
    want = sorted((-1 if i is None else i, held(i), len(low(t)), plain.score(t)[2], *plain.score(t)[1::-1]) for i, t in rows)
    got = st.score_texts(df, st.fold() != 2, **options).collect()
    mine = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in got)
    assert len(mine) == len(want) and {r.train_tokens for r in got} <= {sum(plain.uni.values())}
    for a, b in zip(mine, want, strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-6)


def test_parts_and_pieces_change_nothing(docs, monkeypatch):
    """Hot contexts in parts, few tokens gathered at a time and texts hashed in small pieces."""
    want = {r.doc_id: r.score for r in st.score_texts(docs, F.lit(True), min_count=3, gain=0.5).collect()}
    monkeypatch.setattr(st, "PART", 16)
    got = {r.doc_id: r.score for r in st.score_texts(docs, F.lit(True), min_count=3, gain=0.5).collect()}
    assert got == pytest.approx(want)
    data = "Ab c\td  ÄÖ\x0bxyz ".encode() * 50
    h, begin = st.word_hashes(data)
    monkeypatch.setattr(st, "PIECE", 7)
    assert all(np.array_equal(a, b) for a, b in zip(st.word_hashes(data), (h, begin), strict=True))
    assert len(h) == len(data.split()) and len(set(h.tolist())) == len({w.lower() for w in data.split()})


def test_order_of_words_matters_and_contexts_help(spark):
    rng = random.Random(3)
    follows = {w: rng.sample("abcdefghijklmnopqrst", 3) for w in "abcdefghijklmnopqrst"}

    def text():
        w = ["a"]
        while len(w) < 60:
            w.append(rng.choice(follows[w[-1]]))
        return w

    rows = [(i, " ".join(text())) for i in range(400)]
    mixed = [(1000 + i, " ".join(rng.sample(t.split(), 60))) for i, t in rows[:50]]
    df = spark.createDataFrame(rows + mixed, "doc_id long, text string")
    got = st.score_texts(df, (F.col("doc_id") < 1000) & (F.col("doc_id") % 5 > 0)).collect()
    out = [r for r in got if r.held_out and r.doc_id < 1000]
    assert len(out) == 80 and all(r.n_known == r.n_tokens and r.score > r.base_score + 20 for r in out)
    score = {r.doc_id: r.score for r in got}
    assert all(score[1000 + i] < score[i] for i in range(50)) and score[1000] != score[1001]


def test_probabilities_sum_to_one(docs):
    """The tokens after any context, with one unknown token, have probability one together."""
    plain = Plain([r.text for r in docs.collect()], 3, 0.5)
    for c in [(), *list(plain.states)[::7]]:
        assert sum(plain.p(c, x) for x in [*plain.uni, b"unknown"]) == pytest.approx(1)


def test_long_words(edge):
    got = st.score_texts(edge, F.lit(True), min_count=2, gain=0.1).collect()
    assert len(got) == edge.count() and all(math.isfinite(r.score) for r in got)


def test_rare_keys_move_in_portions_and_tables_go(spark, docs, monkeypatch):
    """No portion of the texts moves more than one rare key for ``APART`` tokens or so, each row is in
    one portion, and only the scores stay in the shared folder."""
    of = lambda rows: sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in rows)
    want = of(st.score_texts(docs, st.fold() != 2, min_count=3, gain=0.5).collect())
    made, written = [], st.written
    monkeypatch.setattr(st, "written", lambda df, name: made.append(written(df, name)) or made[-1])
    got = st.score_texts(docs, st.fold() != 2, min_count=3, gain=0.5, head=5)
    assert of(got.collect()) == want
    left = [t for t in made if os.path.exists(t._tidelake_path.removeprefix("file://"))]
    assert len(left) >= 4 and all("/scores-" in t._tidelake_path for t in left)
    sizes = [t.count() for t in left]
    assert sum(sizes) == len(want) and max(sizes) < 2 * len(want) / len(sizes)


def test_rare_contexts_end_where_they_are_counted(docs, monkeypatch):
    """Contexts seen less than ``min_count`` times aren't in the tables of next tokens, at any depth."""
    seen, written = [], st.written

    def noted(df, name):
        out = written(df, name)
        if name == "next-tokens":
            seen.append(out.groupBy("ctx").agg(F.sum(F.col("once") + F.col("sum")).alias("n")).filter("n < 3").count())
        return out

    monkeypatch.setattr(st, "written", noted)
    st.grow(*_counted(docs), min_count=3, gain=0.5)
    assert len(seen) >= 2 and not any(seen)


def test_lists_of_next_tokens_are_small(docs, monkeypatch):
    """A list takes less than half of 16 bytes for a context and 4 for a token after it."""
    size, least, lists, written = [], [], st._next_tokens, st.written

    def noted(*args):
        out = lists(*args)
        size.append(out.agg(F.sum(sum(F.octet_length(c) for c, kind in out.dtypes if kind == "binary")).alias("n")).first().n)
        return out

    def counted(df, name):
        out = written(df, name)
        if name == "next-tokens":
            n = out.agg(F.count("once").alias("contexts"), F.sum(F.col("once") + F.col("kinds")).alias("tokens")).first()
            least.append(16 * n.contexts + 4 * n.tokens)
        return out

    monkeypatch.setattr(st, "_next_tokens", noted)
    monkeypatch.setattr(st, "written", counted)
    st.grow(*_counted(docs), min_count=1, gain=1e9)
    assert least[0] > 1000 and 2 * size[0] < least[0]


def test_full_bitmaps_and_portions_change_no_score(spark, monkeypatch):
    """Pairs of kept contexts, met in portions, where bitmaps hold next to nothing apart."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(12)) + " w x y z" for _ in range(120)]
    plain = Plain(texts, 3, 0.1)
    assert max(map(len, plain.states)) >= 2
    made, written, bitmap = [], st.written, st.bitmap_of
    monkeypatch.setattr(st, "written", lambda df, name: made.append(name) or written(df, name))
    monkeypatch.setattr(st, "bitmap_of", lambda keys, bits=0: np.full_like(bitmap(keys, 1 << 15), 255))
    monkeypatch.setattr(st, "FEW", 0)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.score for r in st.score_texts(df, F.lit(True), min_count=3, gain=0.1, head=5).collect()}
    assert got == pytest.approx({i: plain.score(t)[0] for i, t in enumerate(texts)})
    assert made.count("tree-pairs") > made.count("contexts")


def _counted(docs):
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    words = st.count_tokens(texts).cache()
    n = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    return texts, words, n.n + n.v + 1
