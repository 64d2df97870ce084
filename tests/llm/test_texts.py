"""Operators on texts against plain Python: tokens, exact and near copies, packing, personal data."""

import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from tidelake.llm import _chunks, _components, exact_dedup, packing, pii, similar, simhash, token_counts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b ", " ", "  ", "\n", "\t", "<|endoftext|>", "<|startoftext|>", "'s", "don't", "é", "é", "İ", "Σ", "ß", " ", "\x1c", "\x85", "1", "23", "!!", "…", "中", "🙂", " the", "x" * 50, "\r\n", "\0", "́"]


@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_chunks_are_as_whole_texts(text):
    assert _chunks.counter(WORD)(text.encode()) == len(Tokenizer_of(WORD).encode(text, add_special_tokens=False).ids)
    assert np.frombuffer(_chunks.encoder(BYTE)(text.encode()), "<u4").tolist() == Tokenizer_of(BYTE).encode(text, add_special_tokens=False).ids


@cache
def Tokenizer_of(path):
    return Tokenizer.from_file(path)


def test_memo_forgets_and_still_answers(monkeypatch):
    monkeypatch.setattr(_chunks, "REMEMBERED", 5)
    memo = _chunks._Memo(lambda chunks: [len(c) for c in chunks])
    for i in range(50):
        words = ["a" * (1 + (i * k) % 23) for k in range(6)]
        assert memo.of(words) == [len(w) for w in words] and len(memo.young) <= 12


@pytest.mark.parametrize("table", ["docs", "edge", "nothing"])
def test_token_counts(table, request):
    df = request.getfixturevalue(table)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, WORD).collect())
    n = lambda t: len(Tokenizer_of(WORD).encode(t or "", add_special_tokens=False).ids)
    assert got == sorted((r.doc_id or -1, len((r.text or "").encode()), n(r.text), n(r.text) > 2048) for r in df.collect())


def test_cache_is_used_and_appended(spark, docs, tmp_path):
    path = str(tmp_path / "cache")
    few = docs.filter("doc_id < 50")
    token_counts.count_tokens(few, WORD, path).collect()
    cache = spark.read.parquet(path)
    n = cache.count()
    assert n == few.select("text").distinct().count()
    got = token_counts.count_tokens(docs, WORD, path)
    assert got.count() == docs.count() and spark.read.parquet(path).count() == docs.select("text").distinct().count()
    # a stored count is taken as it is
    spoiled = cache.selectExpr("digest", "n_tokens + 1000000 as n_tokens", "tokenizer")
    spoiled.write.partitionBy("tokenizer").parquet(str(tmp_path / "spoiled"))
    assert min(r.n_tokens for r in token_counts.count_tokens(few, WORD, str(tmp_path / "spoiled")).collect()) > 1_000_000


def test_each_digest_is_encoded_once(spark, tmp_path):
    """Copies, also with one id or none: one row a digest, and no new file where nothing is missing."""
    rows = [(i % 3 if i % 2 else None, f"text number {i % 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    first = token_counts.count_tokens(df, WORD, str(tmp_path)).collect()
    cache = spark.read.parquet(str(tmp_path))
    assert len(first) == 40 and cache.count() == cache.select("digest").distinct().count() == 2
    assert sorted(map(str, token_counts.count_tokens(df, WORD, str(tmp_path)).collect())) == sorted(map(str, first))
    assert spark.read.parquet(str(tmp_path)).count() == 2


@pytest.mark.parametrize("block", [1, 7, 64, 8192])
def test_exact_names_small_blocks(docs, block):
    check_exact(docs.filter("doc_id % 5 = 0"), block)


@pytest.mark.parametrize("table", ["docs", "edge", "nothing"])
def test_exact(table, request):
    check_exact(request.getfixturevalue(table), exact_dedup.BLOCK_BYTES)


def check_exact(df, block):
    rows = df.collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    got = exact_dedup.exact_dedup(df, block_bytes=block).collect()
    top = lambda ids: max((i for i in ids if i is not None), default=None)
    want = sorted((r.doc_id or -1, top(groups[r.text or ""]) or -1, len(groups[r.text or ""]), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows)
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(not r.kept or r.doc_id == r.keep_id for r in got)
    stay = exact_dedup.distinct_documents(df, block_bytes=block)
    assert stay.columns == df.columns and sorted((r.text or "") for r in stay.collect()) == sorted(groups)


def test_names_survive_equal_hashes(docs, monkeypatch):
    """Blocks that share a hash are told apart by content."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    check_exact(docs.filter("doc_id < 12 or doc_id between 150 and 160").drop("n_chars"), 64)


def test_names_are_ranks(docs):
    """Names don't depend on how the rows are dealt; only blocks that share a hash are found by content."""
    name = lambda df: {r.doc_id: (r.level, r.name) for r in exact_dedup.name_texts(df, block_bytes=64).collect()}
    few = docs.filter("doc_id < 40")
    assert name(few) == name(few.repartition(7, "text"))


def test_few_equal_hashes(docs, monkeypatch):
    """Some hashes are shared, most aren't."""
    from pyspark.sql import functions as F

    own = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: own(*c) % 50)
    check_exact(docs.filter("doc_id < 30 or doc_id between 150 and 160"), 64)


def brute_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("table,radius,tile", [("docs", 2, 1024), ("docs", 7, 4), ("edge", 2, 1024), ("nothing", 2, 1024)])
def test_near_duplicates(table, radius, tile, request):
    df = request.getfixturevalue(table)
    rows = df.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text, 3) for r in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    want = sorted((r.doc_id or -1, f"{prints[i]:016x}", least.get(find(i), -1)) for i, r in enumerate(rows))
    got = simhash.near_duplicates(df, radius=radius, tile=tile).collect()
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id if r.component_id is not None else -1) for r in got) == want
    assert simhash.representatives(df, radius=radius).columns == df.columns


@given(st.lists(st.integers(1, 140), min_size=1, max_size=6), st.integers(0, 5), st.integers(0, 1 << 30))
@settings(max_examples=25, deadline=None)
def test_bit_sliced_pairs(sizes, radius, seed):
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 1 << 63, 3).astype(np.uint64)[rng.integers(0, 3, sum(sizes))]
    for _ in range(3):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64)) * rng.integers(0, 2, len(fps)).astype(np.uint64)
    group = np.repeat(np.arange(len(sizes)), sizes)
    i, j = simhash.near_pairs(fps, group, radius)
    near = (np.bitwise_count(fps[:, None] ^ fps[None]) <= radius) & (group[:, None] == group[None])
    assert len(i) == len(set(zip(i.tolist(), j.tolist(), strict=True))) and set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(np.triu(near, 1))), strict=True))


def brute_representatives(rows, words=5):
    """Ids that stay, by the similarity of all pairs of (id, text)."""

    def cut(text):
        w = (text or "").encode().lower().split()
        return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}

    sets, root = [cut(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return {i for (i, _), r in zip(rows, root, strict=True) if i == least[r]}


def test_near_stage_by_brute_force(spark):
    """Words changed here and there so that similarities lie around 0.8, a passage that many texts
    have, copies of copies: nothing goes that shouldn't, and nine tenths of what should go at least."""
    rng, rows = random.Random(5), []
    word = lambda: f"w{rng.randrange(4000)}"
    common = [word() for _ in range(20)]
    for i in range(120):
        words = [word() for _ in range(rng.randint(30, 250))] + common * (i % 3 == 0)
        rows.append((i, " ".join(words)))
        for k in range(rng.randint(1, 2)):
            words = list(words)
            for _ in range(rng.randint(0, len(words) // 30)):
                words[rng.randrange(len(words))] = word()
            rows.append((1000 + 10 * i + k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    every = {i for i, _ in rows}
    goes = every - brute_representatives(rows)
    assert 80 < len(goes) < len(rows) - 125
    gone = every - {r.doc_id for r in corpus_pipeline.near(spark, df, "").collect()}
    assert gone <= goes and len(gone) >= 0.9 * len(goes)


def test_a_large_group_costs_a_link_a_copy(spark):
    """Near copies of one text: pairs that are looked at grow with the copies, not with their square."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows = []
    for i in range(400):
        own = list(words)
        own[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert [r.doc_id for r in similar.representatives(df).collect()] == [0]
    for changes in (1, 5):  # with five, copies are similar to the text, but few to each other
        rows = [(0, " ".join(words))]
        for i in range(1, 400):
            own = list(words)
            for _ in range(changes):
                own[rng.randrange(300)] = f"x{rng.random()}"
            rows.append((i, " ".join(own)))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        nodes = similar._nodes(similar._texts(df, "doc_id", "text"), 5, 42)
        per, near = similar.near_fingerprints(nodes)
        pairs = similar.first_pairs(nodes, per, near)
        assert 390 <= pairs.count() <= 20 * 400
        good = similar._verified(similar.possible(pairs, nodes), similar._sets(similar._texts(df, "doc_id", "text"), nodes, pairs, 5, 42))
        rest = similar.other_pairs(nodes, per, near, _components.components(good))
        assert rest.count() <= 20 * 400
        left = [r.doc_id for r in similar.representatives(df).collect()]
        assert 0 in left and len(left) <= 8  # the others lie beyond the radius


@pytest.mark.parametrize("table", ["docs", "edge", "nothing"])
def test_similar_representatives(table, request):
    df = request.getfixturevalue(table)
    got = similar.representatives(df)
    assert got.columns == df.columns
    want = brute_representatives([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    ids = lambda rows: sorted(r.doc_id if r.doc_id is not None else -1 for r in rows)
    assert ids(got.collect()) == ids(r for r in df.collect() if r.doc_id in want)


@pytest.mark.parametrize("radius,agree", [(2, 2), (3, 2), (7, 2), (7, 3), (1, 4)])
def test_tables_miss_no_link(radius, agree):
    tables, rng = simhash.masks(radius, agree), random.Random(1)
    for _ in range(500):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
        assert any(not diff & t for t in tables)


def test_components_of_a_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in _components.components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


@given(st.lists(st.integers(1, 64), max_size=60), st.integers(64, 100))
@settings(max_examples=60, deadline=None)
def test_windows_hold_their_capacity(sizes, capacity):
    sizes = np.array(sizes, dtype=np.int64)
    w = packing.windows(sizes, capacity)
    assert len(w) == len(sizes) and (not len(w) or np.bincount(w, weights=sizes).max() <= capacity)


def test_differencing_levels_windows():
    sizes = np.random.default_rng(3).integers(1, 512, 1000)
    load = np.bincount(packing.karmarkar_karp(sizes, 125), weights=sizes)
    assert load.max() - load.min() < 0.01 * load.mean()


@pytest.mark.parametrize("table", ["docs", "edge", "nothing"])
def test_packing(table, request):
    df = request.getfixturevalue(table)
    got = packing.pack(df, BYTE).collect()
    ids = sorted([(r.doc_id or -1, Tokenizer_of(BYTE).encode(r.text or "", add_special_tokens=False).ids + [1]) for r in df.collect()])
    whole = sorted((d, len(i)) for d, i in ids)
    assert sorted((r.doc_id or -1, r.doc_tokens) for r in got if r.start == 0) == whole and sum(r.length for r in got) == sum(n for _, n in whole)
    known = {(d, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())) for d, i in ids for s in {r.start for r in got} for n in {r.length for r in got if r.start == s} if (part := i[s : s + n])}
    assert all((r.doc_id or -1, r.start, r.length, r.ids_crc32) in known for r in got)
    sequences = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values(), default=0) <= 2048


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_pii_against_patterns(spark):
    rng = random.Random(5)
    parts = ["a", "b@", "@", ".", "c.d", "1", "23", "+", "-", " ", "(", ")", "4111 1111 1111 1111", "192.168.0.1", "+1 (913) 555-3797", "255.", "0", "é", "🙂", "x@y.z", "_", "%", "5555555555554444", "000001.2.3.4", "\n", "call ", "GB82 WEST 1234 5698 7654 32"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(1500)] + [(5000, None), (5001, ""), (5002, "a@b.c " * 1500), (5003, "1 " * 3000)]
    texts = dict(rows)
    for r in pii.summary(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        want = base_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in BASE]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in BASE] == want


def test_pii_runs_and_more_kinds(spark):
    """Long runs take linear time, and validated further kinds are found."""
    rows = [(1, "1" * 150_000), (2, "a" * 150_000), (3, "+1" * 40_000), (4, "pay to iban DE89 3704 0044 0532 0130 00 now"), (5, "DE88 3704 0044 0532 0130 00"), (6, "social security 123-45-6789"), (7, "123-45-6789"), (8, "call (555) 123-4567")]
    got = {r.doc_id: r.spans for r in pii.summary(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: "", 2: "", 3: "", 4: "iban:12:39", 5: "", 6: "ssn:16:27", 7: "", 8: "local_phone:5:19"}


def test_pii_edges(edge, nothing):
    assert pii.summary(pii.find_pii(edge)).count() == edge.count() and pii.find_pii(nothing).count() == 0
