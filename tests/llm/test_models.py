"""Mixing, language-model scores, language, quality, neighbours and the pipeline."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelake.llm import ann, language_id, mixing, quality, queries



def tokens():
    return F.regexp_count(F.col("text"), F.lit(r"\S+"))


def domain():
    return F.when(F.col("source") == "src0", "big").otherwise("small")


WEIGHTS = {"domain": {"big": 1.0, "small": 3.0}, "lang": {"en": 1.0, "de": 2.0, "*": 1.0}, "source": {"src1": 0.0}}


def shares(budget, children):
    """Water-filling by repeated rounds: what a full child leaves goes to the others by weight."""
    given = dict.fromkeys(children, 0.0)
    left, live = budget, {c for c, (w, cap) in children.items() if w > 0 and cap > 0}
    while live and left > 1e-9:
        total = sum(children[c][0] for c in live)
        step = {c: min(left * children[c][0] / total, children[c][1] - given[c]) for c in live}
        for c, s in step.items():
            given[c] += s
        left -= sum(step.values())
        live = {c for c in live if children[c][1] - given[c] > 1e-9}
    return given


def brute_budgets(leaves, budget, epochs):
    weight = lambda level, n: WEIGHTS[level].get(n, WEIGHTS[level].get("*", 1.0))
    cap = {k: t * epochs if all(weight(lv, n) > 0 for lv, n in zip(mixing.LEVELS, k, strict=True)) else 0 for k, t in leaves.items()}

    def down(prefix, b):
        if len(prefix) == 3:
            return {prefix: b}
        level = mixing.LEVELS[len(prefix)]
        names = {k[len(prefix)] for k in leaves if k[: len(prefix)] == prefix}
        given = shares(b, {n: (weight(level, n), sum(c for k, c in cap.items() if k[: len(prefix) + 1] == (*prefix, n))) for n in names})
        return {k: v for n in names for k, v in down((*prefix, n), given[n]).items()}

    return down((), budget)


@pytest.mark.parametrize("fraction,epochs", [(0.3, 1), (0.9, 2), (5.0, 2)])
def test_mixing(docs, fraction, epochs):
    got = mixing.mix(docs, WEIGHTS, fraction, domain(), tokens(), epochs, buckets=8).collect()
    assert len(got) == docs.count()
    leaves, taken, sizes = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for r in got:
        k = (r.domain, r.lang, r.source)
        leaves[k] += r.n_tokens
        taken[k] += r.n_tokens * r.copies
        sizes[k].append(r.n_tokens)
    want = brute_budgets(leaves, sum(leaves.values()) * fraction, epochs)
    for k, b in want.items():  # the longest prefix within the budget
        assert taken[k] <= b + 1e-6 and b - taken[k] <= max(sizes[k]) + 1e-6
    assert all(r.copies == 0 for r in got if r.source == "src1") and max(r.copies for r in got) <= epochs
    again = mixing.mix(docs.repartition(5), WEIGHTS, fraction, domain(), tokens(), epochs, buckets=8).collect()
    assert sorted(r[:-1] for r in map(tuple, again)) == sorted(r[:-1] for r in map(tuple, got))


def test_mixing_prefix_order(docs):
    """Within a leaf what is taken comes first in the seeded order, whatever the buckets."""
    a = {r.doc_id: r.copies for r in mixing.mix(docs, {}, 0.5, F.lit("d"), tokens(), 1, buckets=1).collect()}
    assert 0 < sum(a.values()) < len(a)
    rows = mixing.mix(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), {}, 0.5, F.lit("d"), tokens(), 1, buckets=1).withColumn("h", F.xxhash64(F.lit(11), F.lit(0).cast("long"), "doc_id", "n_tokens", F.lit(None).cast("long"))).orderBy("h").collect()
    copies = [r.copies for r in rows]
    assert copies == sorted(copies, reverse=True)


def test_mixing_edges(edge, nothing):
    assert mixing.mix(edge, WEIGHTS, 0.5, domain(), tokens()).count() == edge.count() and mixing.mix(nothing, WEIGHTS, 0.5, domain(), tokens()).count() == 0
    assert mixing.mixed_documents(edge, {}, 1.0, domain(), tokens(), 1).columns == edge.columns
    twice = mixing.mixed_documents(edge.filter("doc_id < 8"), {}, 2.0, domain(), tokens(), 2)
    assert twice.columns == edge.columns and twice.filter("doc_id = 7").count() == 2


def test_languages(docs):
    got = language_id.held_out_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_language_edges(edge, nothing, docs):
    made = language_id.dictionaries(docs)
    got = {(r.doc_id, r.lang_pred, r.rejected) for r in language_id.identify(edge, made).collect()}
    assert {(1, "und", True), (2, "und", True), (4, "und", True), (10, "und", True)} <= got and language_id.identify(edge, made).count() == edge.count()
    assert language_id.held_out_languages(nothing).count() == 0 and {r.lang_pred for r in language_id.identify(edge, {}).collect()} == {"und"}
    assert {r.lang_pred for r in language_id.identify(edge, {"en": made["en"]}).collect()} == {"en", "und"}
    assert language_id.in_known_languages(edge).columns == edge.columns
    a, b = language_id.dictionaries(docs), language_id.dictionaries(docs.repartition(7).orderBy(F.rand(3)))
    assert a == b


def test_language_sample_is_bounded(spark, monkeypatch):
    """Ids that repeat or are missing bring no more texts than others; whole texts are taken."""
    rows = [(None, f"null {'abcdefgh'[i % 8]} word{'x' * (i % 50)} {'y' * (i % 77)}", "en") for i in range(3000)] + [(7, "same", "en")] * 500 + [(i, "z" * 5000 + " tail", "de") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    seen = []
    monkeypatch.setattr(language_id, "letters", lambda t: seen.append(t) or t)
    made = language_id.dictionaries(df, texts=20)
    assert sum("null" in t or t == "same" for t in seen) == 20 and len(made["de"]) == 3 * 5005 + 2


def brute_language(text, made):
    """The language by one compression with each whole dictionary a block, without the second measure."""
    import re

    import zstandard as zstd

    plain = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip().encode()
    if not plain:
        return "und", None
    params = zstd.ZstdCompressionParameters.from_level(language_id.LEVEL, write_content_size=False, write_dict_id=False)
    sizes = {}
    for lang, d in made.items():
        c = zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=params)
        sizes[lang] = sum(len(c.compress(plain[i : i + language_id.BLOCK])) for i in range(0, len(plain), language_id.BLOCK))
    best = min(sorted(sizes), key=sizes.get)
    second = min(v for k, v in sizes.items() if k != best)
    return best, (second - sizes[best]) / second


def test_languages_by_brute_force(docs):
    made = language_id.dictionaries(docs)
    clear = 0
    got = {r.doc_id: r for r in language_id.identify(docs, made).collect()}
    for r in docs.collect():
        lang, margin = brute_language(r.text, made)
        if margin is None or margin >= 2 * language_id.MIN_MARGIN:
            clear += 1
            assert got[r.doc_id].lang_pred == lang
            assert margin is None or got[r.doc_id].score == pytest.approx(margin, abs=0.03)  # frames differ by a few bytes
    assert clear > 100


def test_quality(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(600):
        host = f"h{i % 6}" if i < 590 else "tiny"
        good = rng.random() < (0.9 if host != "h5" else 0.2)
        word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
        rows.append((i, " ".join(word() + ("" if good else "$$$") for _ in range(40)), host, f"p{i % 2}"))
        if i % 3 == 0:
            labels.append((i, int(good)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.classify(docs, known, F.col("host"), F.col("path")).collect()
    good = {i: "$" not in t for i, t, _, _ in rows}
    assert len(got) == 600 and np.mean([r.kept == good[r.doc_id] for r in got]) > 0.97
    host = {r.host: r.p_host for r in got}
    assert host["h5"] < 0.5 < host["h0"] and min(host.values()) <= host["tiny"] <= max(host.values())


def test_quality_posteriors(spark):
    """The posteriors against sums over all other rows, one by one."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["fine", "good", "spam", "junk"], 30, p=[0.4, 0.4, 0.1, 0.1] if i % 4 else [0.1, 0.1, 0.4, 0.4])), f"h{i % 3}", f"p{i % 2}") for i in range(120)]
    labels = [(i, int(i % 4 > 0)) for i in range(0, 120, 2)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = sorted(quality.classify(docs, known, F.col("host"), F.col("path")).collect())
    label = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 5}
    assert [r.held_out for r in got] == [zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got]
    w = {r.doc_id: 5.0 if r.doc_id in label else 1.0 for r in got}
    v = {r.doc_id: label.get(r.doc_id, r.p_text) for r in got}
    sums = lambda of: (sum(w[r.doc_id] for r in of), sum(w[r.doc_id] * v[r.doc_id] for r in of))

    def strength(groups):
        """groups: rows of each group, and the mean around which they lie."""
        between = within = total = 0.0
        for of, mean in groups:
            n, s = sums(of)
            m, total = s / n, total + n
            between, within = between + n * (m - mean) ** 2, within + sum(w[r.doc_id] * (v[r.doc_id] - m) ** 2 for r in of)
        noise = within / max(1.0, total - len(groups))
        extra = max(0.0, (between - len(groups) * noise) / total)
        return min(10_000.0, max(1.0, noise / extra)) if extra > 0 else 10_000.0

    n, s = sums(got)
    hosts = {h: [r for r in got if r.host == h] for h in ("h0", "h1", "h2")}
    paths = {(h, p): [r for r in of if r.path == p] for h, of in hosts.items() for p in ("p0", "p1")}
    a = strength([(of, s / n) for of in hosts.values()])
    shrunk = {h: (sums(of)[1] + a * s / n) / (sums(of)[0] + a) for h, of in hosts.items()}
    b = strength([(of, shrunk[h]) for (h, _), of in paths.items()])
    for r in got:
        def others(of):
            return sums([o for o in of if o.doc_id != r.doc_id])

        (n0, s0), (n1, s1), (n2, s2) = others(got), others(hosts[r.host]), others(paths[r.host, r.path])
        p_host = (s1 + a * s0 / n0) / (n1 + a)
        p_path = (s2 + b * p_host) / (n2 + b)
        odds = np.log(r.p_text / (1 - r.p_text)) + np.log(p_path / (1 - p_path)) - np.log(s0 / n0 / (1 - s0 / n0))
        assert (r.p_host, r.p_path) == pytest.approx((p_host, p_path), rel=1e-6) and r.quality == pytest.approx(1 / (1 + np.exp(-odds)), rel=1e-5)


def test_quality_grams():
    """Blocks don't change the vector, order does; every byte of a long text counts."""
    text = ("some words é " * 3000 + "x" * 5000 + " the end").encode()
    whole, block = quality.grams(text), quality.BLOCK
    try:
        quality.BLOCK = 1000
        assert np.allclose(quality.grams(text), whole, atol=1e-6)
    finally:
        quality.BLOCK = block
    assert not np.allclose(quality.grams(b"a b c d"), quality.grams(b"d c b a")) and not quality.grams(b"").any()
    assert not np.allclose(quality.grams(text + b" unlike"), whole, atol=1e-6)


def test_quality_held_out(spark):
    """Labels that were never seen are told from texts."""
    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op8_quality(spark, sf_dir).collect() if r.held_out}
    known = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.doc_id in got and r.quality is not None]
    assert len(known) >= 5 and np.mean([r.kept == bool(y) for r, y in known]) >= 0.9


def test_quality_edges(edge, nothing, spark):
    labels = spark.createDataFrame([(2, 1), (3, 0), (3, None), (7, 1)], "doc_id long, quality int")
    assert quality.classify(edge, labels, F.col("source"), F.col("lang")).count() == edge.count()
    assert quality.classify(nothing, labels, F.col("source"), F.col("lang")).count() == 0
    none = quality.classify(edge, labels.limit(0), F.col("source"), F.col("lang")).collect()
    assert all(r.p_text == 0.5 for r in none)
    r = spark.createDataFrame([("http://A.example.com/en/1?x",)], "u string").select(quality.url_host(F.col("u")).alias("h"), quality.url_path(F.col("u")).alias("p")).first()
    assert (r.h, r.p) == ("a.example.com", "/en")


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((900, 40)).astype(np.float32) * rng.uniform(0.5, 2, (900, 1)).astype(np.float32)
    vectors[100:400] = vectors[0]  # one very common vector
    vectors[500:505] = vectors[499]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    rows += [(1000, None, "x"), (1020, [0.0] * 40, "x"), (1040, [float("nan")] * 40, "x"), (1060, [float("inf")] * 40, "x"), (1080, [1.0, 2.0], "x"), (1081, [2.0, 1.0], "x"), (1100, [], "x"), (1120, [1.0, None], "x"), (None, [1.0] * 40, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id string").repartition(5)
    exact = vectors.astype(np.float64)
    for group in (ann.GROUP_BYTES, 200 * 8 * 40):
        got = collections.defaultdict(list)
        for r in ann.nearest(df, F.col("vec_id") % 20 == 0, group_bytes=group).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        assert set(got) == {*range(0, 900, 20), 1080} and got[1080] == [(1081, 4.0)]
        hits = 0
        for q in range(0, 900, 20):
            score = np.einsum("ij,j->i", exact, exact[q])
            score[q] = -np.inf
            want = np.lexsort((np.arange(900), -np.round(score, 9)))[:20]
            hits += len(set(want) & {v for v, _ in got[q]})
            assert len(got[q]) == 20 and all(s == pytest.approx(score[v]) for v, s in got[q])
        assert hits >= 0.97 * 45 * 20
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_neighbours_of_repeated_ids(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 1.0]), (2, [3.0, 1.0])], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") == 0, k=4).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 2, 3.0), (0, 2, 3.0), (0, 1, 2.0), (0, 1, 2.0)]


def test_rotation_is_a_rotation():
    r = ann.rotation(33, 5)
    assert np.allclose(r @ r.T, np.eye(33)) and np.array_equal(r, ann.rotation(33, 5))


def test_pipeline_stages(spark, docs, tmp_path):
    """Each stage on all that the one before kept, against its operator's plain version."""
    docs.unionByName(spark.createDataFrame([(900, None, None, "src1", 0), (901, "123 456", "en", "src1", 7)], docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    step = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mixed", "packed"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    a = step["language"](spark, rows, str(tmp_path)).cache()
    assert a.columns == rows.columns and {900, 901}.isdisjoint(ids(a)) and len(ids(a)) >= 0.98 * docs.count()
    b = step["exact"](spark, a, str(tmp_path)).cache()
    last = {}
    for r in a.collect():
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert ids(b) == set(last.values()) and b.columns == rows.columns
    c = step["near"](spark, b, str(tmp_path)).cache()
    assert ids(c) <= ids(b) and c.columns == rows.columns and len(ids(b)) - len(ids(c)) <= 10
    d = step["mixed"](spark, c, str(tmp_path)).cache()
    assert ids(d) <= ids(c) and d.count() == len(ids(d)) and d.columns == rows.columns
    e = step["packed"](spark, d, str(tmp_path)).collect()
    assert {r.doc_id for r in e} == ids(d)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids(d)


def test_pipeline_of_nothing(spark, nothing, tmp_path):
    nothing.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {*(f"op{i}" for i in range(1, 11)), "pipeline"}


def taken_by_hand(rows, budget, epochs, order):
    """rows of one leaf: (id, tokens); the multiset of (id, tokens, copies) by whole epochs and a prefix."""
    total = sum(t for _, t in rows)
    whole = min(int(budget // total), epochs) if total else (epochs if budget > 0 else 0)
    left, out, open_ = int(budget - whole * total), collections.Counter(), True
    for i, t in sorted(rows, key=order(whole)):
        open_ = open_ and t <= left
        left -= t if open_ else 0
        out[i, t, whole + open_] += 1
    return out


def test_mixing_takes_rows_each_for_itself(spark):
    """Ids that occur in several leaves, repeat in one, or are missing."""
    rows = [(i % 23 if i % 5 else None, 3 + i * 7 % 11, "en" if i % 2 else "de", f"src{i % 3}") for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, t long, lang string, source string").repartition(3)
    got = mixing.mix(df, {"lang": {"en": 2.0}}, 0.55, F.lit("d"), F.col("t"), 1, buckets=4).collect()
    sizes = collections.Counter()
    for _, t, lang, source in rows:
        sizes["d", lang, source] += t
    want = mixing.budgets(spark.createDataFrame([(*k, t) for k, t in sizes.items()], "domain string, lang string, source string, tokens long"), {"lang": {"en": 2.0}}, sum(sizes.values()) * 0.55, 1).collect()
    for leaf in want:
        mine = [r for r in got if (r.lang, r.source) == (leaf.lang, leaf.source)]
        taken = sum(r.n_tokens for r in mine if r.copies)
        rest = [r.n_tokens for r in mine if not r.copies]
        assert taken <= leaf.budget and (not rest or taken + max(rest) > leaf.budget)  # no row that fits for sure is left
        if any(r.doc_id is None for r in mine) and not rest:
            assert all(r.copies for r in mine)
    ids = [r for r in rows if r[0] is not None]
    df = spark.createDataFrame(ids, df.schema)
    got = mixing.mix(df, {}, 0.5, F.lit("d"), F.col("t"), 1, buckets=1).collect()
    hashes = {(r.doc_id, r.t): r.h for r in df.distinct().select("doc_id", "t", F.xxhash64(F.lit(11), F.lit(0).cast("long"), "doc_id", "t", F.lit(None).cast("long")).alias("h")).collect()}
    for k in {(r.lang, r.source) for r in got}:
        leaf = [(i, t) for i, t, lang, source in ids if (lang, source) == k]
        budget = mixing.budgets(df.groupBy(F.lit("d").alias("domain"), "lang", "source").agg(F.sum("t").alias("tokens")), {}, sum(t for _, t, _, _ in ids) * 0.5, 1).filter((F.col("lang") == k[0]) & (F.col("source") == k[1])).first().budget
        assert collections.Counter((r.doc_id, r.n_tokens, r.copies) for r in got if (r.lang, r.source) == k) == taken_by_hand(leaf, budget, 1, lambda whole: lambda r: (hashes[r], r[0]))


def test_mixed_documents_without_ids(spark):
    """Rows without an id, and rows that repeat, are taken as often as their tokens allow."""
    df = spark.createDataFrame([(None, "a b c", "en", "s")] * 20 + [(1, "a b c", "en", "s")] * 20, "doc_id long, text string, lang string, source string")
    assert mixing.mixed_documents(df, {}, 0.5, F.lit("d"), F.regexp_count("text", F.lit(r"\S+"))).count() == 20
    by_key = lambda docs, carry: docs.select(*(c.alias(n) for n, c in carry.items()), F.lit(3).alias("n_tokens"))
    assert mixing.mixed_documents(df, {}, 1.5, F.lit("d"), by_key, 2).count() == 60
