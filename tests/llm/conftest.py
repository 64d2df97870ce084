import random

import pytest

SYLLABLES = {"en": "the and th er on an re ing ed ou".split(), "de": "der und sch ein ung keit ver ö ü ach".split(), "fr": "le la des eau que é è tion ai oi".split()}


def prose(rng, lang, words):
    """Made-up words of a language."""
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars): texts in three languages with copies and near copies."""
    rng, rows = random.Random(7), []
    for i in range(150):
        lang = rng.choice(["en", "en", "de", "fr"])
        rows.append([i, prose(rng, lang, rng.randint(20, 200)), lang, f"src{0 if rng.random() < 0.4 else rng.randint(1, 12)}"])
    for i in range(150, 170):
        rows.append([i, rows[i % 7][1], rows[i % 7][2], "src0"])
    for i in range(170, 180):
        words = rows[i - 100][1].split()
        words[len(words) // 2] = "changed"
        rows.append([i, " ".join(words), rows[i - 100][2], "src3"])
    return [(*r, len(r[1])) for r in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


#: Nulls, empty and very long texts, ties and repeated rows, with columns named like those inside.
CLASHING = ("rid", "name", "level", "digest", "fp", "word", "bin", "h", "key", "host", "pos", "score", "kept", "copies", "lang_pred", "rejected", "_id", "component_id", "keep_id", "spans", "start")
EDGE = [
    (1, None, None, None), (2, "", "en", "src1"), (3, "a", "en", None), (4, " \t\n ", "en", "src1"), (5, "x y z w v " * 6000, "en", "src1"), (6, "x" * 70_000, "de", "src2"),
    (7, "same text of several words", "en", "src1"), (8, "same text of several words", "en", "src1"), (8, "same text of several words", "en", "src1"), (9, None, "en", "src1"),
    (None, "no id here", "en", "src1"), (None, None, None, None), (10, "12345 !!! ... 99", "en", "src2"), (11, "ÄÖÜ ß İ Σ 🙂 中文́", "de", "src2"), (12, "\x00 nul <|endoftext|> x", "en", "src2"),
]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(*r, len(r[1] or ""), *(f"{i}" for _ in CLASHING)) for i, r in enumerate(EDGE)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)).repartition(4).cache()


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
