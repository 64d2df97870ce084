"""Language identification by compression (operator 7).

Each language has a raw-content zstandard dictionary made of labelled texts.  A text's letters, in
lower case, are compressed in blocks with each dictionary; the language whose dictionary gives the
fewest bytes is chosen.  The score is the margin to the second smallest.  Where it is below
``min_margin`` (short texts whose sizes tie, texts of one repeated word) the text's distinct words
are measured again with several smaller dictionaries of each language, whose sizes are added; where
the margin is narrow still, the text is rejected.

The labelled sample is bounded and doesn't depend on the input's order: of each language the
``SAMPLE_TEXTS`` texts with the smallest hashes of id and text, whole.  As many rows at most leave
the table, also where ids repeat or are missing.  Prediction reads whole texts.

A text that is null or has no letter is ``und``, has score 0 and is rejected.  Of equal sizes the
first language by name is taken, with score 0, and rejected.  Without any labelled text all are ``und``.  A single
language is measured against compression without a dictionary.  Rows with a null language aren't
learned from.  Repeated rows each get a row; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm._shared import ship, trimmed

#: Labelled texts of a language that make its dictionary.
SAMPLE_TEXTS = 96
#: Bytes compressed at a time, so that a long text is judged by the dictionary and not by itself.
BLOCK = 1024
LEVEL = 4
#: Margin below which a text is measured again, then rejected.
MIN_MARGIN = 0.005
#: Smaller dictionaries of a language for the second measure.
PARTS = 8

_REST = re.compile(r"[\W\d_]+")
_compressors: dict[str, list[list]] = {}


def dictionaries(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = SAMPLE_TEXTS) -> dict[str, bytes]:
    """Each language's dictionary.  Texts are hashed where they are; each task keeps the rows with the
    smallest hashes of a language, and so many texts a language come to the driver."""
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    key = F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), text)
    rows = labelled.filter(lang.isNotNull() & text.isNotNull()).select(lang.cast("string").alias("lang"), key.alias("key"), text.alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    keys = rows.select("lang", "key").withColumn("nth", nth).filter(F.col("nth") <= texts)  # without texts, and the first of them in each task
    last = {r["lang"]: r["key"] for r in keys.groupBy("lang").agg(F.max("key").alias("key")).collect()}
    if not last:
        return {}
    few = rows.filter(F.col("key") <= F.element_at(F.create_map(*(F.lit(x) for kv in last.items() for x in kv)), F.col("lang")))
    sample = few.dropDuplicates(["lang", "key"]).collect()  # copies of one row once: so many texts a language
    made: dict[str, bytes] = {}
    for lang_ in sorted(last):
        parts = sorted(((r.key, r.text) for r in sample if r.lang == lang_), reverse=True)
        made[lang_] = " ".join(letters(t) for _, t in parts).encode("utf-8", "replace")
    return {name: d + b" " * (8 - len(d)) for name, d in made.items() if d}


def letters(text: str) -> str:
    """The text's letters in lower case, all between them one blank."""
    return _REST.sub(" ", text.lower()).strip()


def _compressed_with(made: dict[str, bytes], level: int) -> list[list]:
    """The languages' compressors with the whole dictionary and with its parts, and for a single
    language as many without a dictionary; kept for the worker's life."""
    import zstandard as zstd

    name = hashlib.sha256(repr((level, sorted(made.items()))).encode()).hexdigest()
    if name not in _compressors:
        params = zstd.ZstdCompressionParameters.from_level(level, write_content_size=False, write_dict_id=False)

        def using(data: bytes):
            d = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            return zstd.ZstdCompressor(dict_data=d, compression_params=params).compress

        out = []
        for lang in sorted(made):
            data, n = made[lang], max(8, -(-len(made[lang]) // PARTS))
            out.append([using(data), *(using(x) for i in range(0, len(data), n) if len(x := data[i : i + n]) >= 8)])
        if len(made) == 1:
            out.append([zstd.ZstdCompressor(compression_params=params).compress] * len(out[0]))
        _compressors.clear()
        _compressors[name] = out
    return _compressors[name]


def _margin(sizes: list[float], n: int) -> tuple[int, float]:
    """The smallest of the first n sizes, and its margin to the smallest of the others."""
    best = min(range(n), key=sizes.__getitem__)
    second = min(x for i, x in enumerate(sizes) if i != best)
    return best, max(0.0, (second - sizes[best]) / second)


def classify(text: str | None, langs: list[str], compress: list[list], min_margin: float = MIN_MARGIN) -> tuple[str, float]:
    """A text's language and score."""
    plain = letters(text) if text and langs else ""
    if not plain:
        return "und", 0.0
    data = plain.encode("utf-8", "replace")
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    best, score = _margin([sum([len(own[0](b)) for b in blocks]) for own in compress], len(langs))
    if score < min_margin:
        data = " ".join(dict.fromkeys(plain.split())).encode("utf-8", "replace")
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        best, score = _margin([sum(len(part(b)) for b in blocks for part in own[1:]) / len(own[1:]) for own in compress], len(langs))
    return langs[best], float(score)


def identify(docs: DataFrame, made: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", level: int = LEVEL, min_margin: float = MIN_MARGIN, keep: list[str] | None = None) -> DataFrame:
    """One row for each input row: ``doc_id``, ``lang_pred``, ``score``, ``rejected``; or the columns
    named by ``keep``, and these with names of their own."""
    ship(docs.sparkSession)
    langs = sorted(made)
    columns = [F.col(id_col).alias("doc_id")] if keep is None else [F.col(f"`{c}`") for c in keep]
    src = docs.select(*columns, F.col(f"`{text_col}`").alias("__tl_text"))
    names = ["lang_pred", "score", "rejected"] if keep is None else ["__tl_pred", "__tl_score", "__tl_rejected"]
    schema = T.StructType([*src.schema.fields[:-1], *(T.StructField(n, k) for n, k in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = _compressed_with(made, level)
        for b in batches:
            found = [classify(t.as_py(), langs, compress, min_margin) for t in b.column(b.num_columns - 1)]
            new = [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([x == "und" or s < min_margin for x, s in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*b.schema.names[:-1], *names])

    return src.mapInArrow(trimmed(run), schema)


def fold(id_col: str = "doc_id", folds: int = 3) -> Column:
    """The fold of a row by its id's CRC-32; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def held_out_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held: int = 1) -> DataFrame:
    """``identify`` for all rows, learned from the rows that aren't in fold ``held`` of three."""
    made = dictionaries(docs.filter(fold(id_col) != held), id_col, text_col, lang_col)
    found = identify(docs, made, id_col, text_col)
    return found.select("doc_id", (fold("doc_id") == held).alias("held_out"), "lang_pred", "score", "rejected")


def in_known_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The documents whose language isn't rejected, with all their columns."""
    made = dictionaries(docs, id_col, text_col, lang_col)
    return identify(docs, made, id_col, text_col, min_margin=min_margin, keep=docs.columns).filter("not __tl_rejected").select(*(f"`{c}`" for c in docs.columns))
