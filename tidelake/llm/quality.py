"""Quality by hierarchical empirical Bayes (operator 8).

A document's own evidence is a logistic model over hashed n-grams of its whole text (four bytes,
words, pairs of words), fitted to a bounded sample of labelled documents.  Its host and its path on
that host have posteriors of their own: the host's mean of the documents' probabilities (labels
count as documents of known quality) is shrunk toward the global mean, the path's toward its host's.
How strongly is learned: the prior's strength is what the spread of the means over hosts, and of
paths within hosts, supports beyond chance.  A row's posteriors leave the row itself out, so that
nothing counts twice; the score adds, in log odds, the document's evidence and what the rest of its
path is above the rest of the corpus.

Labels of one fold of ids are used nowhere: rows marked ``held_out`` show how good the model is.

All sums are grouped aggregations, partial in each task; documents meet their path's sums by a join,
texts aren't moved.

Null and empty texts have no n-grams and get the model's constant.  Texts are read whole, however
long, in blocks.  Null hosts and paths are a host and a path of their own; a null id has no label and
isn't held out.  Without labels of both kinds the model says one half for all.  Null labels are
ignored; of several labels of a document the mean counts.  Repeated rows each get a row.  Other
columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm._shared import ship, trimmed, written

#: Labelled documents that the model is fitted to, at most: those with the smallest hashes of their ids.
SAMPLE = 4096
#: Documents that a labelled document counts for in its host's mean.
LABEL_WEIGHT = 5.0
#: Strength of a prior, at least and at most, in documents.
STRENGTH = (1.0, 10_000.0)
#: Buckets of byte n-grams, and as many again of words and pairs of words.
BUCKETS = 2048
#: Ids whose CRC-32 has this remainder are held out: (divisor, remainder).
HELD_OUT = (5, 0)
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 20

_MIX, _PAIR, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x100000001B3)
#: A-Z in lower case, all digits alike, control characters as blanks.
_FOLD = bytes(32 if b <= 32 else b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * _MIX) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _words(x: np.ndarray) -> np.ndarray:
    """Hashes of the words in a block of bytes."""
    at = np.flatnonzero(x > 32)
    if not len(at):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    size = np.diff(np.r_[first, len(at)])
    power = np.cumprod(np.full(size.max(), _BASE, np.uint64))
    place = np.arange(len(at)) - np.repeat(first, size)
    return np.add.reduceat((x[at].astype(np.uint64) + np.uint64(1)) * power[place], first)


def _blocks(data: bytes) -> Iterator[bytes]:
    """Blocks of about ``BLOCK`` bytes that end with a blank, where there is one."""
    start = 0
    while start < len(data):
        end = start + BLOCK
        if end < len(data):
            blank = data.find(b" ", end)
            end = len(data) if blank < 0 else blank + 1
        yield data[start:end]
        start = end


def grams(data: bytes) -> np.ndarray:
    """The text's hashed n-grams as a vector of length one: logarithms of the counts."""
    counts, tail, last = np.zeros(2 * BUCKETS), b"", np.zeros(0, np.uint64)
    for block in _blocks(data.translate(_FOLD)):
        x = np.frombuffer(tail + block, np.uint8).astype(np.uint64)
        if len(x) >= 4:
            four = x[:-3] | x[1:-2] << np.uint64(8) | x[2:-1] << np.uint64(16) | x[3:] << np.uint64(24)
            counts[:BUCKETS] += np.bincount(_bucket(four), minlength=BUCKETS)
        tail = (tail + block)[-3:]
        w = _words(np.frombuffer(block, np.uint8))
        run = np.r_[last, w]
        for h in (w, run[:-1] * _PAIR + run[1:]):
            if len(h):
                counts[BUCKETS:] += np.bincount(_bucket(h), minlength=BUCKETS)
        last = run[-1:]
    v = np.log1p(counts)
    return (v / max(float(np.sqrt(v @ v)), 1e-9)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """A constant and the weights of the buckets."""

    bias: float
    weights: np.ndarray

    def log_odds(self, data: bytes) -> float:
        return self.bias + float(grams(data) @ self.weights)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 400) -> Model:
    """Logistic regression by accelerated gradients; y may be between 0 and 1."""
    k = 2 * BUCKETS
    if not len(y) or y.min() == y.max():
        return Model(0.0, np.zeros(k, np.float32))
    mean = x.mean(0)
    z, y = x - mean, y.astype(np.float32)
    v = z.sum(0) + 1e-3
    for _ in range(20):  # the largest singular value bounds the step
        v = z.T @ (z @ (v / np.linalg.norm(v)))
    step_w, step_b = 1 / (0.25 * float(np.linalg.norm(v)) * 1.1 + ridge), 4 / len(y)
    w, b = np.zeros(k, np.float32), 0.0
    u, c, t = w, b, 1.0
    for _ in range(rounds):
        off = 1 / (1 + np.exp(-np.clip(z @ u + c, -30, 30))) - y
        new_w, new_b = u - step_w / 2 * (z.T @ off + ridge * u), c - step_b / 2 * float(off.sum())
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        u, c = new_w + (t - 1) / s * (new_w - w), new_b + (t - 1) / s * (new_b - b)
        w, b, t = new_w, new_b, s
    return Model(float(b - mean @ w), w.astype(np.float32))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame, mean: Column) -> float:
    """The prior's strength by moments: the spread within groups over the spread of groups beyond it,
    for groups of ``m`` (mean), ``n`` (size) and ``v`` (squares within) around ``mean``."""
    r = groups.filter("n > 1").agg(F.sum(F.col("n") * (F.col("m") - mean) ** 2).alias("between"), F.sum("v").alias("within"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
    if not r["k"] or not r["n"]:
        return STRENGTH[1]
    noise = r["within"] / max(1.0, r["n"] - r["k"])  # of one document around its group's mean
    extra = max(0.0, (r["between"] - r["k"] * noise) / r["n"])
    return float(min(STRENGTH[1], max(STRENGTH[0], noise / extra if extra > 0 else STRENGTH[1])))


def is_held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % HELD_OUT[0] == HELD_OUT[1], F.lit(False))


def _sample(docs: DataFrame, known: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of at most ``sample`` rows.  Ids alone are looked at first, so that only few
    texts are hashed; of rows that share an id no more come than fit."""
    h = F.xxhash64("doc_id")
    some = docs.select("doc_id").join(known, "doc_id").select(h.alias("h")).orderBy("h").limit(sample)
    last = some.agg(F.max("h")).first()[0]
    if last is None:
        return np.zeros((0, 2 * BUCKETS), np.float32), np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [grams(t.as_py() or b"").astype(np.float16).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("y"), pa.array(vectors, pa.binary())], names=["h", "y", "v"])

    rows = docs.filter(h <= last).join(known, "doc_id").select(h.alias("h"), "y", F.col("text").cast("binary").alias("text"))
    got = rows.mapInArrow(trimmed(run), "h long, y double, v binary").orderBy("h", "y", "v").limit(sample).toArrow()
    return np.stack([np.frombuffer(v.as_py(), np.float16) for v in got["v"]]).astype(np.float32), got["y"].to_numpy()


def _moments(groups: DataFrame) -> DataFrame:
    m = F.col("s") / F.col("n")
    return groups.withColumn("m", m).withColumn("v", F.greatest(F.col("q") - F.col("n") * m**2, F.lit(0.0)))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """One row for each input row: ``doc_id``, ``host``, ``path``, ``held_out``, ``p_text`` (by the text
    alone), ``p_host`` and ``p_path`` (posteriors without the row), ``quality`` (all combined), ``kept``."""
    ship(docs.sparkSession)
    named = lambda c: F.coalesce(c.cast("string"), F.lit("\\N"))
    rows = docs.select(F.col(id_col).alias("doc_id"), named(host).alias("host"), named(path).alias("path"), F.col(text_col).alias("text"))
    known = labels.filter(F.col(label_col).isNotNull() & ~is_held_out(F.col(label_id_col))).groupBy(F.col(label_id_col).alias("doc_id")).agg(F.avg(label_col).alias("y"))
    model = fit(*_sample(rows.select("doc_id", "text"), known, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [model.log_odds(t.as_py() or b"") for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(said, pa.float64())], names=["doc_id", "host", "path", "evidence"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    said = rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(trimmed(run), f"doc_id {kind}, host string, path string, evidence double")
    p_text = 1 / (1 + F.exp(-F.col("evidence")))
    weight, value = F.when(F.col("y").isNull(), 1.0).otherwise(LABEL_WEIGHT), F.coalesce("y", "p_text")
    scored = written(said, "evidence").join(known, "doc_id", "left").withColumn("p_text", p_text).withColumn("w", weight).withColumn("wv", weight * value).drop("y")

    paths = scored.groupBy("host", "path").agg(F.sum("w").alias("n"), F.sum("wv").alias("s"), F.sum(F.col("wv") ** 2 / F.col("w")).alias("q"))
    paths = written(_moments(paths), "paths")
    hosts = written(_moments(paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in "nsq"))), "hosts")
    n, s = hosts.agg(F.sum("n"), F.sum("s")).first()
    n, s = n or 0.0, s or 0.0
    a = _strength(hosts, F.lit(s / n if n else 0.5))
    paths = paths.join(hosts.select("host", F.col("n").alias("hn"), F.col("s").alias("hs")), "host")
    b = _strength(paths, (F.col("hs") + a * (s / n if n else 0.5)) / (F.col("hn") + a))

    # what is left of each sum without the row itself
    rest = lambda total, own: F.greatest(total - F.col(own), F.lit(0.0))
    mean = F.when(F.lit(n) - F.col("w") < 0.5, 0.5).otherwise(rest(F.lit(s), "wv") / (F.lit(n) - F.col("w")))
    out = scored.join(paths.select("host", "path", "n", "s", "hn", "hs"), ["host", "path"]).withColumn("mean", F.least(mean, F.lit(1.0)))
    out = out.withColumn("p_host", (rest(F.col("hs"), "wv") + a * F.col("mean")) / (rest(F.col("hn"), "w") + a))
    out = out.withColumn("p_path", (rest(F.col("s"), "wv") + b * F.col("p_host")) / (rest(F.col("n"), "w") + b))
    quality = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("p_path")) - _logit(F.col("mean")))))
    return out.select("doc_id", "host", "path", is_held_out(F.col("doc_id")).alias("held_out"), "p_text", "p_host", "p_path", quality.alias("quality"), (quality >= threshold).alias("kept"))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """The first part of a URL's path."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)", 1)
