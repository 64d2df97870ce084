"""Personal data by patterns, checksums and context (operator 5), with DataFrame functions only.

For each kind a regular expression proposes spans, leftmost and without overlap; a validator (digit
counts, part sizes, Luhn, mod 97) confirms or drops them; words near a span raise its score.  Base
kinds (``email``, ``ip``, ``card``, ``phone``) are kept whenever their validator agrees; the further
kinds (``iban``, ``ssn``, ``local_phone``) also need a score of ``min_score``.

Positions come from the text's split at the pattern: a span begins after the gaps and spans before
it, so a text is read in time linear in its length.  The patterns are written so that Java's engine
neither recurses nor tries a long run again from each of its places: quantifiers are possessive and
a span begins where its run begins (or where the last span ended).

Null texts count as empty and have no spans.  Repeated rows each get a row.  Other columns are
ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters beside a span in which context words count.
WINDOW = 40
#: Spans folded in one inner array; keeps the fold linear for texts with very many.
FOLD = 256
SPAN = "array<struct<start:bigint,end:bigint,kind:string,rank:int,score:double,text:string>>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _digit(s: Column, at: Column) -> Column:
    return F.ascii(s.substr(at, F.lit(1))) - 48


def luhn(digits: Column) -> Column:
    """Whether a text of digits has a right Luhn checksum."""

    def add(total: Column, i: Column) -> Column:
        d = _digit(digits, F.length(digits) - i)
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without blanks leaves 1 by mod 97, its first four signs moved last."""
    moved = F.concat(iban.substr(F.lit(5), F.length(iban)), iban.substr(1, 4))

    def step(left: Column, sign: Column) -> Column:
        code = F.ascii(sign)
        return F.when(code < 65, (left * 10 + code - 48) % 97).otherwise((left * 100 + code - 55) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _small_parts(ip: Column) -> Column:
    short = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(ip, r"\."), lambda p: (F.length(short(p)) <= 3) & F.coalesce(F.concat(F.lit("0"), F.substring(short(p), 1, 3)).cast("int") <= 255, F.lit(False)))


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # Java's
    sign: str  # a pattern of one character that every span holds
    valid: Callable[[Column], Column]
    score: float  # of a span that is valid
    words: str  # context that adds 0.4
    base: bool


#: In the order in which kinds that start together are listed.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda s: F.lit(True), 0.9, "mail|contact|write", True),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]", _small_parts, 0.6, "ip|address|host|server|login", True),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", "[0-9]", lambda s: _let(_digits(s), lambda d: _between(F.length(d), 14, 19) & luhn(d)), 0.7, "card|credit|visa|master|amex|pay", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+", lambda s: _between(F.length(_digits(s)), 10, 15), 0.7, "phone|call|tel|fax|mobile|contact", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[0-9]", lambda s: mod97(F.replace(s, F.lit(" "), F.lit(""))), 0.8, "iban|account|bank|konto|compte", False),
    Kind("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "[0-9]", lambda s: ~s.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, "ssn|social|security", False),
    Kind("local_phone", r"(?<![0-9A-Za-z+-])(?<!\+[0-9]{1,3}[ .-]{0,2})(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])", "[0-9]", lambda s: F.lit(True), 0.3, "phone|call|tel|fax|mobile|contact", False),
)


def _spans(text: Column, kind: Kind, rank: int, min_score: float) -> Column:
    """The kind's spans of a text, in order."""
    empty = F.array().cast(SPAN)

    def one(state: Column, p: Column) -> Column:
        start = state["pos"] + F.char_length(p["gap"])
        end = start + F.char_length(p["span"])
        near = F.lower(F.concat(F.right(p["gap"], F.lit(WINDOW)), F.lit(" "), F.left(p["next"], F.lit(WINDOW))))
        score = F.lit(kind.score) + F.when(near.rlike(kind.words), 0.4).otherwise(0.0)
        keep = kind.valid(p["span"]) if kind.base else kind.valid(p["span"]) & (score >= min_score)
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind.name).alias("kind"), F.lit(rank).alias("rank"), F.least(score, F.lit(1.0)).alias("score"), p["span"].alias("text"))
        return F.struct(end.alias("pos"), F.when(keep, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    def block(state: Column, part: Column) -> Column:
        start = F.struct(state["pos"].alias("pos"), empty.alias("out"))
        return F.aggregate(part, start, one, lambda s: F.struct(s["pos"].alias("pos"), F.concat(state["out"], F.array(s["out"])).alias("out")))

    def folded(parts: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / FOLD).cast("int")), lambda b: F.slice(parts, b * FOLD + 1, F.lit(FOLD)))
        start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.when(F.size(parts) > 0, F.flatten(F.aggregate(blocks, start, block)["out"])).otherwise(empty)

    def paired(both: Column) -> Column:
        return F.transform(both["spans"], lambda s, i: F.struct(F.get(both["gaps"], i).alias("gap"), s.alias("span"), F.get(both["gaps"], i + 1).alias("next")))

    both = F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("spans"), F.split(text, kind.pattern, -1).alias("gaps"))
    return F.when(text.rlike(kind.sign), _let(_let(both, paired), folded)).otherwise(empty)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.6, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row for each input row: ``doc_id`` and ``spans``, an array of (start, end, kind, rank,
    score, text) by start, then by kind; positions in code points, end exclusive."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = F.concat(*(_spans(F.col("text"), k, i, min_score) for i, k in enumerate(kinds)))
    order = lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(a["rank"] - b["rank"])
    return src.select("doc_id", _let(found, lambda x: F.when(F.size(x) > 1, F.array_sort(x, order)).otherwise(x)).alias("spans"))


def summary(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and the spans as text, from ``find_pii``."""
    base = [k.name for k in KINDS if k.base]
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in base]
    return found.select(
        "doc_id", *counts, F.sha2(joined(F.filter("spans", lambda s: s["rank"] < len(base))).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
