"""Mixing of sources to target weights by hierarchical budgeting (operator 2).

The tree is root, domain, language, source.  Each node's budget of tokens is shared among its
children by weight, no child getting more than its subtree can give (its tokens times
``max_epochs``).  What one child can't use goes to its siblings by their weights; only what a whole
subtree can't use goes to the subtree's siblings.  A leaf takes its documents by seeded epochs: each
epoch orders them anew by a hash, and the leaf takes whole epochs and then the longest prefix of the
next one that stays within the budget.

The prefix is found without gathering a leaf: token sums by hash bucket give the bucket in which the
budget ends, and only that bucket's documents are put in order.  Buckets grow in number with the
rows.  Leaves are rows of a small table; documents move without their texts.  Every row has a key of
its own, so rows of one id are taken or left each for itself, in its own leaf.

Null domains, languages and sources are leaves of their own (written as ``\\N``).  A null number of
tokens counts as 0.  Documents of zero tokens are taken as the prefix reaches them.  The order is by
a hash of id and tokens, then by id; rows without an id are ordered by their place in the table.  A
weight of 0 or less gives nothing.  Texts may be of any length.  Other columns are ignored, whatever
their names.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm._shared import written

#: Buckets of a leaf's hash order, at least, and rows of the table for each.
BUCKETS, BUCKET_ROWS = 1024, 1 << 20
LEVELS = ("domain", "lang", "source")


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    """The weight of a node among its siblings: as given by name, else the level's ``*``, else 1."""
    named = weights.get(level, {})
    out = F.lit(float(named.get("*", 1.0)))
    for name, w in named.items():
        if name != "*":
            out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return F.greatest(out, F.lit(0.0))


def share(children: DataFrame, parent: list[str]) -> DataFrame:
    """children: the parents' names, ``budget`` (the parent's), ``weight``, ``cap``.  Adds ``given``:
    the least of cap and level times weight, where the level makes the sum the budget."""
    fill = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight"))  # the level at which a child is full
    order = Window.partitionBy(*parent).orderBy(F.col("fill").asc_nulls_last(), "node")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    x = children.withColumn("fill", fill)
    taken = F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("cap"))).over(before), F.lit(0.0))
    x = x.withColumn("level", F.try_divide(F.col("budget") - taken, F.sum("weight").over(rest)))
    reached = F.max(F.when((F.col("weight") > 0) & (F.col("level") <= F.col("fill")), F.col("level"))).over(Window.partitionBy(*parent))
    given = F.when(F.col("weight") <= 0, 0.0).otherwise(F.least(F.col("cap"), F.coalesce(F.col("reached") * F.col("weight"), F.col("cap"))))
    return x.withColumn("reached", reached).withColumn("given", F.greatest(given, F.lit(0.0))).drop("fill", "level", "reached")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], budget: float, max_epochs: int) -> DataFrame:
    """leaves: ``domain``, ``lang``, ``source``, ``tokens``.  Adds each leaf's ``budget``."""
    some = F.lit(True)
    for level in LEVELS:
        some = some & (_weight(level, weights) > 0)
    x = leaves.withColumn("cap", F.when(some, F.col("tokens") * max_epochs).otherwise(0).cast("double"))
    parents = x.agg(F.lit(float(budget)).alias("budget")).withColumn("root", F.lit(0))
    for i, level in enumerate(LEVELS):
        up = ["root", *LEVELS[:i]]
        nodes = x.withColumn("root", F.lit(0)).groupBy(*up, level).agg(F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("weight", _weight(level, weights)).withColumn("node", F.col(level)).join(parents, up)
        parents = share(nodes, up).select(*up, level, F.col("given").alias("budget"))
    return leaves.join(parents.drop("root"), list(LEVELS))


def mix(docs: DataFrame, weights: dict[str, dict[str, float]], fraction: float, domain: Column, tokens: Column, max_epochs: int = 2, seed: int = 11, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", buckets: int | None = None, key: Column | None = None) -> DataFrame:
    """One row for each input row: ``doc_id``, ``domain``, ``lang``, ``source``, ``n_tokens``,
    ``copies``, in how many epochs it is taken (0: not at all), and ``row_key``.

    fraction: the budget in shares of the input's tokens; domain and tokens: columns of the input;
    key: a column that no two rows share, by default one is made."""
    named = lambda c: F.coalesce(c.cast("string"), F.lit("\\N"))
    key = F.monotonically_increasing_id() if key is None else key
    rows = docs.select(key.alias("row_key"), F.col(f"`{id_col}`").alias("doc_id"), named(domain).alias("domain"), named(F.col(f"`{lang_col}`")).alias("lang"), named(F.col(f"`{source_col}`")).alias("source"), F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens"))
    rows = written(rows, "mix-rows")
    leaves = written(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "leaves")
    all_of = leaves.agg(F.sum("tokens"), F.sum("rows")).first()
    total, buckets = all_of[0] or 0, buckets or max(BUCKETS, (all_of[1] or 0) // BUCKET_ROWS)
    plan = budgets(leaves.drop("rows"), weights, total * fraction, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.when(F.col("budget") > 0, max_epochs).otherwise(0)).cast("long")
    plan = written(plan.withColumn("whole", whole).withColumn("rest", F.floor(F.col("budget") - F.col("whole") * F.col("tokens")).cast("long")), "leaf-budgets")

    # the epoch that is cut: its order depends on how many whole ones came before it
    salted = plan.select(*LEVELS, "whole", "rest", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("salt"))
    keyed = rows.withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(64)).cast("int")).join(salted, [*LEVELS, "salt"]).drop("salt")
    order_of = F.xxhash64(F.lit(seed), "whole", "doc_id", "n_tokens", F.when(F.col("doc_id").isNull(), F.col("row_key")))
    keyed = keyed.withColumn("h", order_of).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(buckets)))
    keyed = written(keyed, "mix-keyed")
    sums = keyed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("sum"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("end", F.sum("sum").over(run))
    inside = sums.select(*LEVELS, "bucket", (F.col("end") <= F.col("rest")).alias("inside"), (F.col("rest") - F.col("end") + F.col("sum")).alias("left"))
    edge = inside.filter("not inside and left >= 0").select(*LEVELS, "bucket", "left")
    edge = edge.withColumn("least", F.min("bucket").over(Window.partitionBy(*LEVELS))).filter("bucket = least").drop("least")
    met = keyed.join(written(inside, "mix-buckets").select(*LEVELS, "bucket", "inside"), [*LEVELS, "bucket"])
    order = Window.partitionBy(*LEVELS).orderBy("h", "doc_id", "row_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = keyed.join(written(edge, "mix-edges"), [*LEVELS, "bucket"]).withColumn("upto", F.sum("n_tokens").over(order))
    cut = written(cut.filter(F.col("upto") <= F.col("left")).select("row_key", F.lit(True).alias("in_cut")), "mix-cut")
    met = met.join(cut, "row_key", "left")
    return met.select("doc_id", *LEVELS, "n_tokens", (F.col("whole") + F.when(F.col("inside") | F.coalesce("in_cut", F.lit(False)), 1).otherwise(0)).cast("long").alias("copies"), "row_key")


def mixed_documents(
    docs: DataFrame, weights: dict[str, dict[str, float]], fraction: float, domain: Column, tokens: Column | Callable[[DataFrame, dict[str, Column]], DataFrame], max_epochs: int = 1, seed: int = 11,
    id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """The documents that are taken, with all their columns, once for each epoch.

    tokens: a column of the input, or a function that takes the documents and columns to carry and
    returns these and ``n_tokens`` for each row."""
    keyed = written(docs.withColumn("__tl_key", F.monotonically_increasing_id()), "mix-documents")
    if callable(tokens):
        counted = tokens(keyed, {"key": F.col("__tl_key"), "doc_id": F.col(f"`{id_col}`"), "domain": domain, "lang": F.col(f"`{lang_col}`"), "source": F.col(f"`{source_col}`")})
        taken = mix(counted, weights, fraction, F.col("domain"), F.col("n_tokens"), max_epochs, seed, key=F.col("key"))
    else:
        taken = mix(keyed, weights, fraction, domain, tokens, max_epochs, seed, id_col, lang_col, source_col, key=F.col("__tl_key"))
    taken = taken.filter("copies > 0").select(F.col("row_key").alias("__tl_key"), F.col("copies").cast("int").alias("__tl_copies"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if max_epochs == 1:
        return keyed.join(taken, "__tl_key", "left_semi").select(*columns)
    return keyed.join(taken, "__tl_key").withColumn("__tl_epoch", F.explode(F.sequence(F.lit(1), F.col("__tl_copies")))).select(*columns)
