"""Connected components of a graph given as a table of links, by repeated contraction.

Each round every node takes the smallest of itself and its neighbours as parent, parents are
followed once more, and the links are rewritten to parents; links inside one parent vanish.  The
tables only shrink, nothing is gathered on the driver, and each round ends in a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm._shared import written


def components(links: DataFrame) -> DataFrame:
    """links: ``a``, ``b`` (long).  Returns ``node``, ``root`` for each node that has a link to
    another; root is the smallest node of the component.  No links give no rows."""
    links = written(_undirected(links), "links")
    members = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("parent")), "parents")
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        parent = written(parent.join(up, "parent").select("node", "root"), "parents")
        if members is None:
            members = parent
        else:
            step = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
            members = written(members.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "members")
        to = lambda end: parent.select(F.col("node").alias(end), F.col("root").alias(f"{end}2"))
        links = written(_undirected(links.join(to("a"), "a").join(to("b"), "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))), "links")
    return members if members is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _undirected(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
