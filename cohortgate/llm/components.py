"""Connected components of a table of links by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortgate.llm.tables import TASK_ROWS, kept


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``) but the roots; the root is the least node.

    Each round hangs larger neighbours, then smaller ones, on the least node of a neighbourhood,
    and is written to the shared folder; the edges have become stars when a round changes nothing.
    Least nodes are found by partial aggregation, and joins are between written tables, so that
    adaptive execution can split a node with very many links.
    """
    edges = kept(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = _state(edges)
    rows = 2 * state[0]
    edges = edges.coalesce(1 + rows // TASK_ROWS)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least", rows)
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u")
        large = kept(large.select(F.col("w").alias("u"), F.col("m").alias("v")).distinct(), "large", rows)
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")), "least", rows)
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = kept(small, "edges", rows)
        now = _state(edges)
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mixed)).first())
