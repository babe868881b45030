"""Connected components of a graph given by its edges, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Every node looks at its neighbours (all of them, or those not above it) and ties them to the least."""
    if large:
        seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        seen = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = seen.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``label``, the least node of its component, for every node of an edge other than such least nodes.

    ``edges`` has the columns ``a`` and ``b``, of one orderable type; direction,
    repetition and self-loops do not matter. Alternating large and small stars
    halve distances each round, so rounds grow with the logarithm of the longest
    path. Edges are never gathered by node: the least neighbours are
    pre-aggregated, and a node of very many edges is a skewed key of a join, which
    adaptive execution splits. Each round is a table of ``scratch``.
    """
    now = scratch.table(edges.select("a", "b").where("a <> b").distinct())
    before = None
    for _ in range(max_rounds):
        now = scratch.table(_star(_star(now, True), False))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = state
    raise RuntimeError("components did not settle")
