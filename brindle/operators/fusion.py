"""Fusion of ranked lists: hits with ``query_id``, ``list_idx``, ``node_id``, ``score`` and ``rank``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .index import top_k

METHODS = ("rrf", "weighted", "concat")


def _first_k(fused: DataFrame, k: int) -> DataFrame:
    """Best scores first; ties by where a node was first seen (list, then rank)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen", "node_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("seen")


def rrf(lists: DataFrame, k: int = 10, *, rank_constant: int = 60, digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (constant + rank)."""
    fused = lists.groupBy("query_id", "node_id").agg(
        F.round(F.sum(1.0 / (rank_constant + F.col("rank"))), digits).alias("score"), F.min(F.struct("list_idx", "rank")).alias("seen")
    )
    return _first_k(fused, k)


def weighted(lists: DataFrame, weights: dict[int, float], k: int = 10, *, normalize: bool = True, digits: int = 9) -> DataFrame:
    """Weighted sum of scores, each list scaled to [0, 1] first; a list of equal scores keeps them. Weights go by list, so an empty list needs no care."""
    one = Window.partitionBy("query_id", "list_idx")
    score = F.coalesce(F.col("score"), F.lit(0.0))
    low, high = F.min(score).over(one), F.max(score).over(one)
    scaled = F.when(high > low, (score - low) / (high - low)).otherwise(score) if normalize else score
    pairs = [x for i, w in weights.items() for x in (F.lit(i), F.lit(float(w)))]
    weight = F.coalesce(F.create_map(*pairs)[F.col("list_idx")], F.lit(1.0))
    fused = lists.withColumn("part", scaled * weight).groupBy("query_id", "node_id").agg(
        F.round(F.sum("part"), digits).alias("score"), F.min(F.struct("list_idx", "rank")).alias("seen")
    )
    return _first_k(fused, k)


def dedup_max(hits: DataFrame) -> DataFrame:
    """One row for each node of a query, with its highest score; on equal scores the first."""
    best = F.max_by(F.struct("list_idx", "rank"), F.struct(F.coalesce("score", F.lit(0.0)), -F.col("list_idx"), -F.col("rank")))
    return hits.groupBy("query_id", "node_id").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"), best.alias("kept"), F.min(F.struct("list_idx", "rank")).alias("seen"))


def concat(lists: DataFrame, k: int = 10) -> DataFrame:
    """All lists together, each node once with its highest raw score."""
    return _first_k(dedup_max(lists).drop("kept"), k)


def normalized(hits: DataFrame, *, invert: bool = False, digits: int = 6) -> DataFrame:
    """Scores of a query scaled to [0, 1]; all equal ones become 1; ``invert`` turns distances into scores."""
    one = Window.partitionBy("query_id")
    low, high, score = F.min("score").over(one), F.max("score").over(one), F.col("score")
    scaled = (high - score) / (high - low) if invert else (score - low) / (high - low)
    return hits.withColumn("score", F.round(F.when(high > low, scaled).otherwise(1.0), digits))


def hybrid(lists: list[DataFrame], k: int = 10, *, method: str = "rrf", weights: dict[int, float] | None = None, rank_constant: int = 60) -> DataFrame:
    """Fuses the hits of several retrievers; they run as parts of one plan."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    union = None
    for i, hits in enumerate(lists):
        part = hits.select("query_id", F.lit(i).alias("list_idx"), F.col("node_id").cast("string").alias("node_id"), "score", "rank")
        union = part if union is None else union.unionByName(part)
    if method == "rrf":
        return rrf(union, k, rank_constant=rank_constant)
    return concat(union, k) if method == "concat" else weighted(union, weights or {}, k)


def top_hits(hits: DataFrame, k: int) -> DataFrame:
    return top_k(hits, k)
