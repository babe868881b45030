"""Retrievers behind one interface, and hybrids of them: tables of queries in, tables of hits out."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dense, fusion, index

KINDS = ("vector", "bm25", "keyword", "rake", "tfidf")


class Retriever(Protocol):
    """``queries`` (``query_id``, ``query``) to hits (``query_id``, ``node_id``, ``score``, ``rank``)."""

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame: ...


@dataclass(frozen=True)
class Bm25:
    index: index.Index
    options: dict = field(default_factory=dict)

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return index.bm25(self.index, queries, k, **self.options)


@dataclass(frozen=True)
class TfIdf:
    index: index.Index

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return index.tfidf(self.index, queries, k)


@dataclass(frozen=True)
class Keywords:
    """Single words, or with ``rake`` the words of key phrases."""

    nodes: DataFrame
    rake: bool = False

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return (index.rake_hits if self.rake else index.keyword_hits)(self.nodes, queries, k)


@dataclass(frozen=True)
class Vectors:
    """Exact inner products of unit vectors; ``nodes`` has ``node_id`` and ``vector``."""

    nodes: DataFrame
    embedding: object
    normalize: bool = True
    invert: bool = False

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame:
        asked = queries.select("query_id", dense.l2_normalize(self.embedding.embed(F.col("query"))).alias("q"))
        hits = dense.dense_hits(self.nodes, asked, k)
        return fusion.normalized(hits, invert=self.invert) if self.normalize or self.invert else hits


@dataclass(frozen=True)
class Hybrid:
    """Fuses the hits of named retrievers. Each is asked for ``fetch_k`` hits, or for as many as are wanted."""

    retrievers: dict[str, Retriever]
    method: str = "rrf"
    weights: dict[str, float] | None = None
    rank_constant: int = 60
    fetch_k: int | None = None

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame:
        lists = [r.retrieve(queries, max(k, self.fetch_k or k)) for r in self.retrievers.values()]
        weights = {i: (self.weights or {}).get(name, 1.0) for i, name in enumerate(self.retrievers)}
        return fusion.hybrid(lists, k, method=self.method, weights=weights, rank_constant=self.rank_constant)

    def describe(self) -> str:
        """One line for the fusion and one for each retriever."""
        lines = [f"{self.method} of {len(self.retrievers)} retrievers, constant {self.rank_constant}, fetch {self.fetch_k or 'as wanted'}"]
        return "\n".join(lines + [f"- {name}: {type(r).__name__}, weight {(self.weights or {}).get(name, 1.0)}" for name, r in self.retrievers.items()])


def embedded(nodes: DataFrame, embedding) -> DataFrame:
    """Nodes with the unit vector of their text."""
    return nodes.withColumn("vector", dense.l2_normalize(embedding.embed(F.col("text"))))


def build_hybrid(nodes: DataFrame, kinds: tuple[str, ...] = ("vector", "bm25"), *, embedding=None, bm25_options: dict | None = None, **options) -> Hybrid:
    """A hybrid of the named kinds over ``nodes`` (``node_id``, ``text``, and ``vector`` unless it is to be made by ``embedding``)."""
    made: dict[str, Retriever] = {}
    words = index.build_index(nodes)
    for kind in kinds:
        if kind == "vector":
            if embedding is None:
                raise ValueError("a vector retriever needs an embedding")
            made[kind] = Vectors(nodes if "vector" in nodes.columns else embedded(nodes, embedding), embedding)
        elif kind == "bm25":
            made[kind] = Bm25(words, bm25_options or {})
        elif kind == "tfidf":
            made[kind] = TfIdf(words)
        elif kind in ("keyword", "rake"):
            made[kind] = Keywords(nodes, kind == "rake")
        else:
            raise ValueError(f"{kind} is none of {KINDS}")
    return Hybrid(made, **options)
