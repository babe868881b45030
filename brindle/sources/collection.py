"""Collections of nodes as Parquet tables: create, append, inspect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import tokens, truncated


def append_nodes(spark: SparkSession, path: str, nodes: DataFrame) -> None:
    """Appends nodes whose ``node_id`` is not there yet; nothing is ever overwritten unless ``write_nodes`` is asked to."""
    try:
        known = spark.read.parquet(path).select("node_id")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        known = None
    fresh = nodes if known is None else nodes.join(known, "node_id", "left_anti")
    fresh.dropDuplicates(["node_id"]).write.mode("append").parquet(path)


def write_nodes(path: str, nodes: DataFrame, overwrite: bool = False) -> None:
    nodes.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def inspect(nodes: DataFrame, limit: int = 3, order: str = "doc_id") -> DataFrame:
    """The first rows with the beginning of their texts."""
    return nodes.orderBy(order).limit(limit).withColumn("sample", truncated("text", 120)).drop("text")


def sample_texts(nodes: DataFrame, limit: int = 500, order: str = "doc_id") -> DataFrame:
    """Up to ``limit`` texts; empty ones go after the limit."""
    return nodes.orderBy(order).limit(limit).where(F.col("text") != "").select(order, "text")


#: Ten short texts to try a collection with.
SAMPLE_TEXTS = tuple(
    f"{subject} {rest}"
    for subject, rest in (
        ("Parquet", "stores tables by columns."), ("A shuffle", "moves rows between tasks."), ("Postings", "list where a term occurs."),
        ("An embedding", "is a vector for a text."), ("Watermarks", "bound how late an event may be."), ("A broadcast", "copies a small table to every executor."),
        ("Chunks", "are parts of a document."), ("Cosine", "compares the directions of vectors."), ("A checkpoint", "cuts the lineage of a table."), ("Fusion", "joins ranked lists."),
    )
)


def sample_corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SAMPLE_TEXTS)), "node_id long, text string")


def create_collection(path: str, nodes: DataFrame, embedding, overwrite: bool = False) -> None:
    """Embeds nodes and writes them; without rows the collection is there and empty."""
    from brindle.operators.retrievers import embedded

    write_nodes(path, embedded(nodes, embedding), overwrite)


def sparse_terms(text: Column) -> Column:
    """How often each token of a text occurs: a sparse vector as a map."""
    found = tokens(text)
    return F.map_from_entries(F.transform(F.array_distinct(found), lambda t: F.struct(t, F.size(F.filter(found, lambda x: x == t)).cast("float"))))


def create_hybrid_collection(path: str, nodes: DataFrame, embedding, sparse=sparse_terms, overwrite: bool = False) -> None:
    """The same with a sparse vector in ``sparse`` beside the dense one; ``sparse`` makes it from the text."""
    create_collection(path, nodes.withColumn("sparse", sparse(F.col("text"))), embedding, overwrite)


def attach(spark: SparkSession, path: str) -> DataFrame:
    """A collection that is there already; nothing is written, and nothing is read yet."""
    return spark.read.parquet(path)


def describe(nodes: DataFrame) -> dict:
    """Schema and number of rows."""
    return {"columns": {f.name: f.dataType.simpleString() for f in nodes.schema}, "rows": nodes.count()}


def write_markdown(pages: DataFrame, path: str) -> None:
    """One text file for each document (``path``, ``md``) below ``path``, in a folder of its name."""
    name = F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), "[^A-Za-z0-9._-]", "_")
    pages.select(name.alias("name"), F.col("md").alias("value")).repartition("name").write.partitionBy("name").text(path)
