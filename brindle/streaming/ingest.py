"""Files of a directory to nodes of a collection, each file once, across restarts."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import html_text, node_id
from brindle.operators.chunks import auto_split
from brindle.sources.files import EXTENSIONS, auto_load, extension, parse_files


def document_nodes(docs: DataFrame) -> DataFrame:
    """Nodes of documents (``path``, ``part``, ``doc_type``, ``text``), each split as its type wants it."""
    named = docs.where("text is not null").select(F.concat_ws("#", "path", "part").alias("doc_id"), "text", "doc_type")
    nodes = auto_split(named, None, ("text", "markdown", "html", "json")).where(F.trim("text") != "")
    return nodes.select(F.concat_ws("_", F.substring(F.md5("doc_id"), 1, 8), node_id("chunk", F.col("pos"), "text")).alias("node_id"), "doc_id", "pos", "text")


def file_status(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``path``, ``n_nodes`` and ``error`` of each file."""
    counts = nodes.groupBy(F.regexp_replace("doc_id", "#[0-9]+$", "").alias("path")).agg(F.count(F.lit(1)).alias("n_nodes"))
    errors = docs.groupBy("path").agg(F.first("error", True).alias("error"))
    return errors.join(counts, "path", "left").select("path", F.coalesce("n_nodes", F.lit(0)).cast("long").alias("n_nodes"), "error")


def ingest_file(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of the files at ``path``, by type."""
    return document_nodes(auto_load(spark, path))


def ingest_pages(pages: DataFrame) -> DataFrame:
    """The nodes of fetched web pages (``url``, ``html``)."""
    docs = pages.select(F.col("url").alias("path"), F.lit(0).alias("part"), F.lit("text").alias("doc_type"), html_text("html").alias("text"))
    return document_nodes(docs)


def fetch(urls: DataFrame, read: Callable[[str], str] | None = None) -> DataFrame:
    """Pages of a table of URLs (``url``), fetched by the executors: ``url``, ``html``, ``error``. ``read`` replaces the plain HTTP request."""

    def get(url: str) -> str:
        with urllib.request.urlopen(url, timeout=30) as reply:  # noqa: S310  the caller's own URLs
            return reply.read().decode(reply.headers.get_content_charset() or "utf-8", "replace")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    rows.append((url, (read or get)(url), None))
                except Exception as e:  # noqa: BLE001  reported beside the URL
                    rows.append((url, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "html", "error"])

    return urls.select("url").mapInPandas(run, "url string, html string, error string")


def ingest_directory(spark: SparkSession, directory: str, table: str, checkpoint: str, *, files_per_batch: int = 1000):
    """Reads what is new in ``directory`` and adds its nodes to ``table``; returns the finished query.

    Files are parsed and split by type. A file that fails leaves its error in
    ``<table>-status``, beside the paths and node counts of the others, and stops
    nothing. The checkpoint remembers the files, and a batch writes a folder of
    its own in both tables, so that one that is run again replaces itself and
    nothing that is known needs to be read.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(directory)
    known = files.where(extension("path").isin(*EXTENSIONS)).select("path", "content")

    def add(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        parsed, nodes, status = (f"{table}{end}/batch={number}" for end in ("-parsed", "", "-status"))
        parse_files(batch).write.mode("overwrite").parquet(parsed)
        docs = own.read.parquet(parsed)
        document_nodes(docs).write.mode("overwrite").parquet(nodes)
        file_status(docs, own.read.parquet(nodes)).write.mode("overwrite").parquet(status)

    query = known.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def status_counts(rows: DataFrame) -> DataFrame:
    """Documents and nodes by outcome: ``ok``, ``skipped`` (no text or no node), ``failed``."""
    status = F.when(F.col("error").isNotNull(), "failed").when(F.coalesce("n_nodes", F.lit(0)) == 0, "skipped").otherwise("ok")
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.coalesce("n_nodes", F.lit(0))).cast("long").alias("nodes"))
