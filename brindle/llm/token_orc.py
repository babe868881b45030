"""Token ids in ORC files.

Rows are sorted by document id over the whole data set, one file (a shard) for
each range of ids. ORC's integer run-length encoding packs the ids of a stripe;
row indexes (minimum and maximum for every ``row_index_stride`` rows) and Bloom
filters on the document id let a reader skip stripes and row groups by metadata
alone, and stripes are read in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import BATCH_BYTES, BYTES_CONF, conf_for, partitions
from .token_bytes import END_ID, encoder

EMIT_BYTES = 4_000_000


def write_tokens(
    df: DataFrame,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    stripe_bytes: int = 64 << 20,
    row_index_stride: int = 1000,
    bloom_fpp: float = 0.01,
    codec: str = "zstd",
    shards: int | None = None,
    specials_as_text: bool = False,
) -> None:
    """Writes all documents of ``df`` to ORC files in ascending id order.

    A row: ``doc_id``, ``shard`` (number of its range of ids), ``shard_start``
    (ids in the shard before it), ``n_tokens``, ``ids`` (with end id 0). A null
    or empty text is its end id alone; null ids come first; rows with one id
    stay side by side, in any order, and are split over shards if they are many.
    There are ``shards`` shards (by default as many as shuffle partitions). An
    empty table gives files without rows. Other columns are not read. Strings
    of special tokens become those tokens unless ``specials_as_text``.
    """
    source = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    schema = T.StructType(
        [T.StructField("doc_id", source.schema[0].dataType), T.StructField("shard", T.IntegerType())]
        + [T.StructField("shard_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, shard, at = encoder(tokenizer_path, specials_as_text=specials_as_text).encode_all, TaskContext.get().partitionId(), 0
        for batch in batches:
            first, coded, size = 0, [], 0
            for row, ids in enumerate(encode_all(batch.column(1)), 1):
                coded.append(ids + END_ID)
                size += len(coded[-1])
                if size < EMIT_BYTES and row < batch.num_rows:
                    continue
                ends = np.cumsum([len(x) // 4 for x in coded])
                offsets = np.concatenate([[0], ends])
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(coded))])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                keys = batch.column(0).slice(first, row - first)
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(np.full(len(coded), shard), pa.int32()), pa.array(at + offsets[:-1], pa.int64()), pa.array(np.diff(offsets), pa.int64()), lists],
                    names=schema.names,
                )
                at += int(ends[-1])
                first, coded, size = row, [], 0

    # The row's number splits the rows of one id; it is the same whenever a task is run again.
    ranges = source.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(shards or partitions(df), "doc_id", "row")
    with conf_for(df.sparkSession, {BYTES_CONF: BATCH_BYTES}):
        (
            ranges.sortWithinPartitions("doc_id", "row")
            .drop("row")
            .mapInArrow(encode, schema)
            .write.option("orc.compress", codec)
            .option("orc.stripe.size", stripe_bytes)
            .option("orc.row.index.stride", row_index_stride)
            .option("orc.create.index", "true")
            .option("orc.bloom.filter.columns", "doc_id")
            .option("orc.bloom.filter.fpp", bloom_fpp)
            .orc(path)
        )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of the files; with ``doc_ids``, stripes and row groups without them are skipped by their metadata."""
    rows = spark.read.orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def document_starts(rows: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before a row's.

    Only the column ``n_tokens`` is read for it, and one row a shard, its total,
    is summed up; there are as many shards as the writer had partitions, so that
    table is small enough to broadcast.
    """
    from pyspark.sql import Window

    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select(
        "shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("shard_offset")
    )
    return rows.join(F.broadcast(before), "shard").withColumn("start", F.col("shard_offset") + F.col("shard_start")).drop("shard_offset")


def with_checksum(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``ids_crc32``, the CRC-32 of a row's ids as little-endian unsigned 32-bit integers."""
    source = rows.select(*keep, "ids")
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("ids_crc32", T.LongType())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            data = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B") if len(lists) else b""
            ends = (lists.offsets.to_numpy().astype(np.int64) * 4).tolist()
            sums = [zlib.crc32(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], names=schema.names)

    return source.mapInArrow(check, schema)
