"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """A new path under the cluster's shared folder.

    The folder is ``spark.checkpoint.dir`` of the session. Only a local session
    without it gets a temporary folder; on a cluster every executor would have
    a folder of its own there, so that is an error.
    """
    return f"{_shared_base(spark).rstrip('/')}/brindle-{uuid.uuid4().hex}"


def _shared_base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return tempfile.gettempdir() + "/brindle-shared"
    raise RuntimeError(f"spark.checkpoint.dir must name a folder that all of {master} shares")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(_shared_base(spark))
    return df.checkpoint(eager=True)


class Scratch:
    """Intermediate tables of one operator in the shared folder, removed together once nothing reads them.

    Checkpoints keep the planner's estimate of their size. Where each round joins the result of the round before, the
    estimates multiply to numbers of millions of digits, and planning never ends; a table has the size of its files.
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._dir, self._tables = spark, shared_dir(spark), 0

    def table(self, df: DataFrame) -> DataFrame:
        """``df``, written as Parquet and read again: no lineage, and the planner knows its size."""
        self._tables += 1
        path = f"{self._dir}/{self._tables}"
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        remove(self._spark, self._dir)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def trim_memory() -> None:
    """Gives freed memory of a Python worker back to the system, as workers are reused by later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Bytes of rows that Spark hands to a Python worker at once, about; its default is 64 MB, which JVM and worker hold several times over.
BATCH_BYTES = 4 << 20
BYTES_CONF, ROWS_CONF = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def conf_for(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """The session's settings are ``values`` while the block runs, and then what they were."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def drop_encoders() -> None:
    """Frees the word caches that an earlier stage's tokenizers left in this Python worker."""
    held = sys.modules.get(f"{__package__}.token_bytes")
    if held is not None and held.forget():
        trim_memory()


def crc_remainder(key: Column, n: int) -> Column:
    """``crc32(key as text) mod n``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % F.lit(n)


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_fields(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    """The schema of ``df`` with ``fields`` behind it; same-named columns of ``df`` give way."""
    names = {f.name.lower() for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in names] + fields)


#: Ids up to which a list of them is broadcast (about 50 MB); a longer one is joined by a shuffle.
BROADCAST_IDS = 2_000_000


def without_ids(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id is not in the one column of ``ids``; rows with a null id stay."""
    ids = cut_lineage(ids)
    name = ids.columns[0]
    small = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, df[id_col] == ids[name], "left_anti")
