"""Proportional stratified interleaving of rows into shards.

Within each source, rows are shuffled by a seeded key and ranked; a row's
fractional rank is (rank + 1/2) / (rows of the source). Sorted by that rank all
sources advance at the same pace, so every contiguous cut of the order has the
mixture of the whole, and shards are such cuts: their row counts differ by one
at most.

Both rankings are made without one task per source or a global sort: the
shuffled key and the fractional rank are uniform by construction, so rows are
dealt to equal ranges of them, ranges are counted, a running sum over the
counts gives each range's first position, and rows are numbered within ranges.
There are at most ``MAX_RANGES`` ranges, however large the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut_lineage, partitions

RANGE_ROWS = 1024
MAX_RANGES = 1 << 16
#: Sources up to which their counts are broadcast (about 50 MB); beyond it the join shuffles.
MAX_SOURCES = 500_000


#: Repeated rows' hashes up to which they are broadcast (about 16 MB).
MAX_REPEATED = 500_000


def shuffle_key(seed: int, *columns: str) -> F.Column:
    """A seeded, uniform text key for a row, from its columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def interleave_shards(
    df: DataFrame,
    shards: int,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 17,
) -> DataFrame:
    """Puts every row of ``df`` into one of ``shards`` shards.

    Columns: the id column, ``size`` (UTF-8 bytes of the text, none if null,
    plus 8), ``text_crc32`` (of the text, the empty one if null), ``shard``,
    ``slot`` (position in the shard, gapless from 0) and ``fraction``.

    A null source is a source of its own. A row's key comes from its id and
    text; rows equal in both are interchangeable and get keys of their own from
    their places, so that no key has many rows. Fewer rows than shards leave
    shards empty; an empty table gives no rows. Other columns are not read.
    """
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    base = cut_lineage(
        df.select(
            F.col(id_col).alias("id"),
            source.alias("stratum"),
            F.xxhash64(text_col).alias("text"),
            F.monotonically_increasing_id().alias("row"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("crc"),
        )
    )
    total = base.count()
    same = F.xxhash64(F.lit(seed), "id", "text")
    repeated = cut_lineage(base.groupBy(same.alias("same")).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("same"))
    rows = base.withColumn("key", shuffle_key(seed, "id", "text"))
    if not repeated.isEmpty():
        known = F.broadcast(repeated) if repeated.count() <= MAX_REPEATED else repeated
        marked = base.withColumn("same", same).join(known.withColumn("again", F.lit(True)), "same", "left")
        rows = marked.withColumn("key", F.when(F.col("again"), shuffle_key(seed, "id", "text", "row")).otherwise(shuffle_key(seed, "id", "text")))
    rows = rows.select("id", "stratum", "key", "size", "crc")
    per_range = max(RANGE_ROWS, -(-total // MAX_RANGES))

    # Ranges of the shuffled key within each source: how many, and what comes before each.
    counts = base.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).select("stratum", "n", F.ceil(F.col("n") / per_range).cast("long").alias("ranges"))
    # Without a join by source no task gets a hot source's rows together.
    hint = F.broadcast if counts.count() <= MAX_SOURCES else (lambda frame: frame)
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    keyed = lambda frame: frame.join(hint(counts), "stratum").withColumn("range", F.floor(place * F.col("ranges")).cast("long"))
    slim = keyed(rows.select("stratum", "key"))
    in_source = Window.partitionBy("stratum").orderBy("range")
    firsts = slim.groupBy("stratum", "range").agg(F.count(F.lit(1)).alias("k")).select(
        "stratum", "range", (F.sum("k").over(in_source) - F.col("k")).alias("first")
    )
    in_range = Window.partitionBy("stratum", "range").orderBy("key", "id", "size", "crc")
    ranked = (
        keyed(rows)
        .repartition(partitions(df), "stratum", "range")  # never by the source alone, as the join might have it
        .withColumn("at", F.row_number().over(in_range) - 1)
        .join(firsts, ["stratum", "range"])
        .withColumn("fraction", (2 * (F.col("first") + F.col("at")) + 1).cast("double") / (2 * F.col("n")).cast("double"))
    )

    # The same once more with the fractional rank, over all sources.
    slices = max(1, -(-total // per_range))
    sliced = ranked.select("id", "stratum", "key", "size", "crc", "fraction", F.floor(F.col("fraction") * slices).cast("long").alias("slice"))
    before = sliced.groupBy("slice").agg(F.count(F.lit(1)).alias("k")).select(
        "slice", (F.sum("k").over(Window.orderBy("slice")) - F.col("k")).alias("first")
    )
    in_slice = Window.partitionBy("slice").orderBy("fraction", "stratum", "key", "id", "size", "crc")
    placed = sliced.withColumn("at", F.row_number().over(in_slice) - 1).join(before, "slice").withColumn("position", F.col("first") + F.col("at"))
    shard = F.expr(f"position * {shards} div {max(1, total)}")
    return placed.withColumn("shard", shard).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("position") - F.expr(f"(shard * {total} + {shards - 1}) div {shards}")).alias("slot"),
        "fraction",
    )
