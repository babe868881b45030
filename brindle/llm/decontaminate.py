"""Benchmark items inside documents: size-partitioned MinHash containment search.

Documents and items are sets of their word 5-shingles, each with one hash. An
item of n shingles is contained if a document has need = ceil(t * n) of them, so
at most n - need are missing, and of any n - need + 1 one is there. The item's
MinHash signature, its n - need + 1 least hashes, is therefore a lossless index
entry: a document that holds the item holds a hash of its signature, and items
of a few shingles, which a signature of fixed size would lose, are found like
all others. Signatures have about a fifth of the shingles.

1. Items are partitioned by ``need`` in powers of two, documents by their number
   of shingles; a document probes the signatures of its own partition and of
   smaller ones, as it cannot hold what needs more shingles than it has.
2. Candidates, a document and an item, are verified by exact containment: only
   documents with a candidate are cut into shingles again and compared with all
   shingles of items.

Shingles are made in the row, so documents are not shuffled; hits are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import BROADCAST_IDS, cut_lineage, without_ids

SHINGLE_WORDS = 5
MIN_CONTAINMENT = 0.8
#: Rows of signatures, or of item shingles, up to which they are broadcast (about 100 MB); beyond it the join shuffles.
BROADCAST_SHINGLES = 2_000_000


def words_of(text: Column) -> Column:
    """Lower-case words: runs of letters, digits and combining marks."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")


def shingle_hashes(text: Column, k: int = SHINGLE_WORDS) -> Column:
    """The distinct hashes of a text's shingles; a text of fewer than ``k`` words is one shingle, without words none."""
    hashed = F.transform(words_of(text), lambda w: F.xxhash64(w))

    def shingles(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1)))
        one = lambda i: F.xxhash64(*[F.try_element_at(words, i + j) for j in range(k)])
        return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.transform(starts, one)))

    # Bound once by a one-element transform, so that the words are not computed for every use.
    return F.transform(F.array(hashed), shingles)[0]


def find_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    min_containment: float = MIN_CONTAINMENT,
    shingle_words: int = SHINGLE_WORDS,
) -> DataFrame:
    """The items contained in documents: one row for each document id and item id.

    Columns: the id column, the item id column, ``shared`` (item shingles found),
    ``item_shingles`` and ``containment``. Null or empty items and documents are
    in no row; items of fewer than five words are one shingle, which documents
    hold only if they are that short as well. Rows with one document id count as
    one document, and so do rows with one item id (the union of their shingles);
    null ids match nothing. Other columns are not read.
    """
    known = cut_lineage(
        items.select(F.col(item_id_col).alias("item"), F.explode(shingle_hashes(F.col(item_text_col), shingle_words)).alias("h"))
        .where("item is not null")
        .distinct()
    )
    need = F.greatest(F.ceil(F.col("item_shingles") * (min_containment * (1 - 1e-12))), F.lit(1))
    sizes = known.groupBy("item").agg(F.count(F.lit(1)).alias("item_shingles")).withColumn("need", need)
    signatures = cut_lineage(
        known.withColumn("at", F.row_number().over(Window.partitionBy("item").orderBy("h")))
        .join(sizes, "item")
        .where(F.col("at") <= F.col("item_shingles") - F.col("need") + 1)
        .select("h", "item", size_class(F.col("need")).alias("least_class"))
    )

    def hinted(frame: DataFrame) -> DataFrame:
        return F.broadcast(frame) if frame.count() <= BROADCAST_SHINGLES else frame

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # An id in several rows has the shingles of all of them, so one row's number says nothing about its size.
    repeated = not rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    # A one-element explode pins the array: filters and projections above it do not compute it again.
    pinned = lambda frame: frame.select("id", F.explode(F.array(shingle_hashes(F.col("text"), shingle_words))).alias("hashes"))
    own_class = F.lit(64) if repeated else size_class(F.size("hashes"))
    probes = pinned(rows).select("id", own_class.alias("own_class"), F.explode("hashes").alias("h"))
    candidates = cut_lineage(probes.join(hinted(signatures), "h").where("least_class <= own_class").select("id", "item").distinct())

    asked = candidates.select("id").distinct()
    suspects = rows.join(F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked, "id", "left_semi")
    hits = pinned(suspects).select("id", F.explode("hashes").alias("h")).join(hinted(known), "h")
    # A document id in several rows can show a shingle more than once, hence the distinct hashes.
    found = hits.select("id", "item", "h").distinct().groupBy("id", "item").agg(F.count(F.lit(1)).alias("shared"))
    return (
        found.join(candidates, ["id", "item"], "left_semi")
        .join(F.broadcast(sizes) if sizes.count() <= BROADCAST_SHINGLES else sizes, "item")
        .withColumn("containment", F.col("shared") / F.col("item_shingles"))
        .where(F.col("containment") >= min_containment)
        .select(F.col("id").alias(id_col), F.col("item").alias(item_id_col), "shared", "item_shingles", "containment")
    )


def size_class(n: Column) -> Column:
    """The power of two that ``n`` reaches."""
    return F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")) + 1e-9).cast("int")


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item was found; rows with a null id stay."""
    bad = find_items(docs, items, id_col=id_col, **options).select(F.col(id_col).alias("__contaminated")).distinct()
    return without_ids(docs, id_col, bad)
