"""Dense vectors: normalisation, similarity of neighbours, exact top-k search, semantic breaks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import top_k
from .ranked import Best, collected, orderable, rounded, slices, task_best

EPSILON = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_normalize(vector: Column) -> Column:
    return F.transform(F.array(F.sqrt(dot(vector, vector)) + EPSILON), lambda n: F.transform(vector, lambda x: x.cast("double") / n))[0]


#: Components of query vectors in a block that is broadcast, at most (64 MB).
BLOCK_COMPONENTS = 8 << 20


def dense_hits(nodes: DataFrame, queries: DataFrame, k: int = 10, *, digits: int = 6) -> DataFrame:
    """Exact inner-product search of a stated query set against all vectors (``node_id``, ``vector``; ``query_id``, ``q``).

    The query set is counted and cut into blocks of a bounded size. A block is
    broadcast: the vectors stay where they are, and each task keeps the best
    ``k`` of its rows for every query, so that what is held and shuffled does not
    grow with the pairs. Matrix products find the rows in question; their scores
    are then summed up in the order of the components, as ``dot`` does. A pair of
    vectors that are null, hold nulls or differ in length scores 0.
    """
    size = queries.agg(F.sum(F.size("q"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_COMPONENTS))
    nodes = nodes.select("node_id", "vector")
    if not orderable(nodes.schema["node_id"].dataType):
        raise TypeError("node_id must be an integer or a string")
    found = None
    for i in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        rows, names = collected(part, ["q"])
        block = task_best(nodes, names, _search(nodes.sparkSession, _by_length(rows.column("q").combine_chunks()), rows.num_rows, k, digits))
        found = block if found is None else found.unionAll(block)
    return top_k(found, k).select("query_id", "node_id", "score", "rank")


def _by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and double-precision rows of the vectors without nulls, by their length."""
    size = np.asarray(pc.fill_null(pc.list_value_length(column), -1), np.int64)
    flat = column.flatten()
    values = np.asarray(pc.fill_null(flat.cast(pa.float64()), 0.0))
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    if flat.null_count:
        owner = np.repeat(np.arange(len(size)), np.maximum(size, 0))
        size[owner[np.asarray(flat.is_null())]] = -1
    groups = {}
    for n in set(size[size >= 0].tolist()):
        at = np.flatnonzero(size == n)
        groups[n] = at, values[start[at][:, None] + np.arange(n)]
    return groups


def _search(spark, asked: dict[int, tuple[np.ndarray, np.ndarray]], queries: int, k: int, digits: int):
    shared = spark.sparkContext.broadcast(asked)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        with np.errstate(all="ignore"):
            sizes = {n: np.sqrt((q * q).sum(axis=1)) for n, (_, q) in asked.items()}
        best = None
        for batch in slices(batches, queries):
            ids = batch.column("node_id")
            best = best or Best(queries, k, ids.type)
            scores, slack = np.zeros((batch.num_rows, queries)), np.zeros(queries)
            rows = _by_length(batch.column("vector"))
            with np.errstate(all="ignore"):
                for n in rows.keys() & asked.keys():
                    (i, x), (j, q) = rows[n], asked[n]
                    norms = np.sqrt((x * x).sum(axis=1))
                    odd = ~np.isfinite(norms)
                    product = x @ q.T
                    product[odd] = np.nan
                    if len(i) == batch.num_rows and len(j) == queries:
                        scores = product
                    else:
                        scores[np.ix_(i, j)] = product
                    slack[j] = np.maximum(slack[j], (n + 4) * 2.0**-51 * norms[~odd].max(initial=0.0) * sizes[n])
                i, j = np.nonzero(~(scores < best.least(scores, slack * 2 + 10.0**-digits)))
            best.offer(j, rounded(_exact(rows, asked, i, j, batch.num_rows, queries), digits), ids.take(pa.array(i)))
        if best is not None:
            yield best.batch()

    return task


def _exact(rows: dict, asked: dict, i: np.ndarray, j: np.ndarray, n_rows: int, n_queries: int) -> np.ndarray:
    """Dot products of pairs, one component after the other."""
    out = np.zeros(len(i))
    for n in rows.keys() & asked.keys():
        place, where = np.full(n_rows, -1), np.full(n_queries, -1)
        place[rows[n][0]], where[asked[n][0]] = np.arange(len(rows[n][0])), np.arange(len(asked[n][0]))
        pairs = np.flatnonzero((place[i] >= 0) & (where[j] >= 0))
        for a in range(0, len(pairs), 16384):
            some = pairs[a : a + 16384]
            with np.errstate(all="ignore"):
                out[some] = np.cumsum(rows[n][1][place[i[some]]] * asked[n][1][where[j[some]]], axis=1)[:, -1] if n else 0.0
    return out


def cosine_of_rows(groups: dict[int, tuple[np.ndarray, np.ndarray]], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The cosine of each row with the next one, as ``adjacent_similarity`` works it out, and whether there is one."""
    out, known = np.zeros(rows), np.zeros(rows, bool)
    total = lambda x: np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))
    with np.errstate(all="ignore"):
        for at, x in groups.values():
            for a in range(0, len(at), 16384):
                i, v = at[a : a + 16385], x[a : a + 16385]
                norm = np.sqrt(total(v * v)) + EPSILON
                next_to = np.flatnonzero(i[1:] == i[:-1] + 1)
                out[i[next_to]] = total(v[next_to] * v[next_to + 1]) / (norm[next_to] * norm[next_to + 1])
                known[i[next_to]] = True
    return out, known


def adjacent_similarity(rows: DataFrame, group_col: str, order_col: str, vector_col: str) -> DataFrame:
    """``sim``: the cosine of each row's vector with the next one's in its group; null at the end."""
    following = F.lead(vector_col).over(Window.partitionBy(group_col).orderBy(order_col))
    both = rows.withColumn("following", following)
    norm = lambda v: F.sqrt(dot(v, v))
    here, there = F.col(vector_col), F.col("following")
    sim = F.when(there.isNotNull(), dot(here, there) / ((norm(here) + EPSILON) * (norm(there) + EPSILON)))
    return both.withColumn("sim", sim).drop("following")


def percentile_breaks(rows: DataFrame, group_col: str, order_col: str, percentile: float = 95.0) -> DataFrame:
    """Breaks after rows whose distance to the next exceeds the group's percentile; ``part`` numbers what lies between."""
    limits = rows.groupBy(group_col).agg(F.expr(f"percentile(1 - sim, {percentile / 100})").alias("limit"))
    marked = rows.join(limits, group_col).withColumn("breaks", F.coalesce(F.round(1 - F.col("sim"), 9) > F.round("limit", 9), F.lit(False)))
    return islands(marked, group_col, order_col, "breaks").drop("limit")


def topic_breaks(rows: DataFrame, group_col: str, order_col: str, *, threshold: float = 0.55, window: int = 3) -> DataFrame:
    """Breaks where the mean similarity of up to ``window`` gaps on either side lies below the threshold."""
    near = Window.partitionBy(group_col).orderBy(order_col).rowsBetween(-window, window)
    return rows.withColumn("breaks", F.col("sim").isNotNull() & (F.round(F.avg("sim").over(near), 9) < threshold))


def islands(rows: DataFrame, group_col: str, order_col: str, flag_col: str) -> DataFrame:
    """``part``: how many flags stand before a row in its group."""
    before = Window.partitionBy(group_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("part", F.coalesce(F.sum(F.col(flag_col).cast("int")).over(before), F.lit(0)).cast("long"))
