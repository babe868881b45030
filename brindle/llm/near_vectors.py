"""Near-duplicate vectors: an exact metric range join.

Cosine of unit vectors is a Euclidean distance, so "cosine >= t" is "distance
<= r" with r = sqrt(2 - 2t). In each label that is large enough, pivots divide
the vectors into cells (the nearest pivot is home). By the triangle inequality
a vector within r of x can only be at home in cells j with
d(x, p_j) <= d(x, p_home) + 2r, so x is copied to those of them that come after
its home, and each cell joins its own vectors with each other and with those
copied to it: every pair meets in exactly one cell. Between points of a
Euclidean space the triangle inequality holds in a stronger form, which sets the
replication: x is not nearer than (d(x, p_j)^2 - d(x, p_home)^2) / (2 d(p_home, p_j))
to the plane beyond which p_j is the nearer pivot. Cells of more than
``BLOCK_ROWS`` rows are dealt to blocks by a hash, and each pair of blocks is a
job of its own, so no task holds more than two blocks. Where most vectors reach
most cells (they are spread evenly in many dimensions), copies would cost more
than the cells save, and the label is one cell. Single precision finds the
pairs in question; double precision decides.

Equal vectors are one class with a multiplicity, and jobs return counts and a
spanning forest of their links, so a dense group is not expanded into pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch
from .components import components

MIN_COSINE = 0.93
CELL_ROWS = 2000
BLOCK_ROWS = 16_000
#: Rows on each side of a tile of cosines: 4 MB in single precision.
TILE_ROWS = 1024
#: Pivots in all, at most: 2 MB at 64 components. They are collected and broadcast.
MAX_PIVOTS = 4096


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of double-precision unit vectors; all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), len(flat) // max(1, len(column)))
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _reached(x: np.ndarray, centres: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The home cell of each vector, and row and cell of all that it goes to: its home, and later ones that it may have a link in."""
    d = np.sqrt(np.maximum(0, 2 - 2 * (x @ centres.T)))
    own = d.argmin(axis=1)
    nearest = d[np.arange(len(x)), own][:, None]
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)))[own]
    reach = d * d - nearest * nearest <= 2 * radius * apart + 1e-9
    reach &= np.arange(len(centres))[None, :] > own[:, None]
    reach[np.arange(len(x)), own] = True
    return own, *np.nonzero(reach)


def _cells(batches, pivots: dict, radius: float):
    """Home cell and copies of each vector: one row for each."""
    for batch in batches:
        groups = batch.column(0).to_pylist()
        where: dict = {}
        for i, g in enumerate(groups):
            where.setdefault(g, []).append(i)
        take, cell, home = [], [], []
        for g, at in where.items():
            centres = pivots.get(g)
            if centres is None:
                take += at
                cell += [0] * len(at)
                home += [True] * len(at)
                continue
            own, i, j = _reached(_unit(batch.column(2).take(pa.array(at))), centres, radius)
            take += np.array(at)[i].tolist()
            cell += j.tolist()
            home += (own[i] == j).tolist()
        rows = pa.array(take, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), pa.array(cell, pa.int32()), pa.array(home, pa.bool_()), *[batch.column(k).take(rows) for k in (1, 2, 3)]],
            names=["group", "cell", "home", "rep", "vector", "copies"],
        )


def _linked(x: np.ndarray, y: np.ndarray, min_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Which unit vectors of ``x`` and ``y`` have the cosine: single precision finds those in question, double precision decides."""
    slack = (x.shape[1] + 4) * 2.0**-23
    i, j = np.nonzero(x.astype(np.float32) @ y.astype(np.float32).T >= min_cosine - slack)
    if len(i) * 8 > len(x) * len(y):
        return np.nonzero(x @ y.T >= min_cosine)
    sure = np.concatenate([np.zeros(0, bool), *((x[i[a : a + 16384]] * y[j[a : a + 16384]]).sum(axis=1) >= min_cosine for a in range(0, len(i), 16384))])
    return i[sure], j[sure]


def _tie(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that each row is connected with, after more links."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _join_job(table: pa.Table, min_cosine: float) -> pa.Table:
    """Links in one job: a row for each vector that has any, with the linked rows and the least id it is connected with.

    Only pairs with a row at home are compared, each once, in tiles: what a job holds grows with its rows.
    """
    table = table.sort_by("rep")
    rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
    home = table.column("home").to_numpy(zero_copy_only=False)
    block, low, high = (table.column(c).to_numpy() for c in ("block", "low", "high"))
    x = _unit(table.column("vector").combine_chunks())
    links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))

    def compare(left: np.ndarray, right: np.ndarray, same: bool = False) -> None:
        nonlocal root
        for a in range(0, len(left), TILE_ROWS):
            rows = left[a : a + TILE_ROWS]
            for b in range(a if same else 0, len(right), TILE_ROWS):
                others = right[b : b + TILE_ROWS]
                i, j = _linked(x[rows], x[others], min_cosine)
                if same and a == b:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    i, j = rows[i], others[j]
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    root = _tie(root, i, j)

    at = lambda of, where: np.flatnonzero((block == of) & (home == where))
    first, second = low[0], high[0]
    if first == second:
        compare(at(first, True), at(first, True), True)
        compare(at(first, True), at(first, False))
    else:
        compare(at(first, True), np.flatnonzero(block == second))
        compare(at(first, False), at(second, True))
    some = np.flatnonzero(links)
    return pa.table([pa.array(rep[some]), pa.array(links[some]), pa.array(rep[root[some]])], names=["rep", "links", "root"])


def _prunes(pivots: np.ndarray, probes: np.ndarray, radius: float) -> bool:
    """Whether the cells of ``pivots`` save at least half of the comparisons: judged by the cells that vectors which are no pivots reach."""
    return len(probes) > 0 and 4 * len(_reached(probes, pivots, radius)[1]) <= len(probes) * len(pivots)


def near_vectors(
    df: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    min_cosine: float = MIN_COSINE,
) -> DataFrame:
    """Links and components of the vectors of ``df``, one row for each row.

    Columns: the id column, ``n_links`` (other rows linked directly),
    ``component_id`` (the least id reachable by links, its own included) and
    ``kept`` (whether that is its own). Two vectors are linked if their labels
    are equal and not null, they have as many components, and their cosine in
    double precision is ``min_cosine`` or more. Vectors that are null or empty,
    zero, or hold null or non-finite components, and rows with a null id, link
    with nothing: no links, their own component, kept. Repeated rows are
    vectors of their own that link with each other. An empty table gives no
    rows. Other columns are not read. The result is computed at once and written
    to the shared folder; what was written on the way is removed. Ids must be
    integers; others raise ``TypeError``.
    """
    if df.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be an integer column")
    scratch, result = Scratch(df.sparkSession), Scratch(df.sparkSession)
    try:
        return result.table(_near_vectors(df, id_col, vector_col, label_col, min_cosine, scratch))
    finally:
        scratch.drop()


def _near_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, min_cosine: float, scratch: Scratch) -> DataFrame:
    radius = math.sqrt(2 - 2 * min_cosine)
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    usable = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & finite & F.exists(vector, lambda v: v != 0)
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.when(F.coalesce(usable, F.lit(False)), F.concat_ws("|", F.col(label_col).cast("string"), F.size(vector))).alias("group"),
        F.transform(vector, lambda v: v + F.lit(0.0).cast("float")).alias("vector"),
    )
    good = rows.where("group is not null")
    key = F.struct("group", F.xxhash64("vector").alias("x"), F.xxhash64(F.lit(1), "vector").alias("y"))
    classes = scratch.table(good.groupBy(key.alias("key")).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")).withColumn("group", F.col("key.group")))

    # Pivots: a share of the classes of each large group, by a hash of their ids; few in all, whatever the input.
    sizes = classes.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    total = classes.count()
    cell_rows = max(CELL_ROWS, -(-total // (MAX_PIVOTS // 2)))
    large = sizes.where(F.col("n") > cell_rows)
    spin = (F.xxhash64(F.lit(9), "rep").cast("double") / float(1 << 64)) + 0.5
    # As many others tell whether they prune: where they would not, a group is one cell, and its rows are copied to block pairs only.
    drawn = classes.join(large, "group").where(spin < F.lit(2.0) / cell_rows).select("group", "rep", "vector", (spin < F.lit(1.0) / cell_rows).alias("pivot")).limit(2 * MAX_PIVOTS).toArrow()
    pivots: dict = {}
    if drawn.num_rows:
        drawn = drawn.sort_by("rep")
        names, chosen = np.array(drawn.column("group").to_pylist()), drawn.column("pivot").to_numpy(zero_copy_only=False)
        for g in set(names[chosen].tolist()):
            centres, probes = (_unit(drawn.filter(pa.array((names == g) & side)).column("vector").combine_chunks()) for side in (chosen, ~chosen))
            if _prunes(centres, probes, radius):
                pivots[g] = centres
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    slim = classes.select("group", "rep", "vector", "copies")
    dealt = scratch.table(
        slim.mapInArrow(
            lambda batches: _cells(batches, shared.value, radius),
            f"group string, cell int, home boolean, rep long, vector {slim.schema['vector'].dataType.simpleString()}, copies long",
        )
    )
    blocks = dealt.groupBy("group", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    split = dealt.join(blocks, ["group", "cell"]).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("blocks")).cast("int"))
    jobs = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "group", "cell", "home", "rep", "vector", "copies", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    links = scratch.table(jobs.groupBy("group", "cell", "low", "high").applyInArrow(lambda t: _join_job(t, min_cosine), "rep long, links long, root long"))
    labels = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    per_class = (
        classes.join(links.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
        .join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "rep").alias("component_id"))
    )
    keyed = rows.select("id", F.when(F.col("group").isNotNull(), key).alias("key"))
    component = F.coalesce("component_id", "id")
    return keyed.join(per_class, "key", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
