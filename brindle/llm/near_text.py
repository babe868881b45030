"""Near-duplicate texts: consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its word 5-shingles, weighted tf * idf with
idf = log(1 + N / (df + SMOOTHING * N)) for N documents. Document frequencies
cover all documents, equal texts once (see ``block_counts``). The smoothing is
a share of the corpus: a passage that all texts have weighs less than half of
a unique shingle, yet copies that are alike by 0.85 without weights stay above
0.8 even in a group of a third of all rows, where the unsmoothed idf makes the
few shingles of an edit outweigh all that the copies share.

1. Equal texts are one class from the start.
2. A shingle no other text has cannot be shared, so a text in which such
   shingles hold more than 1 - threshold of the weight resembles no other text
   that far. This exact bound removes most texts of a corpus.
3. Improved consistent weighted sampling (Ioffe 2010) draws ``BANDS * ROWS``
   samples of each remaining text; texts that agree in a band are candidates.
4. Candidates are verified by their exact weighted Jaccard similarity, and links
   are united to classes. A bucket is not expanded into all pairs: every text is
   compared with the least member of one of its buckets, then with those of its
   other buckets that are of another class. What a bucket's largest class leaves
   outside is compared with the bucket's texts of other classes by jobs: buckets
   whose largest class is the same go together, both sides are cut into slices
   of bounded size, and each pair of slices is a job, which returns one link for
   each two classes that it finds linked. Members of one class need no
   comparison, so no link between classes is lost, and nothing passes the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import ROWS_CONF, Scratch, conf_for, without_ids
from .block_counts import BlockCounts, blocked, mix, pack_hashes, span_hashes, text_bytes, unpack_hashes
from .components import components

SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
BANDS, ROWS = 16, 3
SMOOTHING = 0.5
#: Low-order bytes of a shingle's hash that a set keeps.
KEPT_BYTES = 7
SAMPLE_ROWS = 1 << 13
#: UTF-8 bytes of text in a block, about: a worker needs some 30 times as much.
BLOCK_BYTES = 2_000_000
#: Bytes of packed sets in a slice of what is outside and of the texts it is compared with.
ASKING_BYTES, ASKED_BYTES = 1 << 20, 4 << 20
#: Groups of buckets up to which their numbers of slices are broadcast.
MAX_GROUPS = 500_000
#: Rows here hold whole shingle sets, so few go to a Python worker at once; shuffle files go when the table they made is written.
SETTINGS = {ROWS_CONF: "256", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def shingle_sets(texts: pa.Array, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, hash and count of each distinct shingle, by text and then by hash.

    Words are runs of ASCII letters and digits and of non-ASCII characters, in
    ASCII lower case. A text of fewer than ``k`` words is one shingle.
    """
    data, ends = text_bytes(texts)
    word = _WORD[data]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, stops = edge[::2], edge[1::2]
    words = span_hashes(_FOLD[data], starts, stops)
    text = np.searchsorted(ends, starts)
    n = np.bincount(text, minlength=len(ends))
    first = np.cumsum(n) - n
    rank = np.arange(len(words)) - first[text]
    shingle = words.copy()
    for j in range(1, k):
        # Word j of the shingle that starts here, nothing beyond the text's end.
        shingle *= np.uint64(0x9DDFEA08EB382D69)
        shingle ^= shingle >> np.uint64(32)
        m = max(0, len(words) - j)
        shingle[:m] += np.where(rank[:m] + j < n[text[:m]], words[j:], np.uint64(0))
    begins = (rank + k <= n[text]) | (rank == 0)
    shingle, text = mix(shingle[begins]), text[begins]
    order = np.lexsort((shingle, text))
    shingle, text = shingle[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], shingle[at], np.diff(at, append=len(text))


_draws: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, log c - r and beta of the samples, by the low bits of a shingle's hash; the same in every task."""
    global _draws
    if _draws is None:
        rng = np.random.Generator(np.random.PCG64(8))
        size = (SAMPLE_ROWS, BANDS * ROWS)
        r = rng.gamma(2, 1, size)
        _draws = tuple(x.astype(np.float32) for x in (r, np.log(rng.gamma(2, 1, size)) - r, rng.random(size)))
    return _draws


def band_keys(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One key for each band from the consistent weighted samples of a set (ascending hashes)."""
    r, c, beta = draws()
    best = sample = None
    for at in range(0, len(hashes), 1 << 14):
        h = hashes[at : at + (1 << 14)]
        row = (h >> np.uint64(3)).astype(np.int64) & (SAMPLE_ROWS - 1)
        rr, bb = r[row], beta[row]
        t = np.floor(np.log(weights[at : at + len(h)], dtype=np.float32)[:, None] / rr + bb)
        value = c[row] - rr * (t - bb)
        least = value.argmin(axis=0)
        cols = np.arange(value.shape[1])
        found = mix(h[least] + t[least, cols].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        low = value[least, cols]
        if best is None:
            best, sample = low, found
        else:
            sample = np.where(low < best, found, sample)
            best = np.minimum(best, low)
    keys = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for j in range(ROWS):
        keys = mix(keys * np.uint64(0x165667B19E3779F9) + sample[j::ROWS])
    return keys


def _candidates(docs: DataFrame, total: int, min_similarity: float) -> DataFrame:
    """``id``, ``weight``, ``hashes``, ``weights`` and ``bands`` of the texts that can resemble another."""

    def make(columns: list[pa.Array]):
        ids, texts = columns
        # Of an id's texts the least one counts; rows that are repeated count once.
        rows = sorted(zip(ids.to_pylist(), texts.cast(pa.binary()).to_pylist(), range(len(ids)), strict=True))
        by_id = {row[0]: row for row in reversed(rows)}
        by_text = {row[1]: row for row in sorted(by_id.values(), reverse=True)}
        keep = pa.array(sorted(row[2] for row in by_text.values()), pa.int64())
        ids, texts = ids.take(keep), texts.take(keep)
        text, hashes, tf = shingle_sets(texts)
        values, where, docs_in = np.unique(hashes, return_inverse=True, return_counts=True)
        return [(values, docs_in)], (ids, text, hashes, tf, where)

    def use(work, kinds, totals, corpus) -> pa.RecordBatch:
        ids, text, hashes, tf, where = work
        df = totals[0][where]
        weight = tf * np.log(1 + total / (np.minimum(df, total) + SMOOTHING * total))
        whole = np.bincount(text, weights=weight, minlength=len(ids))
        common = np.bincount(text, weights=weight * (df > 1), minlength=len(ids))
        chosen = np.flatnonzero((whole > 0) & (common >= min_similarity * whole * (1 - 1e-9)))
        shared = df > 1
        text, hashes, weight = text[shared], hashes[shared], weight[shared].astype(np.float32)
        lo, hi = np.searchsorted(text, chosen), np.searchsorted(text, chosen, "right")
        mask = np.uint64((1 << (8 * KEPT_BYTES)) - 1)
        rows = [(np.sort(hashes[a:b] & mask), hashes[a:b], weight[a:b], np.argsort(hashes[a:b] & mask)) for a, b in zip(lo, hi, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(chosen)),
                pa.array(whole[chosen]),
                pa.array([pack_hashes(low, KEPT_BYTES) for low, _, _, _ in rows], pa.binary()),
                pa.array([w[o].tobytes() for _, _, w, o in rows], pa.binary()),
                pa.array([band_keys(h, w).view(np.int64) for _, h, w, _ in rows], pa.list_(pa.int64())),
            ],
            names=["id", "weight", "hashes", "weights", "bands"],
        )

    blocks, ranges = blocked(docs, "text", F.xxhash64("id"), BLOCK_BYTES)
    return BlockCounts(make, use, 1).run(blocks, ranges, "id long, weight double, hashes binary, weights binary, bands array<bigint>")


def _shared_weights(hashes: np.ndarray, weights: np.ndarray, others: np.ndarray, other_weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The weight that a set (ascending hashes) shares with each of the sets that are laid end to end from ``starts``."""
    at = np.searchsorted(hashes, others)
    at[at == len(hashes)] = 0
    same = np.where(hashes[at] == others, np.minimum(weights[at], other_weights), np.float32(0))
    return np.add.reduceat(same, starts, dtype=np.float64)


def _similar(weight_a, weight_b, shared, min_similarity: float):
    return shared >= min_similarity * (weight_a + weight_b - shared) * (1 - 1e-6)


def _linked(pairs: DataFrame, sets: DataFrame, min_similarity: float) -> DataFrame:
    """Those of the distinct pairs (``a``, ``b``) that are similar enough."""
    side = lambda x: sets.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("weight", "hashes", "weights")])
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")

    def verify(batches):
        for batch in batches:
            get = {c: batch.column(k).to_pylist() for k, c in enumerate(batch.schema.names)}
            keep = []
            last = None
            for i in range(batch.num_rows):
                if get["a"][i] != last:
                    last, ha, wa = get["a"][i], unpack_hashes(get["hashes_a"][i], KEPT_BYTES), np.frombuffer(get["weights_a"][i], np.float32)
                hb, wb = unpack_hashes(get["hashes_b"][i], KEPT_BYTES), np.frombuffer(get["weights_b"][i], np.float32)
                shared = _shared_weights(ha, wa, hb, wb, np.zeros(1, np.int64))[0] if len(ha) and len(hb) else 0.0
                keep.append(bool(_similar(get["weight_a"][i], get["weight_b"][i], shared, min_similarity)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    columns = ["a", "b", "weight_a", "hashes_a", "weights_a", "weight_b", "hashes_b", "weights_b"]
    return both.select(*columns).mapInArrow(verify, "a long, b long")


def _job(table: pa.Table, min_similarity: float) -> pa.Table:
    """Links (``a``, ``b``) between the classes of the texts that ask and of those that are asked, where they share a bucket: one for each two classes."""
    ask = table.column("asks").to_pylist()
    label, weight = table.column("label").to_numpy(), table.column("weight").to_numpy()
    hashes, weights, buckets = (table.column(c) for c in ("hashes", "weights", "buckets"))
    sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def set_of(i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in sets:
            sets[i] = unpack_hashes(hashes[i].as_py(), KEPT_BYTES), np.frombuffer(weights[i].as_py(), np.float32)
        return sets[i]

    where: dict[int, list[int]] = {}
    for i, asks in enumerate(ask):
        if not asks:
            for bucket in buckets[i].as_py():
                where.setdefault(bucket, []).append(i)
    linked: dict[int, set[int]] = {}
    for q in np.flatnonzero(ask).tolist():
        hit = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.array(where.get(bucket, ()), np.int64) for bucket in buckets[q].as_py()]]))
        hit = hit[label[hit] != label[q]]
        hit = hit[np.minimum(weight[hit], weight[q]) >= min_similarity * (1 - 1e-9) * np.maximum(weight[hit], weight[q])]
        if not len(hit):
            continue
        own, own_weights = set_of(q)
        # A few sets at a time, so that a text of very many partners needs little memory; what is of a class that is linked by now is left out.
        mine = int(label[q])
        done = np.array(sorted(linked.get(mine, ())), np.int64)
        while len(hit := hit[~np.isin(label[hit], done)]):
            some, hit = hit[:128], hit[128:]
            found = [set_of(i) for i in some.tolist()]
            sizes = np.array([len(h) for h, _ in found])
            shared = _shared_weights(own, own_weights, np.concatenate([h for h, _ in found]), np.concatenate([w for _, w in found]), np.cumsum(sizes) - sizes)
            others = np.unique(label[some[_similar(weight[some], weight[q], shared, min_similarity)]])
            for x in others.tolist():
                linked.setdefault(mine, set()).add(x)
                linked.setdefault(x, set()).add(mine)
            done = np.concatenate([done, others])
    pairs = sorted((x, y) for x, others in linked.items() for y in others if x < y)
    return pa.table([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _linked_outside(buckets: DataFrame, labels: DataFrame, sets: DataFrame, scratch: Scratch, min_similarity: float) -> DataFrame:
    """Links (``a``, ``b``) between classes that texts outside the largest class of one of their buckets have there."""
    now = scratch.table(
        buckets.select("bucket", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label"))
    )
    per_label = now.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
    mixed = per_label.groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    mixed = scratch.table(mixed.select("bucket", F.col("top.label").alias("group")))
    rows = now.join(mixed, "bucket")
    # Every text of a mixed bucket is asked; those outside the largest class ask as well.
    sides = rows.withColumn("asks", F.lit(False)).unionAll(rows.where("label <> group").withColumn("asks", F.lit(True)))
    sides = sides.groupBy("group", "asks", "id", "label").agg(F.collect_set("bucket").alias("buckets"))
    sides = scratch.table(sides.join(sets.select("id", (F.length("hashes") + F.length("weights")).alias("bytes")), "id"))
    bytes_of = lambda asks: F.sum(F.when(F.col("asks") == F.lit(asks), F.col("bytes")))
    slices = scratch.table(
        sides.groupBy("group").agg(
            F.ceil(bytes_of(True) / ASKING_BYTES).cast("int").alias("asking"), F.ceil(bytes_of(False) / ASKED_BYTES).cast("int").alias("asked")
        )
    )
    sliced = sides.join(F.broadcast(slices) if slices.count() <= MAX_GROUPS else slices, "group")
    slice_of = lambda n: F.pmod(F.xxhash64(F.lit(4), "id"), F.greatest(n, F.lit(1))).cast("int")
    own = F.when(F.col("asks"), slice_of(F.col("asking"))).otherwise(slice_of(F.col("asked")))
    other = F.explode(F.sequence(F.lit(0), F.greatest(F.when(F.col("asks"), F.col("asked")).otherwise(F.col("asking")), F.lit(1)) - 1))
    dealt = sliced.withColumn("own", own).withColumn("other", other)
    jobs = dealt.select(
        "id", "label", "asks", "buckets", "group",
        F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")).alias("low"),
        F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")).alias("high"),
    )
    whole = jobs.join(sets.select("id", "weight", "hashes", "weights"), "id")
    return whole.groupBy("group", "low", "high").applyInArrow(lambda t: _job(t, min_similarity), "a long, b long")


def _merged(labels: DataFrame | None, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` (``node``, ``label``; least nodes have none) after the ``edges`` have united more; they are written."""
    if labels is None:
        return components(edges, scratch)
    if edges.isEmpty():
        return labels
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    united = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    new = components(united, scratch)
    moved = labels.join(new.select(F.col("node").alias("label"), F.col("label").alias("now")), "label", "left").select("node", F.coalesce("now", "label").alias("label"))
    return scratch.table(moved.unionAll(new.select("node", "label")))


def near_classes(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """The class of near duplicates of every document.

    Columns: the id column (as long) and ``class_id``, the least id of the
    class; one row for each distinct id that is not null. Ids must be integers;
    others raise ``TypeError``. Links are weighted Jaccard similarities of
    ``min_similarity`` or more, and classes are what links connect. Equal texts,
    the empty text too, are one class; null texts resemble nothing; texts
    without words only equal ones. Rows with one id are one document: each of
    its texts counts for equality, the least one for links. An empty table gives
    no rows. Other columns are not read. The result is computed at once and
    written to the shared folder; what was written on the way is removed.
    """
    if df.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be an integer column")
    scratch, result = Scratch(df.sparkSession), Scratch(df.sparkSession)
    try:
        with conf_for(df.sparkSession, SETTINGS):
            return result.table(_near_classes(df, id_col, text_col, min_similarity, scratch))
    finally:
        scratch.drop()


def _near_classes(df: DataFrame, id_col: str, text_col: str, min_similarity: float, scratch: Scratch) -> DataFrame:
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.count()
    key_of = F.struct(F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y"), F.length("text").alias("n"))
    key = scratch.table(rows.select("id", F.when(F.col("text").isNotNull(), key_of).alias("key")))
    # An id and a text count once together, however many rows have them.
    own = key.where("key is not null").groupBy("id", "key").agg(F.count(F.lit(1)).alias("rows")).withColumn("own", F.lit(True))
    several = scratch.table(own.groupBy("id").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("texts")).where("rows > 1"))
    first = None
    if not several.isEmpty():
        # Of an id's texts the least one is its own.
        first = scratch.table(rows.where("text is not null").join(several.select("id"), "id").groupBy("id").agg(F.min("text").alias("text")))
        firsts = first.select("id", key_of.alias("first"))
        own = own.drop("own").join(firsts, "id", "left").select("id", "key", F.coalesce(F.col("key") == F.col("first"), F.lit(True)).alias("own"))
    # A text's representative is the least id whose own text it is, so no id stands for two texts that are compared.
    own = scratch.table(own.select("id", "key", "own"))
    least = own.groupBy("key").agg(F.coalesce(F.min(F.when(F.col("own"), F.col("id"))), F.min("id")).alias("rep"))
    known = scratch.table(own.join(least, "key").select("id", "rep", "own").distinct())
    member = scratch.table(known.select("id", "rep").unionAll(key.where("key is null").select("id", F.col("id").alias("rep"))).distinct())

    # Only representatives are counted, each distinct text once in the corpus, from one row.
    standing = rows.where("text is not null")
    if first is not None:
        standing = without_ids(standing, "id", several.select(F.col("id").alias("other"))).unionAll(first)
    others = known.where("own and id <> rep").select(F.col("id").alias("other")).distinct()
    sets = scratch.table(_candidates(without_ids(standing, "id", others), total, min_similarity))

    buckets = sets.select("id", "weight", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "weight")).alias("least")).where("n > 1")
    buckets = scratch.table(buckets.join(shared.select("bucket", "least"), "bucket"))
    # The ratio of two weights bounds their similarity.
    close = F.least("weight", "least.weight") >= F.lit(min_similarity * (1 - 1e-9)) * F.greatest("weight", "least.weight")
    pairs = buckets.where("id <> least.id").where(close).select(F.col("least.id").alias("a"), F.col("id").alias("b"))
    first = scratch.table(pairs.groupBy("b").agg(F.min("a").alias("a")))
    labels = _merged(None, scratch.table(_linked(first, sets, min_similarity)), scratch)
    label = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    apart = pairs.distinct().join(label("a"), "a", "left").join(label("b"), "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b"))
    apart = scratch.table(apart.select("a", "b").join(first, ["a", "b"], "left_anti"))
    labels = _merged(labels, scratch.table(_linked(apart, sets, min_similarity)), scratch)
    labels = _merged(labels, scratch.table(_linked_outside(buckets, labels, sets, scratch, min_similarity)), scratch)
    # An id with several texts ties their classes together; that is rare.
    ties = scratch.table(
        member.join(member.groupBy("id").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"), "id").select("a", F.col("rep").alias("b")).where("a <> b")
    )
    labels = _merged(labels, ties, scratch)
    found = member.join(labels.withColumnRenamed("node", "rep"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("label", "rep")).alias("class_id"))
    return found.select(F.col("id").alias(id_col), "class_id")


def drop_near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df``, with all their columns, that stand for their class: the least id of each, once; rows with a null id stay.

    Of the rows of one id that one stands whose text, and then whose other
    columns, come first as a JSON text in Spark's order; null texts come last.
    An empty table stays empty.
    """
    classes = near_classes(df, id_col=id_col, text_col=text_col, **options)
    gone = classes.where(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias("__gone"))
    left = without_ids(df, id_col, gone)
    again = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col(id_col).alias("__id"))
    if again.isEmpty():
        return left
    rest, twice = without_ids(left, id_col, again), left.join(again, left[id_col] == again["__id"], "left_semi")
    order = F.struct(F.col(text_col).isNull().alias("a"), F.col(text_col).alias("b"), F.to_json(F.struct(*[df[c] for c in df.columns])).alias("c"))
    chosen = twice.groupBy(id_col).agg(F.min_by(F.struct(*df.columns), order).alias("__row")).select("__row.*")
    return rest.unionAll(chosen)
