"""Language-model scores by a weighted backoff automaton over smoothed n-grams.

States are contexts: two words (or the start and a word), one word or the start,
and the empty one. A state of words u v has an arc for each trigram u v w seen
in training and a failure arc to the state v; a state v has an arc for each
bigram v w and a failure arc to the empty state; the empty state has an arc for
each token. With c for counts in training and c(s) for how often state s is
left, weights are log10 of

    arcs     P3(w) = (c(u v w) + strength * P2(w)) / (c(u v) + strength)
             P2(w) = (c(v w) + strength * P1(w)) / (c(v) + strength)
             P1(w) = (c(w) + 1) / (N + V + 1)
    failure  strength / (c(s) + strength)

for N tokens, V distinct ones and one more for all that is unknown. That is
Dirichlet-smoothed backoff: an arc that is missing weighs what the failure arc
and the arc behind it weigh, so what leaves a state sums to 1.

A text is read once from left to right, from the start state to its end token.
For each token failure arcs are followed until a state has an arc for it, and
the arc leads to the longest context that now holds (of states that nothing
leaves, the failure arc weighs nothing). The state after a token depends on the
last two tokens alone, so the walks of a whole block of texts are taken in step
by array operations. Counts reach the blocks as in ``block_counts``: a block
gets the part of the automaton that its texts walk through, and no more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import cut_lineage
from .block_counts import BlockCounts, blocked, mix, span_hashes, text_bytes

STRENGTH = 50.0
#: Equal rows from which on they are learnt from and scored once, with their number; fewer may share a block.
MANY_EQUAL = 64
#: Sorts of rows with so many equals, of which there are at most a 64th of the rows, up to which a list of them is broadcast (16 MB).
MAX_LISTED = 1_000_000
END = np.uint64(0x9E3779B97F4A7C15)
START = np.uint64(0xD1B54A32D192ED03)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens, an end token behind each text, and the number of tokens of each text."""
    data, ends = text_bytes(texts)
    data = _LOWER[data]
    word = ~_BLANK[data]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, stops = edge[::2], edge[1::2]
    words = span_hashes(data, starts, stops)
    per_text = np.searchsorted(starts, ends)  # words up to the end of each text
    out = np.insert(words, per_text, END)
    return out, np.diff(per_text, prepend=0) + 1


def ngram_hashes(shorter: np.ndarray, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The hash of each token with what comes before it: ``shorter`` is the hash of that at each place, the start token's at a text's first."""
    before = np.empty_like(tokens)
    before[1:] = shorter[:-1]
    before[first] = START
    before *= np.uint64(0xFF51AFD7ED558CCD)
    before ^= before >> np.uint64(29)
    before += tokens
    return mix(before)


def left_behind(counts: np.ndarray, first: np.ndarray, at_start: np.ndarray | int) -> np.ndarray:
    """How often the state of each place is left, from the counts of the n-grams that lead to it."""
    out = np.empty_like(counts)
    out[1:] = counts[:-1]
    out[first] = at_start
    return out


def walk(arc_counts: list[np.ndarray], state_counts: list[np.ndarray], word: np.ndarray, strength: float) -> np.ndarray:
    """The log10 weight of each step of the walk.

    ``arc_counts`` are the counts of each step's arc from the states of one and
    of two words, ``state_counts`` how often those states are left, ``word`` the
    weight of the empty state's arc. From the shortest state to the longest: a
    state that has the arc takes it, another one takes its failure arc and what
    the shorter state then did.
    """
    weight = word
    for arcs, left in zip(arc_counts, state_counts, strict=True):
        own = np.log10((arcs + strength * 10.0**weight) / (left + strength))
        failed = np.log10(strength / (left + strength)) + weight
        weight = np.where(arcs > 0, own, failed)
    return weight


def _distinct(hashes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct hashes, each one's summed weight, and where each item is among them."""
    values, where = np.unique(hashes, return_inverse=True)
    return values, np.bincount(where, weights=weight, minlength=len(values)).astype(np.int64), where


def score_texts(
    df: DataFrame,
    train: F.Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    strength: float = STRENGTH,
) -> DataFrame:
    """Scores every text of ``df`` with the model of those rows for which ``train`` holds.

    Columns: the id column, ``trained`` (whether the row was learnt from),
    ``n_tokens`` (with the end), ``n_known`` (tokens seen in training),
    ``train_tokens`` (N), ``base_score`` (log10 probability of the unigrams
    alone) and ``score`` (log10 probability of the text). A null or empty text
    is its end token alone; repeated rows count and are scored each; a null
    ``train`` counts as false. Without a training row every token is unknown
    and all probabilities are 1 (N = V = 0). Other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("trained"))
    # Rows that are equal in all that counts share a block, so many of them go there as one row.
    same = F.xxhash64("id", "text", "trained")
    equal = cut_lineage(rows.groupBy(same.alias("same")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MANY_EQUAL).select("same"))
    listed = equal.count()
    one = rows.withColumn("copies", F.lit(1).cast("long"))
    if listed:
        keyed, marks = rows.withColumn("same", same), F.broadcast(equal) if listed <= MAX_LISTED else equal
        few = keyed.join(marks, "same", "left_anti").select("id", "text", "trained", F.lit(1).cast("long").alias("copies"))
        one = few.unionAll(keyed.join(marks, "same", "left_semi").groupBy("id", "text", "trained").agg(F.count(F.lit(1)).alias("copies")))
    blocks, ranges = blocked(one, "text", F.xxhash64("id", "text"))

    def make(columns: list[pa.Array]):
        _, texts, trained, copies = columns
        tokens, lengths = token_hashes(texts)
        first = np.cumsum(lengths) - lengths
        two = ngram_hashes(tokens, tokens, first)
        three = ngram_hashes(two, tokens, first)
        weight = np.repeat(trained.to_numpy(zero_copy_only=False) * copies.to_numpy().astype(np.float64), lengths)
        found = [_distinct(h, weight) for h in (tokens, two, three)]
        return [f[:2] for f in found], (columns, lengths, [f[2] for f in found], found[0][0])

    def use(work, kinds, totals, corpus) -> pa.RecordBatch:
        (ids, _, trained, copies), lengths, places, values = work
        n, v = corpus[0]
        first = np.cumsum(lengths) - lengths
        c_word, c_pair, c_triple = (total[where] for total, where in zip(totals, places, strict=True))
        ends = totals[0][np.searchsorted(values, END)]  # as many texts start as end
        states = [left_behind(c_word, first, ends), left_behind(c_pair, first, 0)]
        c_triple[first] = 0  # the start is a state of one word
        word = np.log10((c_word + 1.0) / (n + 1.0 * (v + 1)))
        step = walk([c_pair, c_triple], states, word, strength)
        out = [np.add.reduceat(x, first) for x in ((c_word > 0).astype(np.int64), word, step)]
        columns = [ids, trained, pa.array(lengths), pa.array(out[0]), pa.array(np.full(len(ids), n)), pa.array(out[1]), pa.array(out[2]), copies]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    schema = T.StructType(
        [T.StructField("id", rows.schema["id"].dataType), T.StructField("trained", T.BooleanType())]
        + [T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")]
        + [T.StructField(x, T.DoubleType()) for x in ("base_score", "score")]
        + [T.StructField("copies", T.LongType())]
    )
    scored = BlockCounts(make, use, 3).run(blocks, ranges, schema)
    if listed:
        scored = scored.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy")
    return scored.drop("copies").withColumnRenamed("id", id_col)
