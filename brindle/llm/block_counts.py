"""Corpus-wide counts of hashed items, brought back to where the items occur.

Items (words, n-grams, shingles) are too many for a table that every task could
hold, and joining every occurrence with its count would move the corpus many
times over. So documents are dealt to blocks of a bounded size, and

1. each block sends its distinct items once, as packed steps between ascending
   hashes with their counts in the block, to the owner of their hash range: a hot
   item is one entry a block, however often it occurs;
2. each owner adds up the counts of its items and answers every block with the
   totals alone, in the order of the question;
3. each block, which knows its own items, puts the totals beside them.

A function turns a block's documents into items. It is called twice on the same
rows, so nothing but blocks, hashes and totals is ever moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drop_encoders, partitions, trim_memory

#: UTF-8 bytes of text in a block, about.
BLOCK_BYTES = 6_000_000
#: Bytes of text for each hash range, about, so that ranges grow in number with the corpus and not in size.
RANGE_BYTES = 32 << 20
#: Bits of a hash that are sent beyond those that tell the ranges apart.
HASH_BITS = 42

#: A block's distinct items: ascending hashes, and for each its count in the block.
Items = tuple[np.ndarray, np.ndarray]


def blocked(df: DataFrame, text_col: str, salt: Column, block_bytes: int | None = None) -> tuple[DataFrame, int]:
    """``df`` with a column ``block``, dealt to the blocks by a hash of ``salt``, and the number of hash ranges for so much text.

    Rows of a block are in one partition.
    """
    total = df.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    parts = partitions(df)
    blocks = max(1, -(-total // (block_bytes or BLOCK_BYTES)))
    if blocks > 1:
        blocks = -(-blocks // parts) * parts if blocks > parts else blocks
    out = df.withColumn("block", F.pmod(salt, F.lit(blocks)).cast("int"))
    return out.repartition(int(max(parts, min(blocks, 4 * parts))), "block"), int(max(parts, -(-total // RANGE_BYTES)))


def pack_hashes(hashes: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_hashes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel()


def pack_steps(values: np.ndarray) -> bytes:
    """Ascending integers by their steps: bytes of one weight side by side, so that the high ones, nearly all alike, compress."""
    steps = np.diff(values, prepend=np.uint64(0))
    width = 4 if not len(steps) or int(steps[1:].max(initial=0)) < 1 << 32 and int(steps[0]) < 1 << 32 else 8
    planes = np.ascontiguousarray(steps.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_steps(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(f"<u{data[0]}").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in the narrowest unsigned type that holds them, compressed."""
    width = next(w for w in (1, 2, 4, 8) if not len(counts) or int(counts.max()) < 1 << (8 * w))
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(counts.astype(f"<u{width}").tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


def cuts_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where each hash range begins in ascending hashes: ``ranges`` + 1 places."""
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


@dataclass(frozen=True)
class BlockCounts:
    """``make(columns)`` turns a block's rows into items, ``use`` turns items and their totals into result rows.

    ``columns`` are Arrow arrays of the block's rows (without ``block``). ``make``
    returns the ``kinds`` kinds of items, an ``Items`` pair each, and whatever
    ``use`` needs of that work. ``use(work, kinds, totals, corpus)`` gets for each kind the totals of
    its hashes and, for the corpus, the sum of all counts and the number of
    distinct hashes whose total is not zero.
    """

    make: Callable[[list[pa.Array]], tuple[list[Items], object]]
    use: Callable[[object, list[Items], list[np.ndarray], list[tuple[int, int]]], pa.RecordBatch]
    kinds: int

    def run(self, blocks: DataFrame, ranges: int, schema) -> DataFrame:
        """``blocks`` and ``ranges`` come from ``blocked``; the result has the columns of ``schema``."""
        make, use, n_kinds = self.make, self.use, self.kinds
        # What is left of a hash tells items apart as well in a range of a large corpus as in one of a small.
        shift = np.uint64(max(0, 64 - HASH_BITS - (ranges - 1).bit_length()))
        columns = [c for c in blocks.columns if c != "block"]

        def of(table: pa.Table) -> list[pa.Array]:
            return [table.column(c).combine_chunks() for c in columns]

        def ask(table: pa.Table) -> pa.Table:
            drop_encoders()
            block = table.column("block")[0].as_py()
            kinds, _ = make(of(table))
            cut = [cuts_of(h, ranges) for h, _ in kinds]
            out = []
            for k in range(ranges):
                part = [(h[c[k] : c[k + 1]], n[c[k] : c[k + 1]]) for (h, n), c in zip(kinds, cut, strict=True)]
                low = np.uint64((k << 64) // ranges) >> shift
                out.append((k, block, [pack_steps((h >> shift) - low) for h, _ in part], [pack_counts(n) for _, n in part]))
            del kinds
            trim_memory()
            rows = list(zip(*out, strict=True))
            types = [pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary())]
            return pa.table([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names=["hash_range", "block", "hashes", "counts"])

        def answer(table: pa.Table) -> pa.Table:
            block, hashes, counts = (table.column(c).to_pylist() for c in ("block", "hashes", "counts"))
            replies: list[list[bytes]] = [[] for _ in block]
            for kind in range(n_kinds):
                asked = [unpack_steps(h[kind]) for h in hashes]
                values, where = np.unique(np.concatenate(asked), return_inverse=True)
                own = np.concatenate([unpack_counts(c[kind]) for c in counts])
                sums = np.bincount(where, weights=own, minlength=len(values)).astype(np.int64)
                total, corpus, at = sums[where], np.array([sums.sum(), np.count_nonzero(sums)]).tobytes(), 0
                for reply, h in zip(replies, asked, strict=True):
                    reply += [pack_counts(total[at : at + len(h)]), corpus]
                    at += len(h)
            trim_memory()
            return pa.table([table.column("block").combine_chunks(), table.column("hash_range").combine_chunks(), pa.array(replies, pa.list_(pa.binary()))], names=["block", "hash_range", "totals"])

        def settle(rows: pa.Table, replies: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return empty
            kinds, work = make(of(rows))
            order = np.argsort(replies.column("hash_range").to_numpy())  # every range answers every block
            got = replies.column("totals").to_pylist()
            totals = [np.concatenate([unpack_counts(got[i][2 * k]) for i in order]) for k in range(n_kinds)]
            corpus = [tuple(sum(np.frombuffer(g[2 * k + 1], np.int64) for g in got).tolist()) for k in range(n_kinds)]
            out = pa.Table.from_batches([use(work, kinds, totals, corpus)])
            del kinds, work, totals
            trim_memory()
            return out

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        parsed = _parse_datatype_string(schema) if isinstance(schema, str) else schema
        empty = to_arrow_schema(parsed).empty_table()
        asked = blocks.groupBy("block").applyInArrow(ask, "hash_range int, block int, hashes array<binary>, counts array<binary>")
        replies = asked.groupBy("hash_range").applyInArrow(answer, "block int, hash_range int, totals array<binary>")
        return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(settle, parsed)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts with a line end behind each, and where each text ends (its line end's place); nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    size = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[size[0] : size[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    ends = size[1:] - size[0]
    return np.insert(data, ends, np.uint8(10)) if len(ends) else data, ends + np.arange(len(ends))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


# Fixed seed: all tasks must agree.
_random = np.random.Generator(np.random.PCG64(20))
#: A random number for each byte, and an odd base with its inverse modulo 2^64.
BYTE_VALUES = _random.integers(0, 1 << 64, 256, np.uint64)
BASE = int(_random.integers(0, 1 << 64, dtype=np.uint64)) | 1
INVERSE = pow(BASE, -1, 1 << 64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a polynomial of random byte values, by differences of running sums."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    step = 1 << 20  # powers and sums restart with each stretch of whole spans, to bound memory
    first = 0
    while first < len(starts):
        lo = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, lo + step, "right")))
        hi = int(ends[last - 1])
        power = np.full(hi - lo + 1, BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data[lo:hi]] * power[:-1], out=sums[1:])
        back = np.full(hi - lo + 1, INVERSE, np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        a, b = starts[first:last] - lo, ends[first:last] - lo
        out[first:last] = (sums[b] - sums[a]) * back[a]
        first = last
    return mix(out)
