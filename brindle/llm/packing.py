"""Hierarchical multi-length packing of documents into token sequences.

Documents become token ids with an end id, are routed to tiers of context
sizes (256, 512 and 1024 tokens by default), and each tier is packed into
windows of its size. Gaps that remain in the longer windows are filled from the
shorter tiers, largest fitting piece first; what still remains of a gap is
filled by cutting a shorter piece. Sequences are then dealt to step groups of
nearly equal token counts.

Every task packs what it reads: nothing is shuffled and no key matters, so a
hot source costs nothing. A task holds ``FLUSH_WINDOWS`` windows of tokens at most.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .token_bytes import END_ID, GROUP_BYTES, MAX_CHUNKS, encoder

TIERS = (256, 512, 1024)
STEP_TOKENS = 64 * 1024
FLUSH_WINDOWS = 512
EMIT_BYTES = 4_000_000

#: A piece: document number within the task, first token, token count, the ids.
Piece = tuple[int, int, int, bytes]


class TierPacker:
    """Packs pieces of at most one window; ``windows`` hands back full windows."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers))
        self._shelf: list[list[Piece]] = [[] for _ in range(self.tiers[-1] + 1)]
        self._mask = 0  # bit n: the shelf of length n has pieces
        self.tokens = 0

    def add(self, piece: Piece) -> None:
        self._shelf[piece[2]].append(piece)
        self._mask |= 1 << piece[2]
        self.tokens += piece[2]

    def _take(self, length: int) -> Piece:
        piece = self._shelf[length].pop()
        if not self._shelf[length]:
            self._mask &= ~(1 << length)
        self.tokens -= length
        return piece

    def _largest(self, low: int, high: int) -> int:
        """The largest length on the shelf in [low, high], or 0."""
        if high < low:
            return 0
        found = (self._mask & ((1 << (high + 1)) - 1)) >> low
        return found.bit_length() - 1 + low if found else 0

    def _fill(self, window: list[Piece], gap: int, below: int) -> int:
        """Fills a gap with whole pieces of the shorter tiers, then with a cut one; returns what is left of it."""
        while gap and (n := self._largest(1, min(gap, below))):
            window.append(self._take(n))
            gap -= n
        if gap and (n := self._largest(gap + 1, below)):
            doc, start, length, ids = self._take(n)
            window.append((doc, start, gap, ids[: 4 * gap]))
            self.add((doc, start + gap, length - gap, ids[4 * gap :]))
            gap = 0
        return gap

    def windows(self) -> Iterator[tuple[int, list[Piece]]]:
        """Full windows, longest tier first. Pieces that fill none stay for later."""
        for k in range(len(self.tiers) - 1, -1, -1):
            size, low = self.tiers[k], self.tiers[k - 1] + 1 if k else 1
            while n := self._largest(low, size):
                window = [self._take(n)]
                gap = self._fill(window, size - n, size)
                if gap:
                    for piece in window:
                        self.add(piece)
                    break
                yield size, window

    def rest(self) -> Iterator[tuple[int, list[Piece]]]:
        """All that is left, in windows whose sizes are powers of two: no padding."""
        left: list[Piece] = []
        while n := self._largest(1, self.tiers[-1]):
            left.append(self._take(n))
        total = sum(piece[2] for piece in left)
        left.reverse()
        while total:
            size = min(self.tiers[-1], 1 << (total.bit_length() - 1))
            window, gap = [], size
            while gap:
                doc, start, length, ids = left.pop()
                if length > gap:
                    left.append((doc, start + gap, length - gap, ids[4 * gap :]))
                    length, ids = gap, ids[: 4 * gap]
                window.append((doc, start, length, ids))
                gap -= length
            total -= size
            yield size, window


def deal_steps(windows: list[tuple[int, list[Piece]]], step_tokens: int) -> list[int]:
    """A step for each window: the emptiest step gets the next longest window, so that steps differ by one window at most."""
    total = sum(size for size, _ in windows)
    steps = [(0, k) for k in range(max(1, -(-total // step_tokens)))]
    out = [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: -windows[i][0]):
        load, k = heapq.heappop(steps)
        out[i] = k
        heapq.heappush(steps, (load + windows[i][0], k))
    return out


def pack_documents(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    tokenizer_path: str | None = None,
    max_chunks: int = MAX_CHUNKS,
    group_bytes: int = GROUP_BYTES,
    specials_as_text: bool = False,
) -> DataFrame:
    """Packs all documents of ``df``; one row for each piece of a document.

    Columns: the id column, ``start`` (ids of the document before the piece),
    ``length``, ``token_bytes`` (the piece's ids, little-endian unsigned 32-bit),
    ``doc_tokens`` (with the end id), ``sequence_id``, ``offset`` (in the
    sequence), ``window`` (the sequence's size, a power of two by default) and
    ``step_id``. Sequences are full, so there is no padding.

    A null or empty text is its end id alone. Repeated rows and repeated or
    null ids are packed row by row. An empty table gives no rows. Other columns
    of ``df`` are not read, whatever their names. ``max_chunks`` and
    ``group_bytes`` trade a worker's memory for time; the result is the same.
    Strings of special tokens become those tokens unless ``specials_as_text``.
    """
    if sorted(tiers) != sorted({1 << (t.bit_length() - 1) for t in tiers if t > 0}):
        raise ValueError("tiers must be distinct powers of two")
    source = df.select(df[id_col], df[text_col])
    id_field = T.StructField(id_col, source.schema[0].dataType, True)
    long = lambda name: T.StructField(name, T.LongType())
    schema = T.StructType(
        [id_field, long("start"), long("length"), T.StructField("token_bytes", T.BinaryType()), long("doc_tokens")]
        + [long("sequence_id"), long("offset"), long("window"), long("step_id")]
    )
    top = max(tiers)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, max_chunks, group_bytes, specials_as_text).encode_all
        task = TaskContext.get().partitionId() << 36
        packer = TierPacker(tiers)
        docs: dict[int, list] = {}  # number: id, tokens, tokens still to place
        out: list[tuple] = []
        state = {"doc": 0, "sequence": 0, "step": 0, "bytes": 0}
        id_type = None

        def place(windows: list[tuple[int, list[Piece]]]) -> None:
            steps = deal_steps(windows, step_tokens)
            for (size, pieces), step in zip(windows, steps, strict=True):
                offset = 0
                for doc, start, length, ids in pieces:
                    entry = docs[doc]
                    out.append((entry[0], start, length, ids, entry[1], task + state["sequence"], offset, size, task + state["step"] + step))
                    offset += length
                    entry[2] -= length
                    if not entry[2]:
                        del docs[doc]
                    state["bytes"] += len(ids) + 80
                state["sequence"] += 1
            state["step"] += max(steps, default=-1) + 1

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)
            out.clear()
            state["bytes"] = 0
            return got

        full: list[tuple[int, list[Piece]]] = []
        for batch in batches:
            id_type = batch.column(0).type
            for key, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids += END_ID
                tokens = len(ids) // 4
                number = state["doc"] = state["doc"] + 1
                docs[number] = [key, tokens, tokens]
                start = 0
                while tokens - start >= top:
                    full.append((top, [(number, start, top, ids[4 * start : 4 * (start + top)])]))
                    start += top
                if start < tokens:
                    packer.add((number, start, tokens - start, ids[4 * start :]))
                if packer.tokens + top * len(full) >= FLUSH_WINDOWS * top:
                    full.extend(packer.windows())
                    place(full)
                    full.clear()
                    if state["bytes"] > EMIT_BYTES:
                        yield emit()
        full.extend(packer.windows())
        full.extend(packer.rest())
        place(full)
        if out:
            yield emit()

    return source.mapInArrow(pack, schema)
