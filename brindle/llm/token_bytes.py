"""Texts to token ids with the tokenizers library, with a cache of what recurs.

Byte-level BPE first cuts a text by a pattern and then merges within each cut,
so a word's ids do not depend on its neighbours. A text is therefore cut at
single spaces, which that pattern never crosses, and before closing
punctuation; each chunk's ids come from a bounded cache, and the tokenizers
library only sees what is new. New words go to its BPE model many at a time. A text in which a space touches other white
space, or that holds the string of an added token, goes to the whole tokenizer as it is; so do all texts if the
file is of another kind of tokenizer.
"""

from __future__ import annotations

import json
import re
from itertools import chain, islice
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._common import trim_memory

END_ID = b"\0\0\0\0"
#: About 50 MB of a worker's memory; 1,000,000 take about 100 MB more and save up to a tenth of the time.
MAX_CHUNKS = 400_000
GROUP_BYTES = 4_000_000
WORDS_AT_ONCE = 20_000
#: Characters that Python, unlike the pattern, holds for white space.
SEPARATORS = re.compile("[\x1c-\x1f]").search
LETTER, MARK = 1, 2
KINDS = np.zeros(256, np.uint8)
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KINDS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = MARK

_encoders: dict[tuple[str, bool], "TokenBytes"] = {}


def encoder(path: str | None = None, max_chunks: int = MAX_CHUNKS, group_bytes: int = GROUP_BYTES, specials_as_text: bool = False) -> "TokenBytes":
    """The worker process's encoder for the tokenizer file at ``path``, with bounds of its cache and of the texts at hand at once.

    Strings of special tokens in a text become those tokens, as the library has
    it; with ``specials_as_text`` they are text like any other.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    key = (path, specials_as_text)
    if key not in _encoders:
        _encoders[key] = TokenBytes(path, specials_as_text)
    _encoders[key].max_chunks, _encoders[key].group_bytes = max_chunks, group_bytes
    return _encoders[key]


def forget() -> bool:
    """Drops all encoders of this process; whether there was one."""
    held = bool(_encoders)
    _encoders.clear()
    return held


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a letter: printable ones as they are, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


def cuts_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer file is what the shortcut assumes: byte-level BPE that cuts by the public pattern and changes no text before."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    return (
        not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
        and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) == ("ByteLevel", False, True)
        and model["type"] == "BPE"
        and not any(model.get(k) for k in odd)
        and set(byte_letters().values()) <= set(model["vocab"])
    )


class TokenBytes:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    max_chunks = MAX_CHUNKS
    group_bytes = GROUP_BYTES

    def __init__(self, path: str, specials_as_text: bool = False):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = specials_as_text
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._added = [t["content"] for t in spec.get("added_tokens", ()) if not (specials_as_text and t["special"])]
        self._shortcut = cuts_at_spaces(spec)
        if not self._shortcut:
            return
        self._cut = regex.compile(public_tokenizers.PATTERN).findall
        #: The same merges for words that are cut already and written as byte letters.
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._letters = byte_letters()
        self._line = self._letters[10]
        self._line_id = model["vocab"][self._line]
        self._words = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0))
        self._words.pre_tokenizer = pre_tokenizers.Split(self._line, "isolated")
        #: Ids of chunks with a space before them and without one.
        self._spaced: dict[str, bytes] = {}
        self._glued: dict[str, bytes] = {}

    def encode_all(self, texts: pa.Array | list[str | None]):
        """Yields the ids of each text, without an end id; a null text has none."""
        array = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        sizes = np.cumsum(pc.binary_length(array).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first, done = 0, 0
        while first < len(array):
            stop = max(first + 1, int(np.searchsorted(sizes, done + self.group_bytes, "right")))
            yield from self._encode_group(array.slice(first, stop - first).fill_null(""))
            first, done = stop, int(sizes[stop - 1])

    def _encode_group(self, texts: pa.Array):
        """Arrow cuts the texts, numbers their distinct chunks and lines up the ids; only distinct chunks become Python strings."""
        if not self._shortcut:
            for text in texts:
                yield self._ids(text.as_py())
            return
        parts = pc.split_pattern(texts, " ")
        chunks, bounds, glued = cut_tails(parts.flatten(), parts.offsets.to_numpy())
        if len(self._spaced) + len(self._glued) > self.max_chunks:
            # What came first recurs most: the older half stays.
            self._spaced, self._glued = (dict(islice(d.items(), len(d) // 2)) for d in (self._spaced, self._glued))
            trim_memory()
        number = np.empty(len(chunks), np.int64)
        found: list[bytes | None] = []
        for known, space, mine in ((self._spaced, " ", ~glued), (self._glued, "", glued)):
            coded = chunks.filter(pa.array(mine)).dictionary_encode()
            number[mine] = coded.indices.to_numpy() + len(found)
            found += self._look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), known, space)
        unknown = [k for k, ids in enumerate(found) if ids is None]
        for k in unknown:
            found[k] = b""
        ends = np.zeros(len(found) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)), out=ends[1:])
        values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(found))])
        ids = values.take(pa.array(number))
        data = memoryview(ids.buffers()[2] or b"")
        at = np.frombuffer(ids.buffers()[1], np.int64)[bounds].tolist()
        whole = np.zeros(len(texts), bool)
        if unknown:
            whole = np.add.reduceat(np.isin(number, unknown), bounds[:-1], dtype=np.int64) > 0
        for token in self._added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        for k, alone in enumerate(whole.tolist()):
            yield self._ids(texts[k].as_py()) if alone else bytes(data[at[k] : at[k + 1]])

    def _look_up(self, chunks: list[str], known: dict[str, bytes], space: str) -> list[bytes | None]:
        """The ids of chunks with ``space`` before them; None for those that are no unit of their own."""
        found = list(map(known.get, chunks))
        new = [k for k, ids in enumerate(found) if ids is None]
        if new:
            self._learn([chunks[k] for k in new], known, space)
            for k in new:
                found[k] = known.get(chunks[k])
        return found

    def _learn(self, chunks: list[str], known: dict[str, bytes], space: str) -> None:
        """Adds the ids of new chunks; those that are no unit of their own stay unknown."""
        self._learn_words([c for c in chunks if c.isalpha()], known, space)
        cuts: dict[str, list[str]] = {}
        for chunk in chunks:
            if chunk.isalpha():
                continue
            if not chunk and not space:
                known[chunk] = b""
            elif chunk == "\n" and not space:
                known[chunk] = pack("<I", self._line_id)
            elif chunk and not chunk[-1].isspace() and not (space and chunk[0].isspace()) and not SEPARATORS(chunk):
                cuts[chunk] = self._cut(space + chunk)
        pieces = list(set(chain.from_iterable(cuts.values())))
        coded = self._tokenizer.encode_batch_fast(pieces, add_special_tokens=False) if pieces else []
        get = {p: pack(f"<{len(ids := e.ids)}I", *ids) for p, e in zip(pieces, coded, strict=True)}.__getitem__
        known.update((chunk, b"".join(map(get, cut))) for chunk, cut in cuts.items())

    def _ids(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_words(self, words: list[str], known: dict[str, bytes], space: str) -> None:
        """Words of letters only; a line end between words shows where they end."""
        for first in range(0, len(words), WORDS_AT_ONCE):
            part = words[first : first + WORDS_AT_ONCE]
            written = space + f"\n{space}".join(part)
            text = written.encode("utf-8").decode("latin-1").translate(self._letters)
            ids = np.array(self._words.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self._line_id)
            data = ids.tobytes()
            starts = [0, *((ends + 1) * 4).tolist()]
            stops = [*(ends * 4).tolist(), len(data)]
            known.update(zip(part, map(lambda a, b: data[a:b], starts, stops), strict=True))


def cut_tails(chunks: pa.StringArray, bounds: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Cuts chunks at single line ends and closing punctuation off what is left: ``a.\\nb,`` becomes ``a``, ``.``, ``\\n``, ``b`` and ``,``.

    ``bounds`` are the texts' first chunks and the end. Gives the chunks, their
    bounds, and which of them have no space before them: all but the first part
    of a chunk, and the first chunks of texts. The pattern always cuts between a
    letter and punctuation other than an apostrophe, and a line end between two
    characters that are no white space is always alone.
    """
    bounds = bounds.astype(np.int64)
    buffers = chunks.buffers()
    ends = np.frombuffer(buffers[1], np.int32)[: len(chunks) + 1]
    data = np.frombuffer(buffers[2] or b"", np.uint8)[: ends[-1]]
    kind = KINDS[data]
    # U+00C0 to U+00FF are letters but for the signs of multiplication and division.
    latin = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    kind[1:][latin] = LETTER
    ahead = np.append(KINDS[data[1:]] > 0, False)  # what follows is surely no white space
    ahead[:-2] |= latin[1:]
    lines = np.flatnonzero(data == 10)
    lines = lines[(lines > 0) & (lines + 1 < len(data))]
    lines = lines[(kind[lines - 1] > 0) & ahead[lines]]
    chunk = np.searchsorted(ends, lines, "right") - 1
    lines = lines[(lines > ends[chunk]) & (lines + 1 < ends[chunk + 1])]
    places = np.insert(lines + 1, np.arange(len(lines)), lines)
    chunk = np.searchsorted(ends, places, "right") - 1
    stops = np.insert(ends, chunk + 1, places)
    tails = np.flatnonzero((kind[:-1] == LETTER) & (kind[1:] == MARK)) + 1
    part = np.searchsorted(stops, tails, "right") - 1
    others = np.append(np.flatnonzero(kind != MARK), len(data))
    tails = tails[(tails > stops[part]) & (others[np.searchsorted(others, tails)] >= stops[part + 1])]
    # Parts never start where a chunk does, and empty chunks stay as they are.
    places = np.sort(np.concatenate([places, tails]))
    chunk = np.searchsorted(ends, places, "right") - 1
    cut = pa.StringArray.from_buffers(len(chunks) + len(places), pa.py_buffer(np.insert(ends, chunk + 1, places.astype(np.int32))), buffers[2])
    bounds = bounds + np.searchsorted(chunk, bounds)
    glued = np.zeros(len(cut), bool)
    glued[chunk + 1 + np.arange(len(places))] = True
    glued[bounds[:-1]] = True
    return cut, bounds, glued
