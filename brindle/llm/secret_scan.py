"""Secrets in texts, found by regular expressions behind a trigram index.

For each batch of texts an inverted index of trigrams is built: for every
trigram that a rule asks for, the texts that hold it. Each rule's regular
expression is turned into a Boolean query over trigrams that every match must
contain (runs of literals are conjunctions, alternatives are disjunctions); the
query is answered by intersecting and uniting postings, and only the texts
found are given to the expression itself. Rules without mandatory trigrams scan
all texts.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as K  # noqa: PLC2701
import re._parser as parser  # noqa: PLC2701
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import drop_encoders, trim_memory, with_fields

#: ("and" | "or", parts) or a trigram of lower-case bytes; None asks for nothing.
Query = tuple | bytes | None


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` is the least length of ``group``; shorter matches are dropped."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 1
    base: bool = False

    @property
    def flags(self) -> int:
        return re.ASCII | (re.IGNORECASE if self.any_case else 0)


#: The base rules (the least length of the last two stands in their
#: patterns: a run is taken whole, so no other match is lost by it), then further kinds of well-known shapes.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", False, 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", False, 0, 32, True),
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


def _both(op: str, parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else (op, tuple(parts))


def trigram_query(pattern: str, flags: int = re.ASCII) -> Query:
    """The trigrams that every match of a pattern contains, as a Boolean query; letters in lower case."""

    def run(text: bytes) -> list[Query]:
        return [text[i : i + 3] for i in range(len(text) - 2)]

    def walk(nodes) -> Query:
        parts: list[Query] = []
        literal = b""
        for op, arg in nodes:
            if op is K.LITERAL:
                literal += chr(arg).lower().encode()
                continue
            parts += run(literal)
            literal = b""
            if op is K.SUBPATTERN:
                parts.append(walk(arg[3]))
            elif op is K.BRANCH:
                branches = [walk(x) for x in arg[1]]
                if all(x is not None for x in branches):
                    parts.append(_both("or", branches))
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and arg[0] > 0:
                parts.append(walk(arg[2]))
        return _both("and", parts + run(literal))

    return walk(parser.parse(pattern, flags))




def _asked(query: Query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(_asked, query[1]))


def _answer(query: Query, postings: dict[bytes, np.ndarray]) -> np.ndarray:
    if isinstance(query, bytes):
        return postings[query]
    op, parts = query
    out = _answer(parts[0], postings)
    for part in parts[1:]:
        more = _answer(part, postings)
        out = np.intersect1d(out, more, assume_unique=True) if op == "and" else np.union1d(out, more)
    return out


class SecretScanner:
    """Compiled rules with their trigram queries."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self._find = [re.compile(r.pattern, r.flags).finditer for r in rules]
        self.queries = [trigram_query(r.pattern, r.flags) for r in rules]
        grams = sorted(set().union(*map(_asked, self.queries)))
        self._grams = {g: k + 1 for k, g in enumerate(grams)}
        if len(grams) > 60_000:
            raise ValueError("too many trigrams for one index")
        self._number = np.zeros(1 << 24, np.uint16)
        for g, k in self._grams.items():
            self._number[g[0] | g[1] << 8 | g[2] << 16] = k
        self._lower = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

    def postings(self, data: bytes, starts: np.ndarray) -> dict[bytes, np.ndarray]:
        """For each trigram asked for, the ascending numbers of the texts that hold it; text k starts at ``starts[k]``."""
        low = self._lower[np.frombuffer(data, np.uint8)].astype(np.uint32)
        codes = low[:-2] | low[1:-1] << np.uint32(8) | low[2:] << np.uint32(16)
        numbers = self._number[codes]
        at = np.flatnonzero(numbers)
        texts, found = np.searchsorted(starts, at, "right") - 1, numbers[at]
        pairs = np.unique(found.astype(np.int64) << 40 | texts)
        cuts = np.searchsorted(pairs, np.arange(1, len(self._grams) + 2, dtype=np.int64) << 40)
        return {g: pairs[cuts[k - 1] : cuts[k]] & ((1 << 40) - 1) for g, k in self._grams.items()}

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of each text's secrets in that order; offsets count code points, ends are exclusive."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        coded = [(x or "").encode("utf-8", "replace") for x in texts]
        starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in coded])[:-1]]) if coded else np.zeros(0, np.int64)
        index = self.postings(b"\0".join(coded) + b"\0\0\0", starts)
        for k, (rule, find, query) in enumerate(zip(self.rules, self._find, self.queries, strict=True)):
            for i in range(len(texts)) if query is None else _answer(query, index).tolist():
                if texts[i]:
                    for m in find(texts[i]):
                        a, b = m.span(rule.group)
                        if b - a >= rule.least:
                            out[i].append((m.start(), k, m.end()))
        for spans in out:
            spans.sort()
        return out


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> SecretScanner:
    """One scanner for each worker process."""
    return SecretScanner(rules)


BATCH_CHARS = 2_000_000


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    first, chars = 0, 0
    for i, text in enumerate(texts):
        chars += len(text or "")
        if chars > BATCH_CHARS:
            yield first, i + 1
            first, chars = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def scan_secrets(df: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with the secrets of each text behind its columns.

    New columns: ``secrets``, an array of (``kind``, ``start``, ``end``) by start
    and then in the order of the rules, with offsets in code points; ``counts``,
    the number of secrets of each kind by rule; and ``base_sha256``, the SHA-256
    of the base rules' spans as ``kind:start:end`` joined by commas. Null and
    empty texts have no secrets. Same-named columns of ``df`` give way; rows
    stay as they are.
    """
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    fields = [T.StructField("secrets", T.ArrayType(span)), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("base_sha256", T.StringType())]
    schema = with_fields(df, fields)
    kept = [df[f.name] for f in schema.fields[:-3]]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        scan = scanner(rules)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            spans: list = []
            for a, b in _groups(texts):
                spans += scan.scan(texts[a:b])
            base = [",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in x if rules[k].base) for x in spans]
            columns = [
                pa.array([[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in spans], kind),
                pa.array([np.bincount([k for _, k, _ in x], minlength=len(rules)) if x else np.zeros(len(rules), np.int64) for x in spans], pa.list_(pa.int64())),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=schema.names)
        trim_memory()

    return df.select(df[text_col].alias("__text"), *kept).mapInArrow(find, schema)


def redact_secrets(df: DataFrame, *, text_col: str = "text", mark: str = "[REDACTED]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with every secret in the text replaced by ``mark`` (overlapping ones by one); all other columns and null texts stay."""
    at = df.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        scan = scanner(rules)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in _groups(texts):
                for i, spans in enumerate(scan.scan(texts[a:b]), a):
                    if spans:
                        parts, done = [], 0
                        for start, _, end in spans:
                            if start >= done:
                                parts += [texts[i][done:start], mark]
                            done = max(done, end)
                        texts[i] = "".join(parts) + texts[i][done:]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
        trim_memory()

    return df.mapInArrow(clean, df.schema)
