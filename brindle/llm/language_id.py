"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities, one row for each of ``FEATURES``
hashed n-grams and one column for each language. It is fitted on a bounded
sample of labelled rows (``max_train_rows``, chosen by a hash of the row), so
its size has a bound, and it is broadcast. Batches are scored in numpy on
sparse features: the rows of the n-grams that occur, summed up per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import drop_encoders, trim_memory, with_fields

FEATURES = 1 << 15
MAX_TRAIN_ROWS = 6000
#: Rows of the matrix times languages, at most (64 MB of 32-bit floats).
MAX_CELLS = 1 << 24
UNKNOWN = "und"
CHUNK_CHARS = 1 << 20
#: Numbers that a text's n-grams may gather from the matrix at once (16 MB).
GATHER_CELLS = 1 << 22

_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code point to its lower-case letter, or to a space if it is no letter."""
    global _fold
    if _fold is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold = table
    return _fold


def letters(text: str) -> np.ndarray:
    """Folded code points; whatever is no letter is a space."""
    return fold_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


def ngram_features(codes: np.ndarray) -> np.ndarray:
    """Hashed 2- and 3-grams that end at each place after the first two; ``FEATURES`` for those without a letter."""
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    two = b * np.uint32(0x9E3779B1) + c * np.uint32(0x85EBCA6B)
    three = two + a * np.uint32(0xC2B2AE35) + np.uint32(0x27D4EB2F)
    out = np.empty((2, len(a)), np.int32)
    for k, (h, blank) in enumerate(((two, (b == 32) & (c == 32)), (three, (a == 32) & (b == 32) & (c == 32)))):
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out[k] = h >> np.uint32(17)
        out[k][blank] = FEATURES
    return out


@dataclass(frozen=True)
class LanguageModel:
    """``langs`` in ascending order; ``weights`` has a last row of zeros for n-grams without letters."""

    langs: tuple[str, ...]
    weights: np.ndarray
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The most probable language of each text (on a tie the first by name) and its posterior probability; ``und`` and 0 for null texts and texts without a letter."""
        langs = [UNKNOWN] * len(texts)
        scores = [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        for k, text in enumerate(texts):
            if not text:
                continue
            total, seen = self.prior.astype(np.float64).copy(), False
            for at in range(0, len(text), CHUNK_CHARS):
                # Two characters of overlap: every n-gram of the text is counted once.
                codes = letters(text[max(0, at - 2) : at + CHUNK_CHARS])
                seen = seen or bool((codes != 32).any())
                if at == 0:
                    codes = np.concatenate([np.full(2, 32, np.uint32), codes])
                found = ngram_features(codes).ravel()
                step = max(1, GATHER_CELLS // len(self.langs))
                for k0 in range(0, len(found), step):
                    total += self.weights[found[k0 : k0 + step]].sum(axis=0, dtype=np.float64)
            if seen:
                best = int(total.argmax())
                langs[k] = self.langs[best]
                scores[k] = float(1 / np.exp(total - total[best]).sum())
        return langs, scores


def fit(
    df: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    max_train_rows: int = MAX_TRAIN_ROWS,
    smoothing: float = 0.5,
) -> LanguageModel:
    """Fits a model on the rows of ``df`` with a text and a language.

    A sample of about ``max_train_rows`` rows at most is used, those whose text
    has the least hash values, so that it is the same for every run; rows equal
    in text and language count once in it, so one that recurs brings no more. No
    usable row gives a model without languages, which predicts ``und`` for all.
    More than ``MAX_CELLS / FEATURES`` languages (511) raise ``ValueError``.
    """
    usable = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    n = usable.count()
    sample = usable.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    if n > max_train_rows:
        limit = int(-(1 << 63) + (1 << 64) * (max_train_rows / n))
        sample = sample.where(F.xxhash64(F.lit(5), "text") < limit).dropDuplicates(["lang", "text"])
    most = MAX_CELLS // (FEATURES + 1)
    if len(sample.select("lang").distinct().limit(most + 1).collect()) > most:
        raise ValueError(f"more than {most} languages do not fit the model's bound")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows[lang] = rows.get(lang, 0) + 1
                table = sums.setdefault(lang, np.zeros(FEATURES + 1, np.int64))
                for at in range(0, len(text), CHUNK_CHARS):
                    codes = letters(text[max(0, at - 2) : at + CHUNK_CHARS])
                    if at == 0:
                        codes = np.concatenate([np.full(2, 32, np.uint32), codes])
                    table += np.bincount(ngram_features(codes).ravel(), minlength=FEATURES + 1)
        for lang in sums:
            at = np.flatnonzero(sums[lang][:FEATURES])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(sums[lang][at]), pa.array([rows[lang] if i == 0 else 0 for i in range(len(at))], pa.int64())],
                names=["lang", "feature", "k", "docs"],
            )

    counts = sample.mapInArrow(count, "lang string, feature int, k long, docs long")
    counts = counts.groupBy("lang", "feature").agg(F.sum("k").alias("k"), F.sum("docs").alias("docs")).toArrow()
    names = counts["lang"].to_pylist()
    langs = tuple(sorted(set(names)))
    where = {lang: k for k, lang in enumerate(langs)}
    table, docs = np.zeros((FEATURES + 1, max(1, len(langs)))), np.zeros(max(1, len(langs)))
    if langs:
        column = np.array([where[x] for x in names])
        table[counts["feature"].to_numpy(), column] = counts["k"].to_numpy()
        np.add.at(docs, column, counts["docs"].to_numpy())
        table[:FEATURES] += smoothing
        table[:FEATURES] = np.log(table[:FEATURES] / table[:FEATURES].sum(axis=0))
    prior = np.log(np.maximum(docs, 1) / max(1.0, docs.sum()))
    return LanguageModel(langs, table.astype(np.float32), prior.astype(np.float32))


def identify(df: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` behind its columns.

    The text alone decides. Null texts and texts without a letter get ``und``
    and score 0. Same-named columns of ``df`` give way to the new ones. Rows
    stay as they are, repeated ones too; an empty table stays empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = with_fields(df, fields)
    # The text goes first under a name of its own: it may be one of the columns that give way.
    kept = [df[f.name] for f in schema.fields[:-2]]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)
        trim_memory()

    return df.select(df[text_col].alias("__text"), *kept).mapInArrow(predict, schema)
