import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brindle.llm import backoff_lm, block_counts
from brindle.llm.backoff_lm import STRENGTH, score_texts

SF = "/root/testdata/sf0.001"


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


class Automaton:
    """The automaton state by state: arcs, failure arcs, one traversal. A state is a tuple of at most two words; the start is one."""

    def __init__(self, texts):
        self.words, self.arcs, self.left = Counter(), Counter(), Counter()
        for text in texts:
            state = ("",)
            for t in tokens(text):
                self.words[t] += 1
                for k in range(len(state)):
                    self.arcs[state[k:], t] += 1
                    self.left[state[k:]] += 1
                state = (*state, t)[-2:]
        self.n, self.v = sum(self.words.values()), len(self.words)

    def word(self, t):
        return math.log10((self.words[t] + 1) / (self.n + self.v + 1))

    def arc(self, state, t):
        """The weight of an arc, or of the failure arc and what comes after it."""
        if not state:
            return self.word(t)
        left, shorter = self.left[state], self.arc(state[1:], t)
        if self.arcs[state, t]:
            return math.log10((self.arcs[state, t] + STRENGTH * 10**shorter) / (left + STRENGTH))
        return math.log10(STRENGTH / (left + STRENGTH)) + shorter

    def score(self, text):
        state, total = ("",), 0.0
        for t in tokens(text):
            total += self.arc(state, t)
            state = (*state, t)[-2:]
        return total


@pytest.mark.parametrize("block_bytes", [6_000_000, 20_000])
def test_like_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(block_counts, "BLOCK_BYTES", block_bytes)
    odd = [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "ÉTÉ été A a\x0b\x1cB"), (None, "null id text"), (3, "again " * 3), (3, "again " * 3), (9005, "w " * 30_000), (9006, "x" * 50_000)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("score", F.lit("x"))
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2
    rows = docs.collect()
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    model = Automaton([r.text for r in rows if not held(r.doc_id)])
    expect = sorted((str(r.doc_id), len(t), sum(model.words[x] > 0 for x in t), round(sum(map(model.word, t)), 5), round(model.score(r.text), 5)) for r in rows for t in [tokens(r.text)])
    got = score_texts(docs, train).collect()
    assert {r.train_tokens for r in got} == {model.n}
    assert all(r.trained != held(r.doc_id) for r in got)
    mine = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5), round(r.score, 5)) for r in got)
    assert [m[:3] for m in mine] == [e[:3] for e in expect]
    assert all(abs(a - b) < 1e-4 for m, e in zip(mine, expect, strict=True) for a, b in zip(m[3:], e[3:], strict=True))


def test_weights_sum_to_one():
    model = Automaton(["a b a", "a c", "b"])
    for state in [("",), ("a",), ("b",), ("never",), ("", "a"), ("a", "b"), ("never", "a"), ()]:
        assert sum(10 ** model.arc(state, t) for t in [*model.words, "unknown"]) == pytest.approx(1)


def test_many_equal_rows_go_as_one(spark, monkeypatch):
    monkeypatch.setattr(backoff_lm, "MANY_EQUAL", 4)
    rows = [(1, "a b c a b")] * 9 + [(1, "a b")] * 3 + [(2, None)] * 5 + [(None, "c a")] * 6 + [(4, "b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = Automaton([text for _, text in rows])
    got = score_texts(docs, F.lit(True)).collect()
    mine = Counter((r.doc_id, r.n_tokens, round(r.score, 6), r.train_tokens) for r in got)
    assert mine == Counter((k, len(tokens(t)), round(model.score(t), 6), model.n) for k, t in rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert score_texts(docs.limit(0), F.lit(True)).count() == 0
    for row in score_texts(docs, F.lit(None).cast("boolean")).collect():
        assert (row.n_known, row.train_tokens, row.base_score, row.score) == (0, 0, 0.0, 0.0)
