import random
import re
from collections import Counter, defaultdict
from itertools import combinations
from math import log

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import near_text
from brindle.llm._common import Scratch
from brindle.llm.components import components
from brindle.llm.near_text import BANDS, SMOOTHING, band_keys, drop_near_duplicates, near_classes, shingle_sets

SF = "/root/testdata/sf0.001"


def sets_of(text):
    w = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows):
    texts = {}
    for k, t in sorted((r for r in rows if r[0] is not None and r[1] is not None)):
        texts.setdefault(k, t)
    distinct = sorted(set(texts.values()))
    sets = {t: sets_of(t) for t in distinct}
    total = sum(k is not None for k, _ in rows)
    df = Counter(s for x in sets.values() for s in x)
    weight = {t: {s: n * log(1 + total / (df[s] + SMOOTHING * total)) for s, n in x.items()} for t, x in sets.items()}
    having = defaultdict(set)
    for t, x in sets.items():
        for s in x:
            having[s].add(t)
    parent = {k: k for k, _ in rows if k is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    owner = {}
    for k, t in rows:
        if k is not None and t is not None:
            join(k, owner.setdefault(t, k))
    for a in distinct:
        for b in set().union(*(having[s] for s in sets[a])):
            if a < b:
                shared = sum(min(w, weight[b].get(s, 0)) for s, w in weight[a].items())
                if shared / (sum(weight[a].values()) + sum(weight[b].values()) - shared) >= 0.8:
                    join(owner[a], owner[b])
    return {k: find(k) for k in parent}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**9)}"
    return " ".join(words)


def test_like_brute_force(spark):
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    at = 10_000
    for group, (copies, edits) in enumerate([(2, 1), (3, 2), (60, 1), (40, 4), (5, 0)]):
        base = [f"g{group}w{rng.randrange(500)}" for _ in range(200)]
        for _ in range(copies):
            rows.append((at, edited(rng, base, edits)))
            at += 1
    passage = " ".join(f"common{k}" for k in range(60))
    for k in range(80):
        rows.append((at + k, passage + " " + " ".join(f"own{k}x{j}" for j in range(60))))
    chain = [f"c{j}" for j in range(100)]
    for k in range(8):  # each resembles the next, not the one after
        rows.append((20_000 + k, " ".join(chain[k * 4 :] + [f"d{j}" for j in range(k * 4)])))
    rows += [(30_000, None), (30_001, None), (30_002, ""), (30_003, ""), (30_004, "!!"), (30_005, "one two"), (30_006, "One, two"), (30_007, "x " * 40_000), (30_008, "x " * 39_000), (None, "null id"), (30_009, "null id"), (5, rows[7][1]), (6, rows[6][1])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, rep string")
    expect = brute(rows)
    got = {r.doc_id: r.class_id for r in near_classes(docs).collect()}
    assert got == expect
    assert len({expect[10_005 + k] for k in range(60)}) == 1  # the planted group is one class
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted({k for k, v in expect.items() if k == v})
    assert left.where("doc_id is null").count() == 1


def test_many_slices_of_what_is_outside(spark, monkeypatch):
    rng = random.Random(5)
    part = [[f"p{k}w{rng.randrange(500)}" for _ in range(30)] for k in range(9)]
    # Each has six of nine passages: they share buckets, but five shared passages make 0.7 only.
    rows = [(k, " ".join(w for p in some for w in part[p])) for k, some in enumerate(rng.sample(list(combinations(range(9), 6)), 60))]
    rows += [(100 + k, rows[k][1].rsplit(" ", 5)[0] + f" end{k // 2}") for k in range(0, 60, 3)]
    monkeypatch.setattr(near_text, "ASKING_BYTES", 10_000)
    monkeypatch.setattr(near_text, "ASKED_BYTES", 10_000)
    outside, linked = [], near_text._linked_outside

    def counted(buckets, labels, sets, scratch, least):
        outside.append((buckets.select("id").distinct().count(), labels.count()))
        return linked(buckets, labels, sets, scratch, least)

    monkeypatch.setattr(near_text, "_linked_outside", counted)
    got = {r.doc_id: r.class_id for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert outside[0][0] > 50 and outside[0][1] < 50


def test_frequencies_do_not_depend_on_blocks(spark, monkeypatch):
    base = [f"w{k}" for k in range(209)]
    rows = [(k, " ".join(base)) for k in range(400)] + [(1000, " ".join(base + [f"v{k}" for k in range(50)]))]
    rows += [(2000 + k, " ".join(f"u{k}x{j // 2}y{j}" for j in range(40))) for k in range(100)]
    monkeypatch.setattr(near_text, "BLOCK_BYTES", 8000)
    got = {r.doc_id: r.class_id for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and got[1000] == 0


def test_links_of_a_text_that_a_repeated_id_has_too(spark):
    one, two = " ".join(f"a{k}" for k in range(100)), " ".join(f"b{k}" for k in range(100))
    rows = [(5, one), (5, two), (100, two), (200, two + " end"), (300, one + " end"), (7, None), (7, one), (400, "other")]
    got = {r.doc_id: r.class_id for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) == {5: 5, 7: 5, 100: 5, 200: 5, 300: 5, 400: 400}


def test_one_row_of_a_repeated_id_stands(spark):
    rows = [(5, "b text", 1), (5, "a text", 2), (5, "a text", 1), (None, "a text", 3), (None, "a text", 3), (6, None, 1), (6, None, 0), (7, None, 1), (7, "c", 1)]
    left = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, rows int"))
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(5, "a text", 1), (6, None, 0), (7, "c", 1), (None, "a text", 3), (None, "a text", 3)], key=str)
    with pytest.raises(TypeError):
        near_classes(spark.createDataFrame([("x", "y")], "doc_id string, text string"))


def test_very_many_rows_of_one_id(spark):
    rows = [(5, "the same text again")] * 3000 + [(5, "another text of it")] * 3000 + [(9, "another text of it")]
    got = {r.doc_id: r.class_id for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 5, 9: 5}


def test_empty(spark):
    assert near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_samples_agree_as_often_as_texts_resemble():
    rng = np.random.default_rng(1)
    hits = []
    for _ in range(60):
        h = np.unique(rng.integers(0, 1 << 62, 120, np.uint64))
        a, b = h[:100], h[10:110]
        w = lambda x: np.ones(len(x), np.float32)
        hits.append((band_keys(a, w(a)) == band_keys(b, w(b))).mean())
    similarity = 90 / 110
    assert np.mean(hits) == pytest.approx(similarity**3, abs=0.08)
    assert BANDS * np.mean(hits) > 5


def test_shingle_sets():
    text, hashes, n = shingle_sets(pa.array(["a b c d e", "A b, c d E!", None, "", "a b", "b c d e f a b c d e", "x x x x x x x"]))
    got = defaultdict(list)
    for t, h, k in zip(text.tolist(), hashes.tolist(), n.tolist(), strict=True):
        got[t].append((h, k))
    assert got[0] == got[1] and len(got[0]) == 1 and 2 not in got and 3 not in got
    assert len(got[4]) == 1 and len(got[5]) == 6 and got[0][0] in got[5] and got[6][0][1] == 3


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(5, 5), (200, 201), (201, 200), (160, 130)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {k: 100 for k in range(101, 161)} | {201: 200}
