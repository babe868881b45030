import hashlib
import math
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from brindle.llm.decontaminate import drop_contaminated, find_items
from brindle.llm.interleave import interleave_shards, shuffle_key
from brindle.llm.licenses import TEMPLATES, scan_licenses, template_bigrams

WORDS = [hashlib.md5(str(k).encode()).hexdigest()[:6] for k in range(4000)]


def shingles(text):
    w = [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_contained_items_like_brute_force(spark):
    items = [(k, " ".join(WORDS[k * 20 : k * 20 + 14 + k])) for k in range(30)] + [(50, None), (51, ""), (52, "two words"), (None, "x y z")]
    docs = []
    for k in range(30):
        filler = " ".join(WORDS[(j * 37 + k * 11) % 4000] for j in range(40 * k * k))
        docs.append((k, f"{filler} {items[k][1]} {filler}", "s"))
        part = items[k][1].split()
        docs.append((100 + k, filler + " " + " ".join(part[: len(part) * 8 // 10]) + ".", "s"))
    docs += [(200, None, "s"), (201, "", "s"), (202, "Two, words!", "s"), (None, items[3][1], "s"), (7, "a second row of seven", "s")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, item string")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.shared) for r in find_items(docs, table).collect()}
    sets = defaultdict(set)
    for r in docs.collect():
        sets[r.doc_id] |= shingles(r.text)
    expect = set()
    for k, text in items:
        need = shingles(text)
        for doc, have in sets.items():
            if k is not None and doc is not None and need and len(need & have) / len(need) >= 0.8:
                expect.add((doc, k, len(need & have)))
    assert got == expect
    left = drop_contaminated(docs, table)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _, _ in expect}
    assert find_items(docs.limit(0), table).count() == 0 and find_items(docs, table.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 24, 1000])
def test_interleave_laws(spark, n):
    rows = [(k if k % 50 else 7, ("é" * (k % 9)) if k % 11 else None, None if k % 13 == 0 else ("hot" if k % 3 else f"s{k % 7}"), k) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, stratum long")
    got = interleave_shards(docs, 24).collect()
    assert len(got) == n
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t, _, _ in rows)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert all(0 <= s < 24 and sorted(x) == list(range(len(x))) for s, x in shards.items())
    sizes = [len(shards[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_interleave_like_brute_force(spark):
    docs = spark.createDataFrame([(k, f"t{k % 5}", None if k % 9 == 0 else f"s{k % 3 * (k % 2)}") for k in range(700)], "doc_id long, text string, source string")
    keyed = docs.select("doc_id", "text", "source", F.xxhash64("text").alias("h")).select("doc_id", "source", shuffle_key(17, "doc_id", "h").alias("key")).collect()
    by_source = defaultdict(list)
    for r in keyed:
        by_source["" if r.source is None else f"={r.source}"].append((r.key, r.doc_id))
    order = sorted(((2 * k + 1) / (2 * len(rows)), source, key, doc) for source, rows in by_source.items() for k, (key, doc) in enumerate(sorted(rows)))
    expect, used = {}, Counter()
    for at, (_, _, _, doc) in enumerate(order):
        shard = at * 24 // 700
        expect[doc] = (shard, used[shard])
        used[shard] += 1
    assert {r.doc_id: (r.shard, r.slot) for r in interleave_shards(docs, 24).collect()} == expect


def test_many_rows_of_one_id(spark):
    docs = spark.range(6000).select(F.lit(7).alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    got = interleave_shards(docs, 24).collect()
    assert len(got) == 6000 and Counter(r.shard for r in got) == {s: 250 for s in range(24)}
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(250))
    same = Counter(r.shard for r in got if r.size == 12)
    assert min(same.values()) > 80


def test_every_shard_has_the_mixture(spark):
    docs = spark.createDataFrame([(k, "t", "a" if k % 3 == 0 else "b" if k % 3 == 1 or k < 600 else "c") for k in range(2400)], "doc_id long, text string, source string")
    whole = Counter(r.source for r in docs.collect())
    mixed = docs.join(interleave_shards(docs, 24).select("doc_id", "shard"), "doc_id").collect()
    for s in range(24):
        part = Counter(r.source for r in mixed if r.shard == s)
        for source, n in whole.items():
            assert abs(part[source] - n / 24) <= 2


def best_windows(text):
    """All windows of all lengths, templates one by one."""
    w = re.sub("[^a-z0-9]+", " ", (text or "").lower()).split()
    pairs = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    found = []
    for k, name, grams in template_bigrams():
        n, grams = len(grams), set(grams)
        for start in range(len(pairs)):
            if pairs[start] not in grams:
                continue
            seen, best = set(), None
            for end in range(start, min(len(pairs), start + math.ceil(n * 1.5))):
                if pairs[end] in grams:
                    seen.add(pairs[end])
                    dice = 2.0 * len(seen) / (end - start + 1 + n)
                    if dice >= 0.8 and (best is None or dice * len(seen) > -best[0]):
                        best = (-dice * len(seen), -dice, k, start, end - start + 1, name)
            if best:
                found.append(best)
    kept = []
    for x in sorted(found):
        if all(x[3] > y[3] + y[4] or y[3] > x[3] + x[4] for y in kept):
            kept.append(x)
    return [(start, size + 1, name, k, round(-dice, 9)) for _, dice, k, start, size, name in kept]


def test_licences_like_brute_force(spark):
    filler = " ".join(WORDS[:60])
    texts = [None, "", "x", "Intro.\nReleased under the MIT License.\nmore", "released  under THE mit license -- today!", "Licensed under CC BY 4.0", "This work is licensed under the GNU General Public License, version 3.\n\nThis work is licensed under the GNU General Public License version 4", "lorem ipsum dolor\n" * 2000]
    texts += [textwrap.fill(f"{filler} {text} {filler}", 70) for _, text in TEMPLATES] + ["// " + textwrap.fill(TEMPLATES[6][1], 60).replace("\n", "\n// ")]
    texts += [f"{filler} {' '.join(text.split()[: len(text.split()) * 3 // 4])} {filler} {text}" for _, text in TEMPLATES] + ["free software of the public license version " * 30]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] + [(3, texts[3], 1), (None, texts[5], 1)], "doc_id long, text string, w long")
    expect = Counter((r.doc_id, *x) for r in docs.collect() for x in best_windows(r.text))
    got = Counter((r.doc_id, r.word_no, r.words, r.license, r.template_no, round(r.dice, 9)) for r in scan_licenses(docs).collect())
    assert got == expect
    whole = {(d, name) for d, _, _, name, _, _ in got if d is not None and 8 <= d < 8 + len(TEMPLATES)}
    assert whole >= {(8 + k, name) for k, (name, _) in enumerate(TEMPLATES)}  # wrapped, none is lost
    assert scan_licenses(docs.limit(0)).count() == 0


def test_short_items_in_documents_below_a_power_of_two(spark):
    docs = spark.createDataFrame([(n, " ".join(WORDS[: n + 4])) for n in (63, 127)], "doc_id long, text string")
    items = [(k, " ".join(WORDS[k : k + 5 + k % 2])) for k in range(62)]
    got = {(r.doc_id, r.item_id) for r in find_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(n, k) for n in (63, 127) for k, _ in items}
