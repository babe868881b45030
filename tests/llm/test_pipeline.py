from collections import defaultdict

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm._common import BYTES_CONF
from brindle.llm.decontaminate import find_items
from brindle.llm.language_id import fit, identify
from brindle.llm.near_text import near_classes
from brindle.llm.secret_scan import SecretScanner
from brindle.llm.token_bytes import encoder

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_apply_their_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(9001, "12 34 !!", "en", "s", 8), (9002, None, None, None, None), (9003, "the token = \"abcdef123456\" of it", "en", "s", 1)], docs.schema)
    docs = docs.unionAll(more)
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontaminate", "secret_scan", "pack"]
    seen = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        if name != "pack":
            assert docs.columns == before.columns and docs.schema == before.schema
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "language_id":
            judged = {r.doc_id: r for r in identify(before.select("doc_id", "text"), fit(before)).collect()}
            assert kept == {k for k, r in judged.items() if r.lang_pred != "und" and r.score >= 0.5}
            assert {9001, 9002} & kept == set() and len(kept) > 0.97 * len(seen)
            assert {r.doc_id: r.lang for r in docs.collect()} == {k: judged[k].lang_pred for k in kept}
        elif name == "near_dedup":
            assert kept == {r.doc_id for r in near_classes(before).collect() if r.doc_id == r.class_id}
        elif name == "decontaminate":
            assert kept == {r.doc_id for r in before.collect()} - {r.doc_id for r in find_items(before, benchmark).collect()}
            assert len(kept) < before.count()
        elif name == "secret_scan":
            rows = docs.collect()
            assert kept == {r.doc_id for r in before.collect()}
            assert all(r.n_chars == len(r.text) for r in rows) and not any(SecretScanner().scan([r.text for r in rows]))
            assert {r.doc_id: r.text for r in rows}[9003] == 'the [REDACTED]" of it'
        else:
            pieces = defaultdict(dict)
            for r in docs.collect():
                pieces[r.doc_id][r.start] = bytes(r.token_bytes)
            texts = before.collect()
            whole = {k: b"".join(x for _, x in sorted(p.items())) for k, p in pieces.items()}
            assert whole == {r.doc_id: ids + bytes(4) for r, ids in zip(texts, encoder().encode_all([r.text for r in texts]), strict=True)}


def test_wanted_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.known_language(spark, docs, SF, languages=("de", "fr"))
    assert {r.lang for r in kept.select("lang").distinct().collect()} == {"de", "fr"}


@pytest.mark.parametrize("n", [0, 1, 40])
def test_stages_with_odd_rows(spark, n):
    """Empty tables, repeated rows, null ids and columns whose names the operators use themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(n)
    docs = docs.unionAll(docs.limit(n // 2)).unionAll(docs.limit(n // 4).withColumn("doc_id", F.lit(None).cast("long")))
    for name in ("row", "id", "lang_pred", "score", "rep", "hashes", "item", "h", "secrets", "start", "block"):
        docs = docs.withColumn(name, F.col("doc_id") * 2)
    benchmark = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = lambda text: re.sub(r"[^\w]+|_", " ", text.lower()).split()
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        rows, had = docs.collect(), before.collect()
        if name != "pack":
            assert docs.columns == before.columns
            assert all(r.row == (None if r.doc_id is None else 2 * r.doc_id) for r in rows)
        if name == "near_dedup":
            ids = [r.doc_id for r in rows if r.doc_id is not None]
            assert len(ids) == len(set(ids)) and sum(r.doc_id is None for r in rows) == sum(r.doc_id is None for r in had)
        elif name == "decontaminate":
            for r in rows:
                if r.doc_id is not None:
                    assert not any(" ".join(words(b)) in " ".join(words(r.text)) for b in benchmark)
        elif name == "secret_scan":
            assert len(rows) == len(had)
        elif name == "pack":
            assert sum(len(np.frombuffer(r.token_bytes, "<u4")) for r in rows) == sum(len(ids) // 4 + 1 for ids in encoder().encode_all([r.text for r in had]))
    spark.conf.unset(BYTES_CONF)


def test_run_leaves_the_session_as_it_was(spark):
    before = spark.conf.get(BYTES_CONF)
    assert corpus_pipeline.run(spark, SF).where("token_bytes is null").count() == 0
    assert spark.conf.get(BYTES_CONF) == before
