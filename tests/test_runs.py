"""Chunkers that put documents together where they stand."""

from pyspark.sql import functions as F

from brindle.operators import chunks, modeled, runs
from brindle.operators.providers import LetterEmbedding, RuleModel


def test_runs_go_on_over_batches(spark):
    """Long and short documents, a batch of three rows at a time: every part comes back, in order."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        docs = spark.range(0, 40, 1, 3).select(F.col("id").alias("doc_id"), F.sequence(F.lit(0), F.when(F.col("id") % 9 == 0, 11).otherwise(F.col("id") % 4)).alias("xs"))
        parts = docs.select("doc_id", F.posexplode("xs").alias("pos", "x")).select("doc_id", "pos", F.array("x", F.col("x") + 100).alias("two"), F.col("x").cast("string").alias("w"), F.array(F.lit(1.0), F.col("x").cast("double")).alias("v"))
        found = {r.doc_id: r for r in runs.gathered(parts, "doc_id", ["pos", "two"], keep=["w"], vector="v").collect()}
        rows = {r.doc_id: r.xs for r in docs.collect()}
        assert set(found) == set(rows)
        for i, xs in rows.items():
            assert found[i].pos == xs and found[i].two == [y for x in xs for y in (x, x + 100)]
            assert found[i].w == "0"
            assert len(found[i].sims) == len(xs) and found[i].sims[-1] is None and None not in found[i].sims[:-1]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_chunkers_shuffle_nothing(spark):
    docs = spark.createDataFrame([(1, "One two. Three four! Five? Six."), (2, "Seven."), (3, ""), (4, None)], "doc_id long, text string")
    made = [
        chunks.semantic(docs, LetterEmbedding()),
        chunks.semantic_dual(docs, LetterEmbedding()),
        modeled.boundaries(docs, RuleModel()),
        modeled.split_agentic(docs, RuleModel(), LetterEmbedding(), threshold=0.99),
    ]
    for df in made:
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert {r.doc_id for r in df.collect()} == {1, 2}


def test_merging_is_no_fold(spark):
    """20,000 groups in a row: copying the list for each group took minutes."""
    groups = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20000)), lambda k: F.array(F.when(k % 10 == 0, "longer than").otherwise("short"))).alias("groups"))
    merged = groups.select(F.explode(F.array(chunks.merge_small(F.col("groups"), lambda g: F.length(g[0]) < 6))).alias("m"))
    assert "aggregate(" not in merged._jdf.queryExecution().optimizedPlan().toString()
    assert merged.select(F.size("m"), F.size(F.element_at("m", 1)), F.size(F.element_at("m", -1))).first()[:] == (2001, 9, 1)
    empty = groups.select(chunks.merge_small(F.array().cast("array<array<string>>"), lambda g: F.size(g) < 2).alias("m"))
    assert empty.first().m == []
