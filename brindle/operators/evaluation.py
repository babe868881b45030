"""Evaluation of answers: alignment of questions and results, retrieval metrics."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import sentences

from . import dense


def align(qa: DataFrame, results: DataFrame) -> DataFrame:
    """Questions with the last result (by ``seq``) for the same question; questions without one are left out."""
    last = results.groupBy("question").agg(F.max_by(F.struct("answer", "contexts"), "seq").alias("r"))
    empty = F.array().cast("array<string>")
    return qa.join(last, "question").select("question", "ground_truth", F.coalesce("r.answer", F.lit("")).alias("answer"), F.coalesce("r.contexts", empty).alias("contexts"))


def unaligned(qa: DataFrame, results: DataFrame) -> DataFrame:
    """Questions without a result."""
    return qa.join(results.select("question").distinct(), "question", "left_anti")


def context_precision(verdicts: DataFrame) -> DataFrame:
    """Mean precision at the ranks of relevant contexts (``query_id``, ``rank``, ``relevant`` 0/1); 0 if none is relevant."""
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    at = verdicts.withColumn("p", F.avg(F.col("relevant").cast("double")).over(upto))
    total = F.sum("relevant")
    return at.groupBy("query_id").agg(F.round(F.when(total > 0, F.sum(F.col("p") * F.col("relevant")) / total).otherwise(0.0), 6).alias("context_precision"))


def ratio(verdicts: DataFrame, name: str) -> DataFrame:
    """Share of positive verdicts: faithfulness over claims, context recall over sentences of the ground truth."""
    return verdicts.groupBy("query_id").agg(F.round(F.avg(F.col("verdict").cast("double")), 6).alias(name))


def questions_from(nodes: DataFrame, per_chunk: int = 1, limit: int = 2400) -> DataFrame:
    """Question and answer pairs by template from the first sentences of each non-blank node."""
    from brindle.functions.text import sentences, truncated

    cut = nodes.where(F.trim("text") != "").select("node_id", "text", F.posexplode(F.slice(sentences(truncated("text", limit)), F.lit(1), F.lit(max(1, per_chunk)))).alias("n", "s"))
    return cut.select("node_id", F.concat(F.lit("What does the text say after: "), F.substring("s", 1, 40), F.lit("?")).alias("question"), F.col("s").alias("ground_truth"), F.col("text").alias("source_chunk"))


def _share(claims: Column, context: Column, judge) -> Column:
    """Share of supported claims, 0 if there is none. The judge is an expression, so nothing leaves the row."""
    supported = F.size(F.filter(claims, lambda c: judge.supports(c, context)))
    return F.round(F.coalesce(supported / F.nullif(F.size(claims), F.lit(0)), F.lit(0.0)), 6)


def faithfulness(judge) -> Column:
    """Share of the answer's sentences that the contexts support."""
    return _share(sentences("answer"), F.array_join("contexts", "\n"), judge)


def context_recall(judge) -> Column:
    """Share of the ground truth's sentences that the contexts support."""
    return _share(sentences("ground_truth"), F.array_join("contexts", "\n"), judge)


def ranked_precision(judge) -> Column:
    """Mean precision at the ranks of the contexts that support the ground truth; 0 if none does."""
    hits = F.transform("contexts", lambda c: judge.supports(F.col("ground_truth"), c).cast("int"))
    at = F.transform(F.array(hits), lambda v: F.transform(v, lambda x, k: x * F.aggregate(F.slice(v, F.lit(1), k + 1), F.lit(0), lambda a, b: a + b) / (k + 1)))[0]
    total = F.aggregate(hits, F.lit(0), lambda a, b: a + b)
    return F.round(F.when(total > 0, F.aggregate(at, F.lit(0.0), lambda a, b: a + b) / total).otherwise(0.0), 6)


def answer_relevancy(embedding, ask: Callable[[Column], Column] | None = None) -> Column:
    """Mean cosine between the question and the questions that the answer's sentences answer (the sentences themselves, or what ``ask`` makes of them)."""
    asked = F.transform(sentences("answer"), ask or (lambda s: s))
    question = F.array(dense.l2_normalize(embedding.embed(F.col("question"))))
    cosines = F.transform(asked, lambda s: F.transform(question, lambda q: dense.dot(q, dense.l2_normalize(embedding.embed(s))))[0])
    total = F.aggregate(cosines, F.lit(0.0), lambda a, b: a + b)
    return F.round(F.coalesce(total / F.nullif(F.size(cosines), F.lit(0)), F.lit(0.0)), 6)


def default_metrics(judge, embedding) -> dict[str, Column]:
    """The four metrics by name; a metric is a column over ``question``, ``answer``, ``contexts`` and ``ground_truth``."""
    return {"faithfulness": faithfulness(judge), "answer_relevancy": answer_relevancy(embedding), "context_precision": ranked_precision(judge), "context_recall": context_recall(judge)}


def evaluate(rows: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """A column for each metric behind the rows, all in one pass."""
    return rows.select("*", *[column.alias(name) for name, column in metrics.items()])


def mean_scores(scored: DataFrame, names: list[str]) -> DataFrame:
    """One row: ``n`` and the mean of each metric (null without rows)."""
    return scored.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(name), 6).alias(name) for name in names])


def run_pipeline(nodes: DataFrame, retriever, provider, metrics: dict[str, Column], *, per_chunk: int = 1, k: int = 5) -> DataFrame:
    """Questions from the nodes, answers to them, alignment, scores: one row for each question that has an answer."""
    from . import chat

    qa = questions_from(nodes, per_chunk).withColumn("query_id", F.xxhash64("node_id", "question", "ground_truth"))
    asked = qa.select("query_id", F.col("question").alias("query"))
    hits = retriever.retrieve(asked, k).withColumn("node_id", F.col("node_id").cast("string"))
    texts = hits.join(nodes.select(F.col("node_id").cast("string").alias("node_id"), "text"), "node_id")
    contexts = texts.where("text <> ''").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("contexts"))
    answered = chat.answer(asked, texts, provider, config=chat.ChatConfig(similarity_top_k=k)).join(contexts, "query_id", "left")
    results = answered.select(F.col("query").alias("question"), F.col("response").alias("answer"), "contexts", F.col("query_id").alias("seq"))
    return evaluate(align(qa.select("question", "ground_truth"), results), metrics)


def write_report(scored: DataFrame, names: list[str], path: str, seconds: float | None = None) -> dict:
    """Writes the rows as JSON lines in ``path/rows`` and a summary in ``path/summary``; returns the summary."""
    scored.write.mode("errorifexists").json(f"{path}/rows")
    means = mean_scores(scored.sparkSession.read.schema(scored.schema).json(f"{path}/rows"), names).first().asDict()
    summary = {"n": means.pop("n"), "scores": means, "elapsed_seconds": seconds}
    scored.sparkSession.createDataFrame([(json.dumps(summary),)], "value string").coalesce(1).write.text(f"{path}/summary")
    return summary
