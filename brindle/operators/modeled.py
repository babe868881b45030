"""Chunking with models: topic boundaries, propositions and agentic chunks.

A model is a provider whose ``complete`` takes a prompt column (see
``providers``), so that it may be an expression, an Arrow UDF or a remote call.
Prompts are rows, documents are not: what a model answers comes back to its
document where it stands, as a document's prompts follow each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import flags_reply, node_id, propositions_reply, sentences, truncated

from .chunks import cut_at, greedy_groups, merge_small
from .runs import gathered

#: Characters of a sentence in a boundary prompt, of a statement in a confirmation, and below which a paragraph is a statement itself.
SENTENCE_CHARS, STATEMENT_CHARS, SHORT_PARAGRAPH = 300, 200, 30


def _one_line(text: Column) -> Column:
    return F.regexp_replace(text, "\\s*\\n\\s*", " ")


def boundary_prompt(items: Column, limit: int = SENTENCE_CHARS) -> Column:
    """Numbered sentences, long ones cut, and what is asked about the gaps between them."""
    lines = F.transform(items, lambda s, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] "), truncated(_one_line(s), limit)))
    return F.concat(F.lit("For each sentence but the last, does a new topic begin after it? Answer with a JSON list of booleans.\n"), F.array_join(lines, "\n"))


def boundary_batches(docs: DataFrame, batch_size: int = 8) -> DataFrame:
    """``batch_size`` sentences a row and the one after them (``items``), so that every gap is asked about once; ``prompt`` is null for a single sentence."""
    cut = docs.select("doc_id", F.explode(F.array(sentences("text"))).alias("s")).where(F.size("s") > 0)
    firsts = F.sequence(F.lit(0), F.greatest(F.size("s") - 2, F.lit(0)), F.lit(batch_size))
    rows = cut.select("doc_id", "s", F.posexplode(firsts).alias("batch", "at"))
    rows = rows.select("doc_id", "batch", F.explode(F.array(F.slice("s", F.col("at") + 1, F.lit(batch_size + 1)))).alias("items"), (F.col("at") + batch_size + 1 >= F.size("s")).alias("last"))
    return rows.withColumn("prompt", F.when(F.size("items") > 1, boundary_prompt(F.col("items"))))


def boundaries(docs: DataFrame, provider, batch_size: int = 8) -> DataFrame:
    """``doc_id``, its ``sentences`` and a flag for each gap between them; where a model fails or says nothing there is no boundary."""
    asked = boundary_batches(docs, batch_size).withColumn("reply", F.coalesce(provider.complete(F.col("prompt")), F.lit("")))
    # Each batch brings its own sentences; its extra one is the next batch's first.
    own = F.when(F.col("last"), F.col("items")).otherwise(F.slice("items", F.lit(1), F.size("items") - 1))
    parts = asked.select("doc_id", own.alias("sentences"), flags_reply("reply", F.size("items") - 1).alias("flags"))
    return gathered(parts, "doc_id", ["sentences", "flags"])


def split_by_llm(docs: DataFrame, provider, *, batch_size: int = 8, min_chars: int = 200, max_chars: int = 2000) -> DataFrame:
    """Chunks between the boundaries that a model sees: short ones join the one before, long ones are cut at sentence ends."""
    found = boundaries(docs, provider, batch_size)
    groups = found.select("doc_id", F.explode(F.array(cut_at(F.col("sentences"), F.col("flags")))).alias("groups"))
    merged = groups.select("doc_id", F.explode(F.array(merge_small(F.col("groups"), lambda g: F.length(F.array_join(g, "")) < min_chars))).alias("groups"))
    return _nodes(merged, max_chars, "", "llm")


def _nodes(groups: DataFrame, max_chars: int, separator: str, prefix: str) -> DataFrame:
    """Nodes of ``groups`` after the long ones were cut between items; ids count ten thousand chunks a document."""
    pieces = F.flatten(F.transform("groups", lambda g: greedy_groups(g, F.length, max_chars)))
    rows = groups.select("doc_id", F.posexplode(F.transform(pieces, lambda g: F.trim(F.array_join(g, separator)))).alias("pos", "text")).where("text <> ''")
    return rows.select("doc_id", "pos", node_id(prefix, F.col("doc_id") * 10000 + F.col("pos"), "text").alias("node_id"), "text")


def paragraphs_of(docs: DataFrame) -> DataFrame:
    """Paragraphs, stripped; blank ones go."""
    parts = F.transform(F.split(F.coalesce("text", F.lit("")), "\\n\\s*\\n"), lambda p: F.regexp_replace(p, "^\\s+|\\s+$", ""))
    return docs.select("doc_id", F.posexplode(parts).alias("par", "paragraph")).where("paragraph <> ''")


def propositions(paragraphs: DataFrame, provider) -> DataFrame:
    """Statements of each paragraph (``doc_id``, ``par``, ``n``, ``text``).

    A short paragraph is one statement and no model is asked; where the model
    fails, or its reply has no statement, the paragraph stands as it is.
    """
    prompt = F.when(F.length("paragraph") >= SHORT_PARAGRAPH, F.concat(F.lit("List the statements of the text as a JSON list of strings.\nText:\n"), F.col("paragraph")))
    asked = paragraphs.withColumn("reply", provider.complete(prompt))
    found = asked.select("doc_id", "par", "paragraph", F.explode(F.array(propositions_reply("reply"))).alias("found"))
    return found.select("doc_id", "par", F.posexplode(F.when(F.size("found") > 0, F.col("found")).otherwise(F.array("paragraph"))).alias("n", "text"))


def confirm_prompt(items: Column, at: Column, context: int = 4) -> Column:
    """Statements around a gap, with a mark in it."""
    cut = lambda part: F.array_join(F.transform(part, lambda s: truncated(_one_line(s), STATEMENT_CHARS)), "\n")
    before, after = F.slice(items, F.greatest(at - context + 1, F.lit(1)), F.least(at, F.lit(context))), F.slice(items, at + 1, F.lit(context))
    return F.concat(F.lit("Does the topic change at the mark? Answer true or false.\n"), cut(before), F.lit("\n<<<mark>>>\n"), cut(after))


def split_agentic(
    docs: DataFrame, provider, embedding, *, threshold: float = 0.55, window: int = 3, min_statements: int = 2, max_chars: int = 2000, confirm: bool = True
) -> DataFrame:
    """Chunks of statements between changes of topic.

    Statements are embedded; where the mean similarity around a gap is low and,
    with ``confirm``, the model agrees, a chunk ends. Chunks of few statements
    join the one before, long ones are cut between statements. The model is only
    asked about gaps that are in question.
    """
    parts = propositions(paragraphs_of(docs), provider)
    rows = parts.withColumn("vector", embedding.embed(F.col("text")))
    found = gathered(rows, "doc_id", ["text"], vector="vector").withColumnRenamed("text", "items")

    def low(sim: Column, k: Column) -> Column:
        first = F.greatest(k - window, F.lit(0))
        near = F.filter(F.slice("sims", first + 1, k + window - first + 1), lambda s: s.isNotNull())
        mean = F.aggregate(near, F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size(near), F.lit(0))
        return F.when(sim.isNotNull() & (F.round(mean, 9) < threshold), k + 1).otherwise(0)

    marked = found.select("doc_id", "items", F.explode(F.array(F.filter(F.transform("sims", low), lambda e: e > 0))).alias("ends"))
    if confirm:
        # Each gap in question is a row; the first of a document brings its statements along.
        gaps = marked.select("doc_id", "items", F.posexplode_outer("ends").alias("j", "end"))
        prompt = F.when(F.col("end").isNotNull(), confirm_prompt(F.col("items"), F.col("end")))
        asked = gaps.select("doc_id", F.when(F.coalesce("j", F.lit(0)) == 0, F.col("items")).alias("items"), "end", prompt.alias("prompt")).withColumn("reply", provider.complete(F.col("prompt")))
        agreed = asked.select("doc_id", "items", F.when(F.coalesce(F.lower(F.trim("reply")).startswith("true"), F.lit(False)), F.col("end")).alias("ends"))
        marked = gathered(agreed, "doc_id", ["ends"], keep=["items"])
    flags = F.transform("items", lambda _, k: F.coalesce(F.array_contains("ends", k + 1), F.lit(False)))
    groups = marked.select("doc_id", F.explode(F.array(cut_at(F.col("items"), F.slice(flags, F.lit(1), F.size("items") - 1)))).alias("groups"))
    merged = groups.select("doc_id", F.explode(F.array(merge_small(F.col("groups"), lambda g: F.size(g) < min_statements))).alias("groups"))
    return _nodes(merged, max_chars, " ", "agentic")


def merged_metadata(document: Column, own: Column) -> Column:
    """A node's metadata: its document's, and its own where both have a key."""
    return F.map_concat(F.map_filter(document, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own)
