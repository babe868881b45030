"""Chat memory, prompts and answers; many conversations at once."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import estimated_tokens, truncated

NO_CONTEXT = "(no context found)"


@dataclass(frozen=True)
class ChatConfig:
    """Explicit settings; a call's own arguments come first, then these."""

    similarity_top_k: int = 5
    memory_token_limit: int = 3000
    system_prompt: str = "Answer from the context only."
    condense: bool = False

    @classmethod
    def from_environment(cls, prefix: str = "BRINDLE_CHAT_", **own) -> "ChatConfig":
        """Arguments first, then environment variables (``BRINDLE_CHAT_SIMILARITY_TOP_K`` and so on), then the defaults."""
        values = {}
        for f in fields(cls):
            text = os.environ.get(prefix + f.name.upper())
            if f.name in own:
                values[f.name] = own[f.name]
            elif text is not None:
                values[f.name] = text.lower() in ("1", "true", "yes") if isinstance(f.default, bool) else type(f.default)(text)
        return cls(**values)


def trim_memory(messages: DataFrame, token_limit: int = 3000) -> DataFrame:
    """The newest messages of each conversation whose estimated tokens fit the limit together."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    used = messages.withColumn("used_tokens", F.sum(estimated_tokens("text")).over(newest))
    return used.where(F.col("used_tokens") <= token_limit)


def history(messages: DataFrame) -> DataFrame:
    """Each conversation as text: one line for each message, users and assistants named."""
    label = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(label, F.lit(": "), F.coalesce("text", F.lit(""))).alias("line")))), lambda x: x["line"])
    return messages.groupBy("conv_id").agg(F.concat(F.lit("\n\n[History]\n"), F.array_join(lines, "\n")).alias("history"))


def context(hits: DataFrame) -> DataFrame:
    """The texts of each query's hits in rank order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    return hits.where("text <> ''").groupBy("query_id").agg(F.array_join(texts, "\n\n").alias("context"))


def prompt(context_text: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n"), F.coalesce(context_text, F.lit(NO_CONTEXT)), F.lit("\n\nQuestion: "), question)


def answer(queries: DataFrame, hits: DataFrame, provider, messages: DataFrame | None = None, config: ChatConfig | None = None) -> DataFrame:
    """Answers a table of questions: retrieved context, history and prompt as columns, then one pass of the provider.

    ``queries`` has ``query_id``, ``query`` and, with ``messages``, ``conv_id``.
    """
    config = config or ChatConfig()
    rows = queries.join(context(hits.where(F.col("rank") <= config.similarity_top_k)), "query_id", "left")
    system = F.lit(config.system_prompt)
    if messages is not None:
        rows = rows.join(history(trim_memory(messages, config.memory_token_limit)), "conv_id", "left")
        system = F.concat(system, F.coalesce("history", F.lit("")))
    rows = rows.withColumn("prompt", F.concat(system, F.lit("\n\n"), prompt(F.col("context"), F.col("query"))))
    return rows.withColumn("response", provider.complete(F.col("prompt")))


def condensed(queries: DataFrame, messages: DataFrame, provider) -> DataFrame:
    """Follow-up questions made to stand alone: the model sees the conversation and the question; without an answer the question stays."""
    rows = queries.join(history(messages), "conv_id", "left")
    asked = F.concat(F.coalesce("history", F.lit("")), F.lit("\n\nFollow-up: "), F.col("query"))
    reply = F.trim(provider.complete(asked))
    return rows.withColumn("query", F.coalesce(F.nullif(reply, F.lit("")), F.col("query"))).drop("history")


def respond(queries: DataFrame, retriever, nodes: DataFrame, provider, messages: DataFrame | None = None, config: ChatConfig | None = None) -> DataFrame:
    """Retrieval, context, prompt and answer for a table of questions; ``nodes`` has the texts (``node_id``, ``text``)."""
    config = config or ChatConfig()
    if config.condense and messages is not None:
        queries = condensed(queries, messages, provider)
    hits = retriever.retrieve(queries.select("query_id", "query"), config.similarity_top_k)
    texts = nodes.select(F.col("node_id").cast("string").alias("node_id"), "text")
    found = hits.withColumn("node_id", F.col("node_id").cast("string")).join(texts, "node_id")
    return answer(queries, found, provider, messages, config)


def recorded(messages: DataFrame, answered: DataFrame) -> DataFrame:
    """The memory with a user's and an assistant's message for each answered question (``conv_id``, ``query``, ``response``)."""
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("last"))
    at = Window.partitionBy("conv_id").orderBy("query_id")
    rows = answered.join(last, "conv_id", "left").withColumn("turn", F.coalesce("last", F.lit(-1)) + 2 * F.row_number().over(at) - 1)
    said = F.explode(F.array(F.struct(F.col("turn"), F.lit("user").alias("role"), F.col("query").alias("text")), F.struct((F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("response").alias("text"))))
    return messages.select("conv_id", "turn", "role", "text").unionByName(rows.select("conv_id", said.alias("x")).select("conv_id", "x.*"))


def reset(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """The memory without the given conversations."""
    return messages.join(conversations.select("conv_id").distinct(), "conv_id", "left_anti")


def converse(questions: DataFrame, retriever, nodes: DataFrame, provider, messages: DataFrame, config: ChatConfig | None = None, *, keep=lambda memory: memory) -> DataFrame:
    """Answers the questions of conversations (``conv_id``, ``turn``, ``query_id``, ``query``) turn by turn; gives the memory afterwards.

    All conversations take a turn together, so there are as many rounds as the
    longest has questions. ``keep`` may write the memory between rounds.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    numbered = questions.withColumn("round", F.row_number().over(order))
    rounds = numbered.agg(F.max("round")).first()[0] or 0
    for k in range(1, rounds + 1):
        asked = numbered.where(F.col("round") == k).select("conv_id", "query_id", "query")
        messages = keep(recorded(messages, respond(asked, retriever, nodes, provider, messages, config)))
    return messages


def trace(hits: DataFrame, answered: DataFrame, limit: int = 800) -> DataFrame:
    """What happened for each question, in order: the hits it got, the prompt the model got, and its answer."""
    event = lambda n, kind, text: F.struct(F.lit(n).alias("event_no"), F.lit(kind).alias("kind"), truncated(text, limit).alias("payload"))
    found = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("node_id").cast("string").alias("node_id")))), lambda x: x["node_id"]).alias("nodes"))
    rows = answered.join(found, "query_id", "left")
    got = F.coalesce(F.array_join("nodes", ","), F.lit(""))
    return rows.select("query_id", F.inline(F.array(event(1, "retrieve", got), event(2, "prompt", F.col("prompt")), event(3, "answer", F.coalesce("response", F.lit(""))))))


def chat_loop(respond_to, read=input, write=print) -> int:
    """A console: reads questions until ``exit``, ``quit`` or the end of input and writes what ``respond_to`` answers; returns how many."""
    asked = 0
    while True:
        try:
            question = read("> ").strip()
        except EOFError:
            return asked
        if question.lower() in ("exit", "quit"):
            return asked
        if question:
            asked += 1
            write(respond_to(question))
