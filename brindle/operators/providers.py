"""Models behind small interfaces, with deterministic ones that need no network."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class EmbeddingProvider(Protocol):
    def embed(self, text: Column) -> Column: ...


class LanguageModelProvider(Protocol):
    def complete(self, prompt: Column) -> Column: ...


class HashedEmbedding:
    """Feature hashing: words are counted in ``dim`` buckets by their hash; the vector is scaled to unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, text: Column) -> Column:
        from .dense import l2_normalize

        words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("\\w+"), F.lit(0))
        at = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(self.dim)))
        zero = F.array_repeat(F.lit(0.0), self.dim)
        return l2_normalize(F.aggregate(at, zero, lambda v, i: F.transform(v, lambda x, k: F.when(k == i, x + 1).otherwise(x))))


class ExtractiveModel:
    """Answers with the first sentence of the prompt's context."""

    def complete(self, prompt: Column) -> Column:
        return F.trim(F.regexp_extract(prompt, "(?s)Context:\\s*([^.!?]*[.!?]?)", 1))


class LetterEmbedding:
    """How often each letter from a to z occurs: an embedding that needs no model and that SQL can compute as well."""

    def embed(self, text: Column) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        return F.transform(F.array(low), lambda t: F.array(*[(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(c), F.lit("")))).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"]))[0]


class RuleModel:
    """Answers the prompts of ``modeled`` by rules.

    A topic ends after a sentence whose length is a multiple of ``modulus``;
    statements are sentences; a change of topic is confirmed if the statement
    before the mark is shorter than the one after it; a follow-up stands alone
    behind the user's last message.
    """

    def __init__(self, modulus: int = 5):
        self.modulus = modulus

    def complete(self, prompt: Column) -> Column:
        from brindle.functions.text import sentences

        lines = F.regexp_extract_all(prompt, F.lit("(?m)^\\[\\d+\\] (.*)$"), F.lit(1))
        flags = F.transform(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), lambda s: F.when(F.length(s) % self.modulus == 0, "true").otherwise("false"))
        before = F.regexp_extract(prompt, "(?m)^(.*)\\n<<<mark>>>", 1)
        after = F.regexp_extract(prompt, "<<<mark>>>\\n(.*)", 1)
        return (
            F.when(prompt.contains("\nText:\n"), F.to_json(sentences(F.regexp_extract(prompt, "(?s)\\nText:\\n(.*)", 1))))
            .when(prompt.contains("\n<<<mark>>>\n"), F.when(F.length(before) < F.length(after), "true").otherwise("false"))
            .when(prompt.contains("\n\nFollow-up: "), F.concat_ws(" ", F.nullif(F.regexp_extract(prompt, "(?s).*\\nUser: ([^\\n]*)", 1), F.lit("")), F.regexp_extract(prompt, "(?s)\\n\\nFollow-up: (.*)", 1)))
            .otherwise(F.concat(F.lit("["), F.array_join(flags, ", "), F.lit("]")))
        )


class JudgeProvider(Protocol):
    def supports(self, claim: Column, context: Column) -> Column: ...


class OverlapJudge:
    """A claim is supported if the context has a share of its distinct words; one without words is not."""

    def __init__(self, share: float = 0.5):
        self.share = share

    def supports(self, claim: Column, context: Column) -> Column:
        from brindle.functions.text import tokens

        words = F.array_distinct(tokens(claim))
        return F.coalesce(F.size(F.array_intersect(words, tokens(context))) / F.nullif(F.size(words), F.lit(0)) >= self.share, F.lit(False))
