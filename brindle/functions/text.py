"""Text functions as column expressions; null texts count as empty unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the tokenizer.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "in", "on", "at", "by", "for", "with", "to",
    "of", "and", "or", "but", "this", "that", "these", "those", "it", "its", "as", "if",
)
#: Stop characters of the tokenizer (stop words of one character; longer ones cannot match a character).
STOP_CHARACTERS = tuple("的了在是我有和就不人都一上也很到说要去你会着看好这那些里为与及或但而以把被让使由从向对跟比等")
#: What ends a sentence.
SENTENCE_ENDS = "。！？!?."
MAX_HASH_CHARS = 10


def _text(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def tokens(text: Column | str, remove_stop_words: bool = True) -> Column:
    """Lower-case ASCII words of two characters or more, then single CJK characters."""
    words = F.transform(F.regexp_extract_all(_text(text), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    characters = F.regexp_extract_all(_text(text), F.lit("[一-鿿]"), F.lit(0))
    words = F.filter(words, lambda w: F.length(w) >= 2)
    if remove_stop_words:
        words = F.filter(words, lambda w: ~w.isin(*STOP_WORDS))
        characters = F.filter(characters, lambda c: ~c.isin(*STOP_CHARACTERS))
    return F.concat(words, characters)


def normalize(text: Column | str) -> Column:
    """Runs of blanks become one space and three or more line ends two; ends are stripped."""
    blanks = F.regexp_replace(_text(text), "[ \\t\u00a0\u3000]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(blanks, "\\n{3,}", "\n\n"), "^\\s+|\\s+$", ""))


def sentences(text: Column | str) -> Column:
    """Sentences in order: paragraphs are cut at blank lines, then after each end mark."""
    paragraphs = F.split(_text(text), "\\n\\s*\\n")
    cut = lambda p: F.regexp_extract_all(p, F.lit(f"[^{SENTENCE_ENDS}]*[{SENTENCE_ENDS}]|[^{SENTENCE_ENDS}]+"), F.lit(0))
    pieces = F.transform(F.flatten(F.transform(paragraphs, cut)), lambda s: F.regexp_replace(s, "^[\\s\u3000]+|[\\s\u3000]+$", ""))
    return F.filter(pieces, lambda s: s != "")


def estimated_tokens(text: Column | str) -> Column:
    """CJK characters / 1.5 and others / 4, rounded down, plus 1; 0 for the empty text."""
    all_chars = F.length(_text(text))
    other = F.length(F.regexp_replace(_text(text), "[一-鿿]", ""))
    return F.when(all_chars == 0, F.lit(0)).otherwise(F.floor((all_chars - other) / 1.5 + other / 4).cast("int") + 1)


def text_hash(text: Column | str) -> Column:
    return F.substring(F.md5(_text(text)), 1, MAX_HASH_CHARS)


def node_id(prefix: str, index: Column, text: Column | str) -> Column:
    """``prefix``, a four-digit index and the text's hash, joined by underscores."""
    return F.format_string(f"{prefix}_%04d_%s", index, text_hash(text))


def truncated(text: Column | str, limit: int, with_total: bool = False) -> Column:
    """The first ``limit`` characters and dots, or a note of the whole length, if there are more."""
    whole = _text(text)
    note = F.concat(F.lit("... ("), F.length(whole).cast("string"), F.lit(" chars)")) if with_total else F.lit("...")
    return F.when(F.length(whole) > limit, F.concat(F.substring(whole, 1, limit), note)).otherwise(whole)


def _bracketed(raw: Column | str) -> Column:
    """From the first opening to the last closing bracket of a reply, code fences left out."""
    bare = F.regexp_replace(_text(raw), "(?i)```(json)?", "")
    return F.regexp_extract(bare, "(?s)\\[.*\\]", 0)


def flags_reply(raw: Column | str, n: Column) -> Column:
    """A model's JSON list of booleans, or of their names, as exactly ``n`` flags: cut, or padded with false."""
    items = F.coalesce(F.from_json(_bracketed(raw), "array<string>"), F.array().cast("array<string>"))
    flags = F.transform(items, lambda x: F.coalesce(F.lower(F.trim(x)) == "true", F.lit(False)))
    return F.slice(F.concat(flags, F.transform(F.sequence(F.lit(0), n), lambda _: F.lit(False))), F.lit(1), n)


def propositions_reply(raw: Column | str) -> Column:
    """A model's JSON list of statements, stripped, blank ones dropped."""
    items = F.coalesce(F.from_json(_bracketed(raw), "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def questions_reply(raw: Column | str) -> Column:
    """A model's JSON list of question and answer objects; strict JSON first, single quotes for double ones after that."""
    shape = "array<struct<question:string,ground_truth:string>>"
    text = _bracketed(raw)
    items = F.coalesce(F.from_json(text, shape), F.from_json(F.regexp_replace(text, "'", '"'), shape))
    full = lambda x: F.coalesce((F.trim(x["question"]) != "") & (F.trim(x["ground_truth"]) != ""), F.lit(False))
    return F.coalesce(F.filter(items, full), F.array().cast(shape))


def html_text(html: Column | str) -> Column:
    """The text of a page's body: scripts, styles and tags go, blanks are squeezed. A body without its end tag runs to the end."""
    body = F.regexp_extract(_text(html), "(?is)<body[^>]*>(.*?)(</body>|$(?![\\s\\S]))", 1)
    bare = F.regexp_replace(F.regexp_replace(body, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, "\\s+", " "))
