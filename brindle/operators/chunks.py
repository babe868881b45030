"""Chunking: one document to many nodes. Documents have ``doc_id`` and ``text``; nodes get ``pos`` and ``text``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import estimated_tokens, node_id, sentences

from .runs import gathered


def greedy_groups(items: Column, size: Callable[[Column], Column], limit: int) -> Column:
    """Consecutive items in groups whose sizes add up to ``limit`` at most; a larger item stands alone.

    A fold inside the row over (position, size); only the positions at which
    groups begin are carried, so nothing long is copied.
    """
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("cuts"))
    sizes = F.transform(items, lambda x: size(x).cast("int"))

    def step(s: Column, n: Column) -> Column:
        over = (s["used"] > 0) & (s["used"] + n > limit)
        return F.struct(F.when(over, n).otherwise(s["used"] + n).alias("used"), (s["at"] + 1).alias("at"), F.when(over, F.concat(s["cuts"], F.array(s["at"]))).otherwise(s["cuts"]).alias("cuts"))

    cuts = F.aggregate(sizes, start, step, lambda s: F.concat(F.array(F.lit(0)), s["cuts"], F.array(s["at"])))
    bound = lambda c: F.filter(F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.slice(items, F.element_at(c, i) + 1, F.element_at(c, i + 1) - F.element_at(c, i))), lambda g: F.size(g) > 0)
    return F.transform(F.array(cuts), bound)[0]


def by_sentence(docs: DataFrame, chunk_size: int = 1024, overlap: int = 0) -> DataFrame:
    """Whole sentences packed greedily up to ``chunk_size`` estimated tokens.

    A sentence above the size is first cut into pieces of as many characters. A
    chunk begins with the last sentences of the one before that have ``overlap``
    tokens at most together.
    """
    if not 0 <= overlap < chunk_size:
        raise ValueError("overlap must be less than the size")
    most = max(1, 4 * (chunk_size - 1))
    pieces = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(s) / most).cast("int") - 1, F.lit(0))), lambda k: F.substring(s, k * most + 1, F.lit(most)))
    whole = F.flatten(F.transform(sentences("text"), lambda s: F.when(estimated_tokens(s) > chunk_size, pieces(s)).otherwise(F.array(s))))
    cut = docs.select("doc_id", F.explode(F.array(whole)).alias("items"))
    rows = cut.select("doc_id", F.explode(F.array(greedy_groups(F.col("items"), estimated_tokens, chunk_size))).alias("groups")).select("doc_id", "groups", F.posexplode("groups").alias("pos", "group"))
    if not overlap:
        return rows.select("doc_id", "pos", F.array_join("group", " ").alias("text"))
    before = F.when(F.col("pos") > 0, F.element_at("groups", F.greatest(F.col("pos"), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    tail = F.aggregate(
        F.reverse(before),
        F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda t, s: F.transform(
            F.array(t["open"] & (t["used"] + estimated_tokens(s) <= overlap)),
            lambda fits: F.struct(F.when(fits, t["used"] + estimated_tokens(s)).otherwise(t["used"]).alias("used"), (t["n"] + fits.cast("int")).alias("n"), fits.alias("open")),
        )[0],
    )["n"]
    kept = rows.select("doc_id", "pos", "group", before.alias("before"), tail.alias("n"))
    return kept.select("doc_id", "pos", F.array_join(F.concat(F.slice("before", F.size("before") - F.col("n") + 1, F.col("n")), "group"), " ").alias("text"))


def _windows(n: Column, size: int, overlap: int) -> Column:
    """1-based starts of windows over ``n`` units; the last one is the first to reach the end."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: i * step + 1)


def by_token(docs: DataFrame, size: int = 512, overlap: int = 50, separator: str = " ") -> DataFrame:
    """Windows of ``size`` separator-delimited tokens that overlap."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than the size")
    cut = docs.select("doc_id", F.explode(F.array(F.split(F.coalesce("text", F.lit("")), separator))).alias("t"))
    starts = cut.select("doc_id", "t", F.posexplode(_windows(F.size("t"), size, overlap)).alias("pos", "at"))
    return starts.select("doc_id", "pos", F.array_join(F.slice("t", F.col("at"), F.lit(size)), separator).alias("text"))


def fixed(docs: DataFrame, size: int = 1024, overlap: int = 200) -> DataFrame:
    """Windows of ``size`` characters that overlap."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than the size")
    text = F.coalesce("text", F.lit(""))
    starts = docs.select("doc_id", text.alias("text"), F.posexplode(_windows(F.length(text), size, overlap)).alias("pos", "at"))
    return starts.select("doc_id", "pos", F.substring("text", F.col("at"), F.lit(size)).alias("text"))


def sentence_nodes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(sentences("text")).alias("pos", "text"))


def sentence_window(docs: DataFrame, window: int = 3) -> DataFrame:
    """A node for each sentence, with up to ``window`` neighbours on each side in ``window``. A slice of the row's own array: no shuffle."""
    cut = docs.select("doc_id", F.explode(F.array(sentences("text"))).alias("s")).select("doc_id", "s", F.posexplode("s").alias("pos", "text"))
    first = F.greatest(F.col("pos") - window, F.lit(0))
    around = F.slice("s", first + 1, F.col("pos") + window - first + 1)
    return cut.select("doc_id", "pos", "text", F.array_join(around, " ").alias("window"))


def markdown(docs: DataFrame) -> DataFrame:
    """A node for each heading section, with the path of headings above it. Marks inside code fences are no headings."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    here = Window.partitionBy("doc_id").orderBy("line_no")
    fence = F.sum(F.col("line").rlike("^\\s*```").cast("int")).over(here) % 2 == 1
    level = F.length(F.regexp_extract("line", "^(#{1,6})\\s+\\S", 1))
    lines = lines.withColumn("level", F.when(fence | F.col("line").rlike("^\\s*```"), 0).otherwise(level))
    title = F.regexp_replace("line", "^#{1,6}\\s+|\\s+$", "")
    lines = lines.withColumn("pos", F.sum((F.col("level") > 0).cast("int")).over(here))
    heads = [F.last(F.when(F.col("level") == k, F.struct("line_no", title.alias("t"))), True).over(here).alias(f"h{k}") for k in range(1, 7)]
    full = lines.select("*", *heads)
    # A heading counts while no higher one came after it.
    alive = [F.when((F.col("level") == 0) | (F.col("level") > k), F.when(F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(F.col(f"h{j}.line_no"), F.lit(-1)) for j in range(1, k)]) < F.col(f"h{k}.line_no"), F.col(f"h{k}.t"))) for k in range(1, 7)]
    full = full.withColumn("path", F.concat_ws("/", *alive))
    sections = full.groupBy("doc_id", "pos").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"),
        F.min_by("path", "line_no").alias("header_path"),
    )
    return sections.where(F.trim("text") != "").select("doc_id", "pos", "header_path", "text")


def html_nodes(pages: DataFrame) -> DataFrame:
    """The text of paragraph, heading, list, emphasis and section elements; neighbours of one tag are merged."""
    pattern = "(?is)<(p|h[1-6]|li|b|i|u|section)(?:\\s[^>]*)?>([^<]*)"
    found = pages.select("page_id", F.posexplode(F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("tag"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("body"))).alias("n", "x"))
    rows = found.select("page_id", "n", F.lower("x.tag").alias("tag"), F.trim(F.regexp_replace("x.body", "\\s+", " ")).alias("body")).where("body <> ''")
    order = Window.partitionBy("page_id").orderBy("n")
    rows = rows.withColumn("pos", F.sum(F.coalesce(F.col("tag") != F.lag("tag").over(order), F.lit(True)).cast("int")).over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "body"))), lambda x: x["body"]), "\n")
    return rows.groupBy("page_id", "pos").agg(F.first("tag").alias("tag"), joined.alias("text"))


def code_lines(docs: DataFrame, lines: int = 40, overlap: int = 15, max_chars: int = 1500) -> DataFrame:
    """Windows of source lines that overlap, cut at ``max_chars``."""
    cut = docs.select("doc_id", F.explode(F.array(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("l"))
    starts = cut.select("doc_id", "l", F.posexplode(_windows(F.size("l"), lines, overlap)).alias("pos", "at"))
    whole = starts.select("doc_id", "pos", F.array_join(F.slice("l", F.col("at"), F.lit(lines)), "\n").alias("text"))
    pieces = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("text") / max_chars).cast("int") - 1))
    return whole.select("doc_id", "pos", "text", F.posexplode(pieces).alias("piece", "k")).select("doc_id", "pos", "piece", F.substring("text", F.col("k") * max_chars + 1, F.lit(max_chars)).alias("text"))


def hierarchy(docs: DataFrame, sizes: tuple[int, ...] = (2048, 512, 128), overlap: int = 0) -> DataFrame:
    """A tree of character windows, longest first, that overlap by ``overlap``: ``node_id``, ``parent_id``, ``level``, ``text``.

    Places of all levels are worked out in the row, so that texts are read and exploded once.
    """
    none = F.lit(None).cast("string")
    whole = F.struct(F.col("doc_id").cast("string").alias("node_id"), none.alias("parent_id"), F.lit(-1).alias("level"), F.lit(1).alias("at"), F.length("text").alias("n"))
    level, levels = F.array(whole), []

    def below(w: Column, depth: int, size: int) -> Column:
        name = lambda k: F.concat(w["node_id"], F.lit("."), k.cast("string")).alias("node_id")
        parent = (w["node_id"] if depth else none).alias("parent_id")
        length = lambda start: F.least(F.lit(size), w["n"] - start + 1).alias("n")
        return F.transform(_windows(w["n"], size, overlap), lambda start, k: F.struct(name(k), parent, F.lit(depth).alias("level"), (w["at"] + start - 1).alias("at"), length(start)))

    for level_size in enumerate(sorted(sizes, reverse=True)):
        level = F.flatten(F.transform(level, lambda w: below(w, *level_size)))  # noqa: B023  called at once
        levels.append(level)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.explode(F.concat(*levels)).alias("w"))
    return rows.select("doc_id", "w.node_id", "w.parent_id", "w.level", F.substring("text", F.col("w.at"), F.col("w.n")).alias("text"))


def leaves(nodes: DataFrame) -> DataFrame:
    parents = nodes.where("parent_id is not null").select(F.col("parent_id").alias("p")).distinct()
    return nodes.join(parents, nodes["node_id"] == parents["p"], "left_anti")


def auto_merge(hits: DataFrame, nodes: DataFrame, ratio: float = 0.4) -> DataFrame:
    """Where more than ``ratio`` of a parent's children were hit, the parent takes their place with their mean score."""
    children = nodes.where("parent_id is not null").groupBy("parent_id").agg(F.count(F.lit(1)).alias("children"))
    with_parent = hits.join(nodes.select("node_id", "parent_id"), "node_id")
    merged = with_parent.groupBy("query_id", "parent_id").agg(F.count(F.lit(1)).alias("hit"), F.avg("score").alias("score")).join(children, "parent_id").where(F.col("hit") / F.col("children") > ratio)
    kept = with_parent.join(merged.select("query_id", "parent_id"), ["query_id", "parent_id"], "left_anti")
    return kept.select("query_id", "node_id", "score").unionByName(merged.select("query_id", F.col("parent_id").alias("node_id"), "score"))


def merge_small(groups: Column, small: Callable[[Column], Column]) -> Column:
    """Groups of which a small one, other than the first, joins the one before it."""
    begins = F.transform(groups, lambda g, k: F.when((k > 0) & ~F.coalesce(small(g), F.lit(False)), k).otherwise(0))
    cuts = F.concat(F.array(F.lit(0)), F.filter(begins, lambda k: k > 0), F.array(F.size(groups)))
    joined = F.transform(F.array(cuts), lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.slice(groups, F.element_at(c, i) + 1, F.element_at(c, i + 1) - F.element_at(c, i))))[0]
    return F.transform(F.filter(joined, lambda g: F.size(g) > 0), F.flatten)


def cut_at(items: Column, flags: Column) -> Column:
    """Groups of consecutive items; a group ends after an item whose flag is set."""
    ends = F.concat(F.filter(F.transform(flags, lambda f, k: F.when(f, k + 1).otherwise(0)), lambda e: e > 0), F.array(F.size(items)))
    bounds = F.transform(F.array(F.concat(F.array(F.lit(0)), ends)), lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.slice(items, F.element_at(c, i) + 1, F.element_at(c, i + 1) - F.element_at(c, i))))[0]
    return F.filter(bounds, lambda g: F.size(g) > 0)


def tidy_groups(groups: Column, min_chars: int, max_chars: int) -> Column:
    """Groups of sentences: a short one joins the one before it, then long ones are cut at sentence ends."""
    length = lambda g: F.length(F.array_join(g, ""))

    merged = merge_small(groups, lambda g: length(g) < min_chars)
    return F.flatten(F.transform(merged, lambda g: greedy_groups(g, F.length, max_chars)))


def numbered(rows: DataFrame, id_col: str, order_col: str, width: int = 4096) -> DataFrame:
    """``number``: the place of each row in the order of ``id_col`` (an integer) and ``order_col``, from 0.

    Rows are numbered within ranges of ``width`` ids; only one count for each range is summed up in order.
    """
    ranged = rows.withColumn("__range", F.floor(F.col(id_col) / width))
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__first"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(id_col, order_col)) - 1
    return ranged.withColumn("__own", own).join(before, "__range").withColumn("number", F.col("__first") + F.col("__own")).drop("__range", "__own", "__first")


def proposition_nodes(statements: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """Nodes of statements, with ids from a counter over all of them."""
    rows = numbered(statements, id_col, order_col)
    return rows.select(node_id("prop", F.col("number"), "text").alias("node_id"), id_col, "text")


def json_leaves(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """One line for each member of a JSON object: key and value; a nested value stays JSON."""
    pairs = rows.select(id_col, F.explode(F.from_json(json_col, "map<string,string>")).alias("key", "value"))
    return pairs.select(id_col, "key", F.concat_ws(" ", "key", "value").alias("text"))


def json_paths(rows: DataFrame, id_col: str, json_col: str, depth: int = 8) -> DataFrame:
    """A line for each leaf of any JSON value, depth first: the keys and array places that lead to it, and the value.

    Values below ``depth`` levels stay JSON. Invalid JSON and nulls give no line.
    """
    node = F.struct(F.lit("").alias("path"), F.array().cast("array<string>").alias("order"), F.col(json_col).alias("value"))
    level = rows.select(F.col(id_col).alias("__id"), F.explode(F.array(node)).alias("x")).select("__id", "x.*")
    out = None
    for _ in range(depth):
        kind = F.substring(F.ltrim(F.col("value")), 1, 1)
        members = F.map_entries(F.from_json(F.when(kind == "{", F.col("value")), "map<string,string>"))
        items = F.transform(F.from_json(F.when(kind == "[", F.col("value")), "array<string>"), lambda v, k: F.struct(k.cast("string").alias("key"), v.alias("value")))
        inner = F.transform(F.coalesce(members, items), lambda e, k: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.lpad(k.cast("string"), 6, "0").alias("at")))
        opened = level.withColumn("inner", inner)
        leaf = opened.where("inner is null").drop("inner")
        out = leaf if out is None else out.unionByName(leaf)
        step = opened.where("inner is not null").select("__id", "path", "order", F.explode("inner").alias("e"))
        level = step.select("__id", F.concat_ws(" ", F.nullif("path", F.lit("")), "e.key").alias("path"), F.concat("order", F.array("e.at")).alias("order"), F.col("e.value").alias("value"))
    lines = out.unionByName(level).where("value is not null and path <> ''")
    return lines.select(F.col("__id").alias(id_col), "path", F.concat_ws(" ", "path", "value").alias("text"), F.array_join("order", ".").alias("order"))


def code_blocks(docs: DataFrame, max_chars: int = 1500) -> DataFrame:
    """Source code cut before top-level definitions (lines that begin with ``def``, ``async def``, ``class`` or a decorator above one), then at ``max_chars``."""
    cut = docs.select("doc_id", F.explode(F.array(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("l"))
    starts = lambda x, k: x.rlike("^(def|class|async def|@)\\b|^@") & ((k == 0) | ~F.coalesce(F.element_at("l", F.greatest(k, F.lit(1))).startswith("@"), F.lit(False)))
    flags = F.transform("l", lambda x, k: starts(x, k))
    ends = F.filter(F.transform(flags, lambda f, k: F.when(f & (k > 0), k).otherwise(-1)), lambda e: e > 0)
    bounds = cut.select("doc_id", "l", F.explode(F.array(F.concat(F.array(F.lit(0)), ends, F.array(F.size("l"))))).alias("c"))
    blocks = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.array_join(F.slice("l", F.element_at("c", i) + 1, F.element_at("c", i + 1) - F.element_at("c", i)), "\n"))
    whole = bounds.select("doc_id", F.posexplode(blocks).alias("pos", "text")).where(F.trim("text") != "")
    pieces = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("text") / max_chars).cast("int") - 1))
    return whole.select("doc_id", "pos", "text", F.posexplode(pieces).alias("piece", "k")).select("doc_id", "pos", "piece", F.substring("text", F.col("k") * max_chars + 1, F.lit(max_chars)).alias("text"))


def semantic(docs: DataFrame, embedding, *, buffer_size: int = 1, percentile: float = 95.0) -> DataFrame:
    """Nodes between the sentences whose surroundings differ most.

    A sentence is embedded together with ``buffer_size`` neighbours on each
    side; a node ends where the distance to the next exceeds the document's
    percentile of distances, so a larger percentile cuts less.
    """
    groups = _semantic_groups(docs, embedding, buffer_size, percentile)
    return groups.select("doc_id", F.posexplode(F.transform("groups", lambda g: F.array_join(g, " "))).alias("pos", "text"))


def _semantic_groups(docs: DataFrame, embedding, buffer_size: int = 1, percentile: float = 95.0) -> DataFrame:
    """``doc_id`` and ``groups`` of its sentences. A document's distances stay in its row: no shuffle, no window."""
    rows = sentence_window(docs, buffer_size).withColumn("vector", embedding.embed(F.col("window")))
    found = gathered(rows, "doc_id", ["text"], vector="vector")
    far = F.array_sort(F.transform(F.filter("sims", lambda s: s.isNotNull()), lambda s: 1 - s))
    ranked = found.select("doc_id", "text", "sims", F.explode(F.array(far)).alias("far"))
    at = (F.size("far") - 1) * F.lit(percentile / 100)
    low, high = F.get("far", F.floor(at).cast("int")), F.get("far", F.ceil(at).cast("int"))
    limit = F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)
    limited = ranked.select("doc_id", "text", "sims", F.explode(F.array(F.round(limit, 9))).alias("limit"))
    flags = F.transform("sims", lambda s: F.coalesce(F.round(1 - s, 9) > F.col("limit"), F.lit(False)))
    return limited.select("doc_id", F.explode(F.array(cut_at(F.col("text"), flags))).alias("groups"))


def semantic_dual(docs: DataFrame, embedding, *, max_tokens: int = 512, min_tokens: int = 50, **options) -> DataFrame:
    """Semantic nodes; short ones join the one before, and long ones are cut at sentence ends."""
    nodes = _semantic_groups(docs, embedding, **options)
    lists = nodes.select("doc_id", F.explode(F.array(F.transform("groups", lambda g: F.array(F.array_join(g, " "))))).alias("groups"))
    merged = lists.select("doc_id", F.explode(F.array(merge_small(F.col("groups"), lambda g: estimated_tokens(F.array_join(g, " ")) < min_tokens))).alias("groups"))
    texts = F.transform("groups", lambda g: F.array_join(g, " "))
    pieces = merged.select("doc_id", F.posexplode(texts).alias("part", "text")).select("doc_id", "part", F.explode(F.array(sentences("text"))).alias("items"))
    groups = pieces.select("doc_id", "part", F.posexplode(greedy_groups(F.col("items"), estimated_tokens, max_tokens)).alias("piece", "g"))
    return groups.select("doc_id", F.col("part").alias("pos"), "piece", F.array_join("g", " ").alias("text"))


def _plain(split: Callable[..., DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda docs: split(docs).select("doc_id", F.col("pos").cast("long").alias("pos"), "text")


def _leaf_windows(docs: DataFrame) -> DataFrame:
    rows = leaves(hierarchy(docs))
    at = F.transform(F.slice(F.split("node_id", "\\."), -3, 3), lambda x: x.cast("long"))
    return rows.select("doc_id", (at[0] * 1_000_000 + at[1] * 1000 + at[2]).alias("pos"), "text")


#: How each document type is split; a splitter takes documents and gives ``doc_id``, ``pos`` and ``text``. More may be registered.
SPLITTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "text": _plain(by_sentence),
    "sentence": _plain(by_sentence),
    "token": _plain(by_token),
    "simple": _plain(fixed),
    "sentence_window": _plain(sentence_window),
    "markdown": _plain(markdown),
    "html": lambda docs: html_nodes(docs.withColumnsRenamed({"doc_id": "page_id", "text": "html"})).select(F.col("page_id").alias("doc_id"), F.col("pos").cast("long").alias("pos"), "text"),
    "json": lambda docs: json_paths(docs, "doc_id", "text").select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("order")) - 1).cast("long").alias("pos"), "text"),
    "code": lambda docs: code_blocks(docs).select("doc_id", (F.col("pos") * 1000 + F.col("piece")).cast("long").alias("pos"), "text"),
    "hierarchy": _leaf_windows,
}


def auto_split(docs: DataFrame, doc_type: str | None = "text", types: tuple[str, ...] = tuple(SPLITTERS)) -> DataFrame:
    """Splits documents as their type wants it.

    Without a ``doc_type`` each row is split by its own, in a column of that
    name: one of ``types``, each of which is a branch of the plan; other rows
    give no nodes.
    """
    for name in types if doc_type is None else (doc_type,):
        if name not in SPLITTERS:
            raise ValueError(f"doc_type must be one of {sorted(SPLITTERS)}")
    if doc_type is not None:
        return SPLITTERS[doc_type](docs)
    out = None
    for name in types:
        part = SPLITTERS[name](docs.where(F.col("doc_type") == name).select("doc_id", "text"))
        out = part if out is None else out.unionByName(part)
    return out
