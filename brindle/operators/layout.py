"""Page layout to Markdown, over tables of spans, lines and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Font size ratios of heading levels, with the tolerance added to a ratio.
HEADING_RATIOS = ((1.6, 1), (1.35, 2), (1.18, 3), (1.08, 4))
TOLERANCE = 0.02
#: When lines are code: length, marks for each character, mean length of a paragraph's lines, share of
#: lines with a code end, marks for each line, and how dense a line is that is cut.
DENSE_CHARS, DENSE_MARKS, SHORT_LINES, TAIL_SHARE, LINE_MARKS, CUT_DENSITY = 60, 0.015, 90, 0.5, 1.5, 0.6
#: Fixed value: the size of a page without text.
DEFAULT_SIZE = 10.0
#: Fixed value: what starts a list item or a quotation.
BULLET = r"^\s*([-*+·•●○] |\d+[.)]\s|[a-zA-Z][.)]\s|>\s)"


def body_size(spans: DataFrame) -> DataFrame:
    """Each page's font size that most characters have, of equals the one seen first; blank spans count only on pages without others, without any size it is ``DEFAULT_SIZE``."""
    shown = spans.select("page", "line", "span", F.round("size", 1).alias("size"), F.greatest(F.length("text"), F.lit(1)).alias("chars"), (F.trim("text") == "").alias("blank"))
    sums = shown.groupBy("page", "blank", "size").agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n"), F.min(F.struct("line", "span")).alias("seen"))
    weight = F.when(F.col("blank"), F.col("n")).otherwise(F.col("chars"))
    order = F.struct((~F.col("blank")).alias("a"), F.col("size").isNotNull().alias("b"), weight.alias("c"), (-F.col("seen.line")).alias("d"), (-F.col("seen.span")).alias("e"))
    return sums.groupBy("page").agg(F.coalesce(F.max_by("size", order), F.lit(DEFAULT_SIZE)).alias("body_size"))


def line_sums(spans: DataFrame) -> DataFrame:
    """A row for each line: its text, mean and largest size, whether all of it is in a code font, and where it stands."""
    rows = styled(spans)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("x0", "span", "text"))), lambda x: x["text"])
    return rows.groupBy("page", "line").agg(
        F.array_join(ordered, "").alias("text"), F.round(F.avg("size"), 6).alias("avg_size"), F.max("size").alias("max_size"), F.bool_and("mono").alias("all_mono"), F.min("x0").alias("x0"), F.min("y0").alias("y0")
    )


def styled(spans: DataFrame, code_font: str = "(?i)mono|courier|consol|menlo|code") -> DataFrame:
    """Adds ``bold``, ``italic`` and ``mono`` from flags and font names; empty spans go."""
    font = F.lower(F.coalesce("font", F.lit("")))
    flags = F.coalesce("flags", F.lit(0))
    return spans.where("text <> ''").withColumns({
        "bold": (flags.bitwiseAND(16) != 0) | font.contains("bold"),
        "italic": (flags.bitwiseAND(2) != 0) | font.contains("italic"),
        "mono": F.coalesce(F.col("font").rlike(code_font), F.lit(False)),
    })


def heading_level(max_size: Column, body: Column) -> Column:
    """1 to 4 for sizes far enough above the body's, else 0."""
    ratio = max_size / body + TOLERANCE
    out = F.lit(0)
    for least, level in reversed(HEADING_RATIOS):
        out = F.when(ratio >= least, F.lit(level)).otherwise(out)
    return out


def bullet(text: Column | str) -> tuple[Column, Column]:
    """The mark of a list item or quotation, empty if it is none, and what follows it."""
    return F.regexp_extract(text, BULLET, 1), F.regexp_replace(text, BULLET, "")


def inline(spans: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Markdown of each line: code before bold before italic, then a link where a span's whole-number box has one."""
    rows = styled(spans)
    text = F.col("text")
    marked = F.when(F.col("mono"), F.concat(F.lit("`"), text, F.lit("`"))).when(F.col("bold"), F.concat(F.lit("**"), text, F.lit("**"))).when(F.col("italic"), F.concat(F.lit("*"), text, F.lit("*"))).otherwise(text)
    rows = rows.withColumn("md", marked)
    if links is not None:
        box = ["x0", "y0", "x1", "y1"]
        rows = rows.withColumns({f"i{c}": F.col(c).cast("int") for c in box})
        at = links.select(F.col("page").alias("p"), *[F.col(c).cast("int").alias(f"l{c}") for c in box], "uri")
        same = rows["page"] == at["p"]
        for c in box:
            same = same & (rows[f"i{c}"] == at[f"l{c}"])
        rows = rows.join(at, same, "left").withColumn("md", F.when(F.col("uri").isNotNull(), F.concat(F.lit("["), "md", F.lit("]("), "uri", F.lit(")"))).otherwise(F.col("md")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "span", "md"))), lambda x: x["md"]), "")
    return rows.groupBy("page", "line").agg(F.trim(joined).alias("md"))


def symbols(text: Column) -> Column:
    """Statement marks: semicolons, braces, arrows and double colons."""
    count = lambda s: (F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))) / len(s)
    return (count(";") + count("{") + count("}") + count("->") + count("::")).cast("int")


def dense_code_line(text: Column) -> Column:
    """A long line whose marks are many and that looks like code."""
    marks = F.length(text) - F.length(F.regexp_replace(text, "[;{}]", ""))
    enough = (symbols(text) >= 2) & (symbols(text) / F.greatest(F.length(text), F.lit(1)) >= DENSE_MARKS)
    hint = text.rlike(r"->|::|[{}]|\w\(|\"[^\"]+\"")
    return (F.length(text) >= DENSE_CHARS) & enough & ~(text.contains(";") & (marks < 2)) & hint


def code_paragraphs(lines: DataFrame) -> DataFrame:
    """Whether each paragraph (``page``, ``par``) looks like code: three short lines or more with code ends or many marks."""
    text = F.col("text")
    tail = F.rtrim(text).rlike("[;{}:,]$") | F.ltrim(text).rlike("^[})\\]]")
    sums = lines.where(F.trim("text") != "").groupBy("page", "par").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("avg"), F.sum(tail.cast("int")).alias("tails"), F.sum(symbols(text)).alias("marks"))
    looks = (F.col("n") >= 3) & (F.col("avg") <= SHORT_LINES) & ((F.col("tails") / F.col("n") >= TAIL_SHARE) | (F.col("marks") >= F.col("n") * LINE_MARKS))
    return sums.select("page", "par", looks.alias("is_code"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """Numbers runs of non-blank lines: ``par``; blank lines go. ``y`` is that of the paragraph's first line."""
    order = Window.partitionBy("page").orderBy("y0", "x0", "line")
    blank = F.trim("text") == ""
    rows = lines.withColumn("par", F.sum((blank | F.lag(blank).over(order).isNull()).cast("int")).over(order)).where(~blank)
    return rows.withColumn("y", F.min("y0").over(Window.partitionBy("page", "par")))


def table_markdown(tables: DataFrame) -> DataFrame:
    """Pipe tables from ``headers`` and ``rows``; pipes are escaped, line ends become spaces."""
    cell = lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, cell), " | "), F.lit(" |"))
    rule = lambda n: F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), n), "|"), F.lit("|"))
    headers, rows = F.coalesce("headers", F.array().cast("array<string>")), F.coalesce("rows", F.array().cast("array<array<string>>"))
    width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(1))
    head = F.when(F.size(headers) > 0, F.array(line(headers), rule(F.size(headers)))).otherwise(F.array(rule(width)))
    text = F.when((F.size(headers) == 0) & (F.size(rows) == 0), F.lit("")).otherwise(F.array_join(F.concat(head, F.transform(rows, line)), "\n"))
    return tables.withColumn("md", text)


def merge_pages(pages: DataFrame) -> DataFrame:
    """A file's non-blank pages in order, with a rule between them."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "md"))), lambda x: x["md"])
    return pages.where(F.trim("md") != "").groupBy("path").agg(F.array_join(ordered, "\n\n---\n\n").alias("md"))


def with_inserts(pars: DataFrame, inserts: DataFrame) -> DataFrame:
    """Tables and images among the paragraphs of their page: each before the first paragraph at or below it. One sort of both."""
    order = Window.partitionBy("page").orderBy("y", "kind", "par")
    both = pars.select("page", "y", F.lit(1).alias("kind"), "par", "md").unionByName(inserts.select("page", "y", F.lit(0).alias("kind"), F.lit(0).alias("par"), "md"))
    return both.withColumn("pos", F.row_number().over(order)).select("page", "pos", "md")


def split_code_line(text: Column) -> Column:
    """The parts of a long line with many braces and semicolons: cut after a semicolon and blanks before a word, and between ``}`` and ``{``. Other lines are one part."""
    weight = F.length(text) - F.length(F.regexp_replace(text, "[{};]", ""))
    busy = (F.length(text) >= DENSE_CHARS) & (weight * 50 >= CUT_DENSITY * F.greatest(F.length(text), F.lit(50)))
    cut = F.regexp_replace(F.regexp_replace(text, "(;[ \\t\u00a0]+)(?=\\w)", "$1\u0001"), "\\}\\{", "}\u0001{")
    parts = F.filter(F.transform(F.split(cut, "\u0001"), lambda p: F.rtrim(p)), lambda p: F.trim(p) != "")
    return F.when(busy & (F.size(parts) > 1), parts).otherwise(F.array(text))


def squeezed(text: Column) -> Column:
    """Text without blank lines at its start and without more than one in a row."""
    return F.regexp_replace(F.regexp_replace(text, "(\\n[ \\t]*){3,}", "\n\n"), "^\\s*\\n", "")


def image_markdown(path: Column) -> Column:
    """An image by its path, named by the path's last part."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.concat(F.lit("!["), F.regexp_extract(plain, "([^/]*)$", 1), F.lit("]("), plain, F.lit(")"))


def page_blocks(spans: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """The blocks of each page in order (``page``, ``block``, ``kind``, ``y``, ``md``).

    Lines of a code font, dense lines and paragraphs that look like code are
    code; neighbours share a fence, also across blank lines. Larger lines are
    headings, list items stand alone, and what is left of a paragraph is joined
    to one block.
    """
    sums = line_sums(spans).join(inline(spans, links), ["page", "line"]).join(body_size(spans), "page")
    rows = paragraphs(sums)
    rows = rows.join(code_paragraphs(rows), ["page", "par"])
    mark, rest = bullet("md")
    level = heading_level(F.col("max_size"), F.col("body_size"))
    kind = F.when(F.col("all_mono") | F.col("is_code") | dense_code_line(F.col("text")), "code").when(level > 0, "heading").when(mark != "", "item").otherwise("prose")
    item = F.when(mark.rlike("^[\\-*+·•●○] $"), F.concat(F.lit("- "), rest)).otherwise(F.trim(F.col("md")))
    rows = rows.withColumn("kind", kind).withColumn("piece", F.when(F.col("kind") == "code", F.array_join(split_code_line(F.col("text")), "\n")).when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("md"))).when(F.col("kind") == "item", item).otherwise(F.trim("md")))
    order = Window.partitionBy("page").orderBy("y0", "x0", "line")
    before = F.lag(F.struct("kind", "par")).over(order)
    joins = F.coalesce((F.col("kind") == before["kind"]) & ((F.col("kind") == "code") | ((F.col("kind") == "prose") & (F.col("par") == before["par"]))), F.lit(False))
    rows = rows.withColumn("block", F.sum((~joins).cast("int")).over(order))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "line", "piece"))), lambda x: x["piece"])
    whole = F.when(F.first("kind") == "code", F.concat(F.lit("```\n"), F.array_join(ordered, "\n"), F.lit("\n```"))).otherwise(F.array_join(ordered, " "))
    return rows.groupBy("page", "block").agg(F.first("kind").alias("kind"), F.min("y0").alias("y"), whole.alias("md"))


def page_markdown(spans: DataFrame, links: DataFrame | None = None, inserts: DataFrame | None = None) -> DataFrame:
    """The Markdown of each page: its blocks, with tables and images (``page``, ``y``, ``md``) among them."""
    blocks = page_blocks(spans, links).withColumnRenamed("block", "par")
    empty = blocks.select("page", "y", "md").limit(0)
    placed = with_inserts(blocks, empty if inserts is None else inserts)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "md"))), lambda x: x["md"]), "\n\n")
    return placed.groupBy("page").agg(squeezed(text).alias("md"))


def image_name(stem: Column | str, page: Column | str, suffix: str = "png") -> Column:
    """Page images are named by stem and three-digit page."""
    return F.format_string(f"%s_page_%03d.{suffix}", stem, page)


def page_range(pages: DataFrame, first: int, last: int) -> DataFrame:
    """Pages ``first`` to ``last``, both included; IndexError outside the file."""
    n = pages.agg(F.max("page")).first()[0] or 0
    if first < 1 or last > n or first > last:
        raise IndexError(f"pages {first} to {last} of {n}")
    return pages.where(F.col("page").between(first, last))
