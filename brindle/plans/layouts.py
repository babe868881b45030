"""Page layout, over a table of spans made from the documents: a page for each, a line for each of its lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import layout

from .registry import query, table

#: What the generated lines are by ``(7 * page + 3 * line) mod 12``: list items, code, blanks; then sizes, fonts and flags.
DENSE = 'int a = f(x); { b -> c; } g::h("q"); }{ end; next; '


def _spans(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
    rows = rows.withColumn("line", F.col("line").cast("long")).withColumn("k", F.pmod(F.col("page") * 7 + F.col("line") * 3, F.lit(12)))
    k, t = F.col("k"), F.col("t")
    text = F.when(k == 0, F.concat(F.lit("- "), t)).when(k == 1, F.concat(F.lit("1. "), t)).when(k == 2, F.concat(F.lit(DENSE), t)).when(k == 3, F.lit("x = {")).when(k == 4, F.lit("  ")).otherwise(t)
    size = F.when(k == 5, F.lit(16.0)).when(k == 6, F.lit(13.5)).when(k == 7, F.lit(11.8)).when(k == 8, F.lit(10.9)).otherwise(F.lit(10.0) + (F.col("page") % 3) * 0.04)
    rows = rows.select("page", "line", "k", text.alias("t"), size.alias("size")).withColumn("h", F.floor(F.length("t") / 2).cast("int"))
    rows = rows.select("*", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("span"))
    font = F.when(k == 9, "Courier").when((k == 10) & (F.col("span") == 0), "Arial-Bold").otherwise("Arial")
    flags = F.when(k == 11, 2).when((k == 8) & (F.col("span") == 1), 16).otherwise(0)
    part = F.when(F.col("span") == 0, F.expr("substring(t, 1, h)")).otherwise(F.expr("substring(t, h + 1)"))
    x, y = F.col("span") * 50.0, F.col("line") * 12.0
    return rows.select("page", "line", "span", x.alias("x0"), y.alias("y0"), (x + 49).alias("x1"), (y + 10).alias("y1"), font.alias("font"), "size", flags.alias("flags"), part.alias("text"))


SPANS_SQL = f"""
WITH ln AS (SELECT doc_id AS page, i - 1 AS line, (7 * doc_id + 3 * (i - 1)) % 12 AS k, l[i] AS t, doc_id FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
tx AS (SELECT page, line, k, CASE k WHEN 0 THEN '- ' || t WHEN 1 THEN '1. ' || t WHEN 2 THEN '{DENSE}' || t WHEN 3 THEN 'x = {{' WHEN 4 THEN '  ' ELSE t END AS t,
  CASE k WHEN 5 THEN 16.0::DOUBLE WHEN 6 THEN 13.5 WHEN 7 THEN 11.8 WHEN 8 THEN 10.9 ELSE 10.0::DOUBLE + (page % 3) * 0.04::DOUBLE END AS size FROM ln),
sp AS (SELECT page, line, k, span, span * 50.0::DOUBLE AS x0, line * 12.0::DOUBLE AS y0, size,
  CASE WHEN k = 9 THEN 'Courier' WHEN k = 10 AND span = 0 THEN 'Arial-Bold' ELSE 'Arial' END AS font, CASE WHEN k = 11 THEN 2 WHEN k = 8 AND span = 1 THEN 16 ELSE 0 END AS flags,
  CASE span WHEN 0 THEN t[1:length(t) // 2] ELSE t[length(t) // 2 + 1:] END AS text FROM (SELECT *, unnest([0, 1]) AS span FROM tx)),
st AS (SELECT *, flags & 16 <> 0 OR contains(lower(font), 'bold') AS bold, flags & 2 <> 0 OR contains(lower(font), 'italic') AS italic, regexp_matches(lower(font), 'mono|courier|consol|menlo|code') AS mono FROM sp WHERE text <> ''),
bz AS (SELECT page, round(size, 1) AS size, trim(text) = '' AS blank, sum(greatest(length(text), 1)) AS chars, count(*) AS n, min(line * 2 + span) AS seen FROM sp GROUP BY ALL),
body AS (SELECT page, size AS body_size FROM bz QUALIFY row_number() OVER (PARTITION BY page ORDER BY blank, CASE WHEN blank THEN n ELSE chars END DESC, seen) = 1),
ls AS (SELECT page, line, string_agg(text, '' ORDER BY x0, span) AS text, round(avg(size), 6) AS avg_size, max(size) AS max_size, bool_and(mono) AS all_mono, min(x0) AS x0, min(y0) AS y0 FROM st GROUP BY page, line),
marked AS (SELECT page, line, x0, span, k, CASE WHEN mono THEN '`' || text || '`' WHEN bold THEN '**' || text || '**' WHEN italic THEN '*' || text || '*' ELSE text END AS md FROM st),
il AS (SELECT page, line, trim(string_agg(md, '' ORDER BY x0, span)) AS md FROM marked GROUP BY page, line)"""
_LEVEL = "CASE WHEN max_size / body_size + 0.02 >= 1.6 THEN 1 WHEN max_size / body_size + 0.02 >= 1.35 THEN 2 WHEN max_size / body_size + 0.02 >= 1.18 THEN 3 WHEN max_size / body_size + 0.02 >= 1.08 THEN 4 ELSE 0 END"
_COUNT = lambda s: f"(length(text) - length(replace(text, '{s}', ''))) // {len(s)}"
_SYMBOLS = "(" + " + ".join(_COUNT(s) for s in (";", "{", "}", "->", "::")) + ")"
_MARKS = "(length(text) - length(regexp_replace(text, '[;{}]', '', 'g')))"
_DENSE = rf"""(length(text) >= 60 AND {_SYMBOLS} >= 2 AND {_SYMBOLS} / greatest(length(text), 1) >= 0.015 AND NOT (contains(text, ';') AND {_MARKS} < 2) AND regexp_matches(text, '->|::|[{{}}]|\w\(|"[^"]+"'))"""
_PARTS = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '(;[ \t\x{a0}]+)(\w)', '\1' || chr(1) || '\2', 'g'), '\}\{', '}' || chr(1) || '{', 'g'), chr(1)), lambda p: rtrim(p)), lambda p: trim(p) <> '')"
_SPLIT = f"CASE WHEN length(text) >= 60 AND {_MARKS} * 50 >= 0.6 * greatest(length(text), 50) AND len({_PARTS}) > 1 THEN {_PARTS} ELSE [text] END"
_BULLET = r"'^\s*([-*+·•●○] |\d+[.)]\s|[a-zA-Z][.)]\s|>\s)'"
PAR_SQL = SPANS_SQL + r""",
o AS (SELECT *, sum(CAST(trim(text) = '' OR before IS NULL AS INT)) OVER (PARTITION BY page ORDER BY y0, x0, line) AS par
  FROM (SELECT *, lag(text) OVER (PARTITION BY page ORDER BY y0, x0, line) AS before FROM ls)),
pr AS (SELECT * FROM o WHERE trim(text) <> ''),
cp AS (SELECT page, par, count(*) >= 3 AND avg(length(text)) <= 90 AND (sum(CAST(regexp_matches(rtrim(text), '[;{}:,]$') OR regexp_matches(ltrim(text), '^[})\]]') AS INT)) / count(*) >= 0.5 OR sum(""" + _SYMBOLS + """) >= count(*) * 1.5) AS is_code FROM pr GROUP BY page, par)"""
BLOCKS_SQL = PAR_SQL + f""",
kd AS (SELECT page, line, par, x0, y0, text, md, {_LEVEL} AS level, regexp_extract(md, {_BULLET}, 1) AS mark, regexp_replace(md, {_BULLET}, '') AS rest, all_mono OR is_code OR {_DENSE} AS code
  FROM pr JOIN cp USING (page, par) JOIN il USING (page, line) JOIN body USING (page)),
pc AS (SELECT *, CASE WHEN code THEN 'code' WHEN level > 0 THEN 'heading' WHEN mark <> '' THEN 'item' ELSE 'prose' END AS kind,
  CASE WHEN code THEN array_to_string({_SPLIT}, chr(10)) WHEN level > 0 THEN repeat('#', level) || ' ' || md WHEN mark <> '' AND regexp_matches(mark, '^[-*+·•●○] $') THEN '- ' || rest ELSE trim(md) END AS piece FROM kd),
jn AS (SELECT *, sum(CAST(NOT coalesce(kind = pk AND (kind = 'code' OR (kind = 'prose' AND par = pp)), false) AS INT)) OVER (PARTITION BY page ORDER BY y0, x0, line) AS block
  FROM (SELECT *, lag(kind) OVER w AS pk, lag(par) OVER w AS pp FROM pc WINDOW w AS (PARTITION BY page ORDER BY y0, x0, line))),
bk AS (SELECT page, CAST(block AS BIGINT) AS block, any_value(kind) AS kind, min(y0) AS y, CASE WHEN any_value(kind) = 'code' THEN '```' || chr(10) || string_agg(piece, chr(10) ORDER BY y0, x0, line) || chr(10) || '```'
  ELSE string_agg(piece, ' ' ORDER BY y0, x0, line) END AS md FROM jn GROUP BY page, block)"""


@query(SPANS_SQL + "SELECT page, body_size FROM body")
def pdf_body_size(spark, sf_dir):
    return layout.body_size(_spans(spark, sf_dir))


@query(SPANS_SQL + "SELECT page, line, text, avg_size, max_size, all_mono FROM ls")
def pdf_lines(spark, sf_dir):
    return layout.line_sums(_spans(spark, sf_dir)).drop("x0", "y0")


@query(SPANS_SQL + f"SELECT page, line, {_LEVEL} AS level FROM ls JOIN body USING (page)")
def pdf_headings(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    return layout.line_sums(spans).join(layout.body_size(spans), "page").select("page", "line", layout.heading_level(F.col("max_size"), F.col("body_size")).alias("level"))


@query(SPANS_SQL + f"SELECT page, line, regexp_extract(text, {_BULLET}, 1) AS mark, regexp_replace(text, {_BULLET}, '') AS body FROM ls")
def pdf_bullets(spark, sf_dir):
    mark, body = layout.bullet("text")
    return layout.line_sums(_spans(spark, sf_dir)).select("page", "line", mark.alias("mark"), body.alias("body"))


@query(SPANS_SQL + """SELECT page, line, trim(string_agg(CASE WHEN k = 7 AND span = 0 THEN '[' || md || '](http://x/' || page || ')' ELSE md END, '' ORDER BY x0, span)) AS md FROM marked GROUP BY page, line""")
def pdf_inline(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    linked = spans.where((F.pmod(F.col("page") * 7 + F.col("line") * 3, F.lit(12)) == 7) & (F.col("span") == 0))
    links = linked.select("page", *[(F.col(c) + 0.4).alias(c) for c in ("x0", "y0", "x1", "y1")], F.concat(F.lit("http://x/"), F.col("page")).alias("uri"))
    return layout.inline(spans, links)


@query(SPANS_SQL + f"SELECT page, line, {_DENSE} AS dense FROM ls")
def pdf_code_lines(spark, sf_dir):
    return layout.line_sums(_spans(spark, sf_dir)).select("page", "line", layout.dense_code_line(F.col("text")).alias("dense"))


@query(SPANS_SQL + f"SELECT page, line, array_to_string({_SPLIT}, chr(10)) AS parts FROM ls")
def pdf_split_lines(spark, sf_dir):
    return layout.line_sums(_spans(spark, sf_dir)).select("page", "line", F.array_join(layout.split_code_line(F.col("text")), "\n").alias("parts"))


@query(PAR_SQL + "SELECT page, CAST(par AS BIGINT) AS par, is_code FROM cp")
def pdf_code_paragraphs(spark, sf_dir):
    return layout.code_paragraphs(layout.paragraphs(layout.line_sums(_spans(spark, sf_dir))))


@query(PAR_SQL + "SELECT page, line, CAST(par AS BIGINT) AS par, min(y0) OVER (PARTITION BY page, par) AS y FROM pr")
def pdf_paragraphs(spark, sf_dir):
    return layout.paragraphs(layout.line_sums(_spans(spark, sf_dir))).select("page", "line", "par", "y")


@query(BLOCKS_SQL + "SELECT page, block, kind, y, md FROM bk")
def pdf_blocks(spark, sf_dir):
    return layout.page_blocks(_spans(spark, sf_dir))


_PICTURE = "'![fig_' || page || '.png](out/img/fig_' || page || '.png)'"


@query(BLOCKS_SQL + rf""",
bx AS (SELECT page, y, 1 AS kind, block AS par, md FROM bk UNION ALL SELECT page, 24.0, 0, 0, {_PICTURE} FROM body),
bj AS (SELECT page, string_agg(md, chr(10) || chr(10) ORDER BY y, kind, par) AS md FROM bx GROUP BY page)
SELECT page, regexp_replace(regexp_replace(md, '(\n[ \t]*){{3,}}', chr(10) || chr(10), 'g'), '^\s*\n', '') AS md FROM bj""")
def pdf_page_markdown(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    path = F.concat(F.lit("out\\img\\fig_"), F.col("page"), F.lit(".png"))
    pictures = spans.select("page").distinct().select("page", F.lit(24.0).alias("y"), layout.image_markdown(path).alias("md"))
    return layout.page_markdown(spans, inserts=pictures)


_CELL = "replace(replace({}, '|', '\\|'), chr(10), ' ')"


@query(f"""SELECT doc_id AS page, CASE doc_id % 4
WHEN 0 THEN '|---|---|' || chr(10) || '| ' || doc_id || ' | ' || lang || ' |'
WHEN 1 THEN '| a\\|b | c |' || chr(10) || '|---|---|' || chr(10) || '| ' || {_CELL.format("text[1:40]")} || ' | ' || source || ' |' || chr(10) || '| x | y z |'
WHEN 2 THEN '' ELSE '| only |' || chr(10) || '|---|' END AS md FROM documents""")
def pdf_table_md(spark, sf_dir):
    case = F.col("doc_id") % 4
    headers = F.when(case == 1, F.array(F.lit("a|b"), F.lit("c"))).when(case == 3, F.array(F.lit("only")))
    rows = F.when(case == 0, F.array(F.array(F.col("doc_id").cast("string"), F.col("lang")))).when(case == 1, F.array(F.array(F.substring("text", 1, 40), F.col("source")), F.array(F.lit("x"), F.lit("y\nz"))))
    tables = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), headers.alias("headers"), rows.alias("rows"))
    return layout.table_markdown(tables).select("page", "md")


@query("""SELECT source AS path, string_agg(md, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id) AS md
FROM (SELECT source, doc_id, CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE text END AS md FROM documents) WHERE trim(md) <> '' GROUP BY source""")
def pdf_merge_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("page"), F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.col("text")).alias("md"))
    return layout.merge_pages(pages)


@query("""WITH b AS (SELECT doc_id % 50 AS page, CAST(n_chars AS DOUBLE) AS y, 1 AS kind, doc_id AS par, lang AS md FROM documents UNION ALL SELECT item_id % 50, item_id * 100.0, 0, 0, 'table ' || item_id FROM benchmark)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY y, kind, par) AS pos, md FROM b""")
def pdf_inserts(spark, sf_dir):
    pars = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("page"), F.col("n_chars").cast("double").alias("y"), F.col("doc_id").alias("par"), F.col("lang").alias("md"))
    more = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 50).alias("page"), (F.col("item_id") * 100.0).alias("y"), F.concat(F.lit("table "), F.col("item_id")).alias("md"))
    return layout.with_inserts(pars, more).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT doc_id + 1 AS page, lang FROM documents WHERE doc_id + 1 BETWEEN 20 AND 150")
def page_range(spark, sf_dir):
    return layout.page_range(table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("page"), "lang"), 20, 150)


@query("SELECT doc_id, source || '_page_' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(3, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') || '.png' AS name FROM documents")
def image_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", layout.image_name("source", F.col("doc_id")).alias("name"))
