"""Text functions, chunking and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import text as tx
from brindle.operators import chunks
from brindle.sources import collection, files
from brindle.streaming.ingest import status_counts

from .registry import query, table

_STRIP = r"regexp_replace({}, '^[\s\x{{3000}}]+|[\s\x{{3000}}]+$', '', 'g')"
SENTENCES_SQL = r"""list_filter(list_transform(flatten(list_transform(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), lambda p: regexp_extract_all(p, '[^。！？!?.]*[。！？!?.]|[^。！？!?.]+'))), lambda s: """ + _STRIP.format("s") + "), lambda s: s <> '')"
WIN = "range(0, greatest(0, CAST(ceil(({n} - {size}) / {step}) AS BIGINT)) + 1)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, CAST(i - 1 AS INT) AS pos, s[i] AS text FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {SENTENCES_SQL} AS s FROM documents))")
def sentence_split(spark, sf_dir):
    return chunks.sentence_nodes(_docs(spark, sf_dir))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\x{00a0}\x{3000}]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text FROM documents")
def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.normalize("text").alias("text"))


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE CAST(floor((length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g'))) / 1.5 + length(regexp_replace(text, '[一-鿿]', '', 'g')) / 4) AS INT) + 1 END AS tokens FROM documents")
def estimate_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.estimated_tokens("text").alias("tokens"))


@query("SELECT doc_id, 'node_' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(4, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') || '_' || md5(text)[1:10] AS node_id FROM documents")
def node_ids(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.node_id("node", F.col("doc_id"), "text").alias("node_id"))


@query("SELECT doc_id, CASE WHEN length(text) > 800 THEN text[1:800] || '... (' || length(text) || ' chars)' ELSE text END AS shown, CASE WHEN length(text) > 2400 THEN text[1:2400] || '...' ELSE text END AS asked FROM documents")
def truncate_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.truncated("text", 800, True).alias("shown"), tx.truncated("text", 2400).alias("asked"))


def _case(n, *values):
    out = F.lit(values[-1]) if isinstance(values[-1], str) else values[-1]
    for k, value in reversed(list(enumerate(values[:-1]))):
        out = F.when(F.col("doc_id") % n == k, F.lit(value) if isinstance(value, str) else value).otherwise(out)
    return out


#: What stands between the first and the last bracket of a reply without code fences.
_JSON = r"regexp_extract(regexp_replace(raw, '(?i)```(json)?', '', 'g'), '(?s)\[.*\]', 0)"
_LIST = f"CASE WHEN {_JSON} <> '' THEN json_extract_string({_JSON}, '$[*]') ELSE [] END"


@query(rf"""
WITH r AS (SELECT doc_id, doc_id % 4 + 1 AS n, CASE doc_id % 5 WHEN 0 THEN '```json' || chr(10) || '[true, "True", false]' || chr(10) || '```' WHEN 1 THEN 'Sure: ["false", true, true] done'
  WHEN 2 THEN 'no list ' || lang WHEN 3 THEN '' ELSE '[' || CASE WHEN n_chars % 2 = 0 THEN 'true' ELSE 'false' END || ', null, " TRUE "]' END AS raw FROM documents)
SELECT doc_id, array_to_string(list_concat(list_transform({_LIST}, lambda v: coalesce(lower(trim(v)) = 'true', false)), [false, false, false, false])[1:n], ',') AS flags FROM r""")
def parse_bool_array(spark, sf_dir):
    even = F.when(F.col("n_chars") % 2 == 0, "true").otherwise("false")
    raw = _case(5, '```json\n[true, "True", false]\n```', 'Sure: ["false", true, true] done', F.concat(F.lit("no list "), F.col("lang")), "", F.concat(F.lit("["), even, F.lit(', null, " TRUE "]')))
    rows = _docs(spark, sf_dir).select("doc_id", (F.col("doc_id") % 4 + 1).cast("int").alias("n"), raw.alias("raw"))
    return rows.select("doc_id", F.array_join(F.transform(tx.flags_reply("raw", F.col("n")), lambda f: f.cast("string")), ",").alias("flags"))


@query(rf"""
WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '```json' || chr(10) || CAST(to_json([' ' || text[1:20], '  ', lang]) AS VARCHAR) || chr(10) || '```' WHEN 1 THEN 'none' ELSE 'x ["' || source || '"] y' END AS raw FROM documents)
SELECT doc_id, array_to_string(list_filter(list_transform({_LIST}, lambda v: trim(v)), lambda v: v <> ''), '|') AS items FROM r""")
def parse_propositions(spark, sf_dir):
    first = F.concat(F.lit("```json\n"), F.to_json(F.array(F.concat(F.lit(" "), F.substring("text", 1, 20)), F.lit("  "), F.col("lang"))), F.lit("\n```"))
    rows = _docs(spark, sf_dir).select("doc_id", _case(3, first, "none", F.concat(F.lit('x ["'), F.col("source"), F.lit('"] y'))).alias("raw"))
    return rows.select("doc_id", F.array_join(tx.propositions_reply("raw"), "|").alias("items"))


@query(rf"""
WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '```json' || chr(10) || '[{{"question": "q' || doc_id || '", "ground_truth": "it' || chr(39) || 's ' || lang || '"}}, {{"question": " ", "ground_truth": "x"}}]' || chr(10) || '```'
  WHEN 1 THEN replace('[{{~question~: ~q' || doc_id || '~, ~ground_truth~: ~' || lang || '~}}]', '~', chr(39)) ELSE 'none' END AS raw FROM documents),
j AS (SELECT doc_id, CASE WHEN json_valid({_JSON}) THEN {_JSON} ELSE replace({_JSON}, chr(39), '"') END AS t FROM r WHERE {_JSON} <> ''),
x AS (SELECT doc_id, unnest(json_extract_string(t, '$[*].question')) AS question, unnest(json_extract_string(t, '$[*].ground_truth')) AS ground_truth FROM j)
SELECT * FROM x WHERE trim(question) <> '' AND trim(ground_truth) <> ''""")
def parse_qa(spark, sf_dir):
    strict = F.format_string('```json\n[{"question": "q%d", "ground_truth": "it\'s %s"}, {"question": " ", "ground_truth": "x"}]\n```', "doc_id", "lang")
    loose = F.format_string("[{'question': 'q%d', 'ground_truth': '%s'}]", "doc_id", "lang")
    rows = _docs(spark, sf_dir).select("doc_id", _case(3, strict, loose, "none").alias("raw"))
    return rows.select("doc_id", F.explode(tx.questions_reply("raw")).alias("x")).select("doc_id", "x.question", "x.ground_truth")


@query(f"SELECT doc_id, CAST(k AS INT) AS pos, array_to_string(t[k * 462 + 1:k * 462 + 512], ' ') AS text FROM (SELECT doc_id, t, unnest({WIN.format(n='len(t)', size=512, step=462)}) AS k FROM (SELECT doc_id, string_split(text, ' ') AS t FROM documents))")
def chunk_token(spark, sf_dir):
    return chunks.by_token(_docs(spark, sf_dir))


@query(f"SELECT doc_id, CAST(k AS INT) AS pos, text[k * 824 + 1:k * 824 + 1024] AS text FROM (SELECT doc_id, text, unnest({WIN.format(n='length(text)', size=1024, step=824)}) AS k FROM documents)")
def chunk_fixed(spark, sf_dir):
    return chunks.fixed(_docs(spark, sf_dir))


WINDOW_SQL = f"FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {SENTENCES_SQL} AS s FROM documents))"


@query('SELECT doc_id, CAST(i - 1 AS INT) AS pos, s[i] AS text, array_to_string(s[greatest(1, i - 3):i + 3], \' \') AS "window" ' + WINDOW_SQL)
def sentence_window(spark, sf_dir):
    return chunks.sentence_window(_docs(spark, sf_dir))


@query("SELECT doc_id, CAST(i - 1 AS INT) AS pos, array_to_string(s[greatest(1, i - 1):i + 1], ' ') AS text " + WINDOW_SQL)
def window_replacement(spark, sf_dir):
    return chunks.sentence_window(_docs(spark, sf_dir), 1).select("doc_id", "pos", F.coalesce("window", "text").alias("text"))


@query("""
SELECT doc_id, CAST(pos AS BIGINT) AS pos, header_path, text FROM (SELECT doc_id, unnest([0, 1, 2, 3]) AS pos, unnest(['', '', 'A ' || source, '']) AS header_path, unnest(['intro ' || lang,
  '# A ' || source || chr(10) || n_chars, '## B' || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || 'size ' || n_chars, '# C' || chr(10) || 'end']) AS text FROM documents)""")
def chunk_markdown(spark, sf_dir):
    md = F.concat(F.lit("intro "), F.col("lang"), F.lit("\n# A "), F.col("source"), F.lit("\n"), F.col("n_chars"), F.lit("\n## B\n```\n# no heading\n```\nsize "), F.col("n_chars"), F.lit("\n# C\nend"))
    return chunks.markdown(_docs(spark, sf_dir).select("doc_id", md.alias("text")))


@query(r"""
WITH p AS (SELECT page_id, regexp_extract_all(html, '(?is)<(p|h[1-6]|li|b|i|u|section)(?:\s[^>]*)?>([^<]*)', 1) AS t, regexp_extract_all(html, '(?is)<(p|h[1-6]|li|b|i|u|section)(?:\s[^>]*)?>([^<]*)', 2) AS b FROM pages),
r AS (SELECT page_id, i, lower(t[i]) AS tag, trim(regexp_replace(b[i], '\s+', ' ', 'g')) AS body FROM (SELECT page_id, t, b, unnest(range(1, len(t) + 1)) AS i FROM p)),
m AS (SELECT *, coalesce(tag <> lag(tag) OVER (PARTITION BY page_id ORDER BY i), true) AS new FROM r WHERE body <> ''),
g AS (SELECT *, CAST(sum(CAST(new AS INT)) OVER (PARTITION BY page_id ORDER BY i) AS BIGINT) AS pos FROM m)
SELECT page_id, pos, any_value(tag) AS tag, string_agg(body, chr(10) ORDER BY i) AS text FROM g GROUP BY page_id, pos""")
def chunk_html(spark, sf_dir):
    return chunks.html_nodes(table(spark, sf_dir, "pages"))


@query("SELECT event_id, k AS key, k || ' ' || json_extract_string(props, '$.' || k) AS text FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def chunk_json(spark, sf_dir):
    return chunks.json_leaves(table(spark, sf_dir, "events"), "event_id", "props")


@query(f"""
WITH w AS (SELECT doc_id, CAST(k AS INT) AS pos, array_to_string(l[k * 25 + 1:k * 25 + 40], chr(10)) AS text FROM (SELECT doc_id, l, unnest({WIN.format(n='len(l)', size=40, step=25)}) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
SELECT doc_id, pos, CAST(j AS INT) AS piece, text[j * 1500 + 1:j * 1500 + 1500] AS text FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil(length(text) / 1500) AS BIGINT)))) AS j FROM w)""")
def chunk_code_lines(spark, sf_dir):
    return chunks.code_lines(_docs(spark, sf_dir))


def _level(parent: str, size: int, top: bool) -> str:
    k = WIN.format(n="length(text)", size=size, step=size)
    up = "CAST(NULL AS VARCHAR)" if top else "node_id"
    base = "CAST(doc_id AS VARCHAR)" if top else "node_id"
    return f"SELECT doc_id, {base} || '.' || k AS node_id, {up} AS parent_id, text[k * {size} + 1:k * {size} + {size}] AS text FROM (SELECT *, unnest({k}) AS k FROM {parent})"


TREE_SQL = f"WITH a AS ({_level('documents', 2048, True)}), b AS ({_level('a', 512, False)}), c AS ({_level('b', 128, False)}), n AS (SELECT *, 0 AS level FROM a UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM c)"


@query(TREE_SQL + "SELECT doc_id, node_id, parent_id, level, text FROM n")
def hierarchy_nodes(spark, sf_dir):
    return chunks.hierarchy(_docs(spark, sf_dir))


@query(TREE_SQL + "SELECT node_id, parent_id FROM n WHERE node_id NOT IN (SELECT parent_id FROM n WHERE parent_id IS NOT NULL)")
def hierarchy_leaves(spark, sf_dir):
    return chunks.leaves(chunks.hierarchy(_docs(spark, sf_dir))).select("node_id", "parent_id")


@query("""
WITH c AS (SELECT 'c' || doc_id AS node_id, 'p' || doc_id // 5 AS parent_id, doc_id FROM documents),
h AS (SELECT doc_id % 3 AS query_id, 'c' || doc_id AS node_id, n_chars / 1000 AS score FROM documents WHERE n_chars % 2 = 0 UNION ALL SELECT 3, 'c' || doc_id, 1.0 FROM documents WHERE doc_id % 7 < 4),
n AS (SELECT parent_id, count(*) AS children FROM c GROUP BY parent_id),
m AS (SELECT query_id, parent_id, avg(score) AS score FROM h JOIN c USING (node_id) JOIN n USING (parent_id) GROUP BY query_id, parent_id, children HAVING count(*) / children > 0.4)
SELECT query_id, parent_id AS node_id, round(score, 6) AS score FROM m
UNION ALL SELECT query_id, node_id, round(score, 6) FROM h JOIN c USING (node_id) WHERE (query_id, parent_id) NOT IN (SELECT query_id, parent_id FROM m)""")
def auto_merge(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    child = F.concat(F.lit("c"), F.col("doc_id")).alias("node_id")
    parent = F.concat(F.lit("p"), F.floor(F.col("doc_id") / 5))
    tree = docs.select(child, parent.alias("parent_id")).unionByName(docs.select(parent.alias("node_id"), F.lit(None).cast("string").alias("parent_id")).distinct())
    hits = docs.where("n_chars % 2 = 0").select((F.col("doc_id") % 3).alias("query_id"), child, (F.col("n_chars") / 1000).alias("score"))
    more = docs.where("doc_id % 7 < 4").select(F.lit(3).cast("long").alias("query_id"), child, F.lit(1.0).alias("score"))
    return chunks.auto_merge(hits.unionByName(more), tree).select("query_id", "node_id", F.round("score", 6).alias("score"))


@query(f"""SELECT 'prop_' || lpad(CAST(n AS VARCHAR), CAST(greatest(4, length(CAST(n AS VARCHAR))) AS INTEGER), '0') || '_' || md5(text)[1:10] AS node_id, doc_id, text FROM (
SELECT doc_id, s[i] AS text, row_number() OVER (ORDER BY doc_id, i) - 1 AS n FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {SENTENCES_SQL} AS s FROM documents)))""")
def proposition_nodes(spark, sf_dir):
    return chunks.proposition_nodes(chunks.sentence_nodes(_docs(spark, sf_dir)), "doc_id", "pos")


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*?)(</body>|\z)', 1), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_body_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.html_text("html").alias("text"))


@query(r"""SELECT page_id, CAST(i - 1 AS INT) AS part, trim(regexp_replace(regexp_replace(b[i], '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text
FROM (SELECT page_id, b, unnest(range(1, len(b) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<p(\s[^>]*)?>(.*?)(?:</p>|\z)', 2) AS b FROM pages))""")
def html_tag_docs(spark, sf_dir):
    return files.html_documents(table(spark, sf_dir, "pages"), "p")


@query("SELECT n_regionkey, string_agg(n_nationkey || ' ' || n_name || ' ' || n_regionkey, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey")
def rows_to_text(spark, sf_dir):
    return files.rows_to_text(table(spark, sf_dir, "nation"), [F.col("n_regionkey")], ["n_nationkey"])


_EXTS = (".docx", ".XLSX", ".xls", ".pdf", ".txt", ".md", ".markdown", ".HTML", ".htm", ".json", "", ".zip", ".x/file")
_PATH = f"source || '.d/' || doc_id || [{', '.join(map(repr, _EXTS))}][CAST(doc_id % 13 + 1 AS INT)]"


@query(rf"""
WITH p AS (SELECT {_PATH} AS path, lower(regexp_extract({_PATH}, '(\.[^./]+)$', 1)) AS e FROM documents)
SELECT path, CASE WHEN e = '.docx' THEN 'word' WHEN e IN ('.xlsx', '.xls') THEN 'excel' WHEN e = '.pdf' THEN 'pdf' WHEN e = '.txt' THEN 'text' WHEN e IN ('.md', '.markdown') THEN 'markdown'
    WHEN e IN ('.html', '.htm') THEN 'html' WHEN e = '.json' THEN 'json' ELSE 'generic' END AS loader,
  CASE WHEN e IN ('.md', '.markdown') THEN 'markdown' WHEN e IN ('.html', '.htm') THEN 'html' WHEN e = '.json' THEN 'json' ELSE 'text' END AS doc_type FROM p""")
def route_by_ext(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("doc_id") % 13 + 1).cast("int"))
    rows = _docs(spark, sf_dir).select(F.concat("source", F.lit(".d/"), "doc_id", ext).alias("path"))
    return rows.select("path", files.loader_of("path").alias("loader"), files.doc_type_of("path").alias("doc_type"))


@query(f"SELECT CASE WHEN n = 0 THEN 'skipped' ELSE 'ok' END AS status, count(*) AS docs, CAST(sum(n) AS BIGINT) AS nodes FROM (SELECT len({SENTENCES_SQL}) AS n FROM documents) GROUP BY ALL")
def ingest_status(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.size(tx.sentences("text")).alias("n_nodes"), F.lit(None).cast("string").alias("error"))
    return status_counts(rows)


@query("SELECT doc_id, lang, source, n_chars, CASE WHEN length(text) > 120 THEN text[1:120] || '...' ELSE text END AS sample FROM documents ORDER BY doc_id LIMIT 3")
def inspect_sample(spark, sf_dir):
    return collection.inspect(_docs(spark, sf_dir))


@query("SELECT doc_id, text FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 500) WHERE text <> ''")
def scan_limit_nonempty(spark, sf_dir):
    return collection.sample_texts(_docs(spark, sf_dir))
