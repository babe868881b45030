"""Chunking by models, semantics and document type."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions.text import sentences
from brindle.operators import chunks, modeled
from brindle.operators.providers import LetterEmbedding, RuleModel

from .registry import query, table
from .texts import SENTENCES_SQL, WIN

_ITEMS = f"SELECT doc_id, {SENTENCES_SQL} AS s FROM documents"
_LINE = r"regexp_replace({}, '\s*\n\s*', ' ', 'g')"
_CUT = "CASE WHEN length({x}) > {n} THEN {x}[1:{n}] || '...' ELSE {x} END"
SHOWN = _CUT.format(x=_LINE.format("x"), n=300)
#: Ends of groups, the groups, short ones joined to the one before, long ones cut between items.
GROUPS = "list_transform(range(1, len(ends) + 1), lambda k: s[coalesce(ends[k - 1], 0) + 1:ends[k]])"
MERGED = "list_reduce(list_transform(groups, lambda g: [g]), lambda done, x: CASE WHEN {small} THEN list_concat(done[:len(done) - 1], [list_concat(done[len(done)], x[1])]) ELSE list_concat(done, x) END)"
PIECES = """flatten(list_transform(groups, lambda g: list_reduce(list_transform(g, lambda y: [[y]]), lambda acc, y: CASE
  WHEN {used} + {size} > {limit} THEN list_concat(acc, y) ELSE list_concat(acc[:len(acc) - 1], [list_concat(acc[len(acc)], y[1])]) END)))"""
BY_CHARS = PIECES.format(used="length(array_to_string(acc[len(acc)], ''))", size="length(y[1][1])", limit=2000)


def est_sql(x: str) -> str:
    other = f"regexp_replace({x}, '[一-鿿]', '', 'g')"
    return f"(CASE WHEN {x} = '' THEN 0 ELSE CAST(floor((length({x}) - length({other})) / 1.5 + length({other}) / 4) AS INT) + 1 END)"


def by_tokens(limit: int) -> str:
    return PIECES.format(used=f"list_sum(list_transform(acc[len(acc)], lambda z: {est_sql('z')}))", size=est_sql("y[1][1]"), limit=limit)


def node_sql(prefix: str, separator: str) -> str:
    number = "CAST(doc_id * 10000 + pos AS VARCHAR)"
    return f"""t AS (SELECT doc_id, CAST(i - 1 AS INT) AS pos, trim(array_to_string(p[i], '{separator}')) AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM p))
SELECT doc_id, pos, '{prefix}_' || lpad({number}, CAST(greatest(4, length({number})) AS INTEGER), '0') || '_' || md5(text)[1:10] AS node_id, text FROM t WHERE text <> ''"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(f"""
WITH b AS (SELECT doc_id, s, unnest(range(0, greatest(len(s) - 2, 0) + 1, 8)) AS o FROM ({_ITEMS}) WHERE len(s) > 0)
SELECT doc_id, CAST(floor(o / 8) AS INT) AS batch, CASE WHEN len(s[o + 1:o + 9]) > 1 THEN 'For each sentence but the last, does a new topic begin after it? Answer with a JSON list of booleans.' || chr(10)
  || array_to_string(list_transform(s[o + 1:o + 9], lambda x, i: '[' || i || '] ' || {SHOWN}), chr(10)) END AS prompt FROM b""")
def llm_prompts(spark, sf_dir):
    return modeled.boundary_batches(_docs(spark, sf_dir)).select("doc_id", "batch", "prompt")


@query(f"SELECT doc_id, CAST(i - 1 AS INT) AS gap, length({SHOWN}) % 5 = 0 AS ends FROM (SELECT doc_id, i, s[i] AS x FROM (SELECT doc_id, s, unnest(range(1, len(s))) AS i FROM ({_ITEMS})))")
def llm_boundaries(spark, sf_dir):
    return modeled.boundaries(_docs(spark, sf_dir), RuleModel()).select("doc_id", F.posexplode("flags").alias("gap", "ends"))


@query(f"""
WITH e AS (SELECT doc_id, s, list_concat(list_filter(range(1, len(s)), lambda i: length(list_transform([s[i]], lambda x: {SHOWN})[1]) % 5 = 0), [len(s)]) AS ends FROM ({_ITEMS}) WHERE len(s) > 0),
g AS (SELECT doc_id, {GROUPS} AS groups FROM e),
m AS (SELECT doc_id, {MERGED.format(small="length(array_to_string(x[1], '')) < 200")} AS groups FROM g),
p AS (SELECT doc_id, {BY_CHARS} AS p FROM m),
{node_sql("llm", "")}""")
def chunk_llm(spark, sf_dir):
    return modeled.split_by_llm(_docs(spark, sf_dir), RuleModel())


STATEMENTS_SQL = rf"""
q AS (SELECT doc_id, i AS par, regexp_replace(ps[i], '^\s+|\s+$', '', 'g') AS text FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\n\s*\n') AS ps FROM documents))),
f AS (SELECT doc_id, par, CASE WHEN length(text) < 30 OR len({SENTENCES_SQL}) = 0 THEN [text] ELSE {SENTENCES_SQL} END AS xs FROM q WHERE text <> ''),
st AS (SELECT doc_id, CAST(par - 1 AS INT) AS par, CAST(i - 1 AS INT) AS n, xs[i] AS text FROM (SELECT doc_id, par, xs, unnest(range(1, len(xs) + 1)) AS i FROM f))"""


@query(f"WITH {STATEMENTS_SQL} SELECT * FROM st")
def propositions(spark, sf_dir):
    return modeled.propositions(modeled.paragraphs_of(_docs(spark, sf_dir)), RuleModel())


LETTERS = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: CAST(length(lower({x})) - length(replace(lower({x}), c, '')) AS DOUBLE))"
SIM = """CASE WHEN f IS NOT NULL THEN list_sum(list_transform(list_zip(e, f), lambda z: z[1] * z[2]))
  / ((sqrt(list_sum(list_transform(e, lambda x: x * x))) + 1e-9) * (sqrt(list_sum(list_transform(f, lambda x: x * x))) + 1e-9)) END"""
STATEMENT = _CUT.format(x=_LINE.format("{c}"), n=200)


@query(f"""
WITH {STATEMENTS_SQL},
r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY par, n) - 1 AS n, text, {LETTERS.format(x="text")} AS e FROM st),
l AS (SELECT *, lead(e) OVER w AS f, lead(text) OVER w AS next FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
c AS (SELECT *, {SIM} AS sim FROM l),
b AS (SELECT *, sim IS NOT NULL AND round(avg(sim) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 9) < 0.75 AS low FROM c),
d AS (SELECT *, low AND length({STATEMENT.format(c="text")}) < length({STATEMENT.format(c="next")}) AS cut FROM b),
e AS (SELECT doc_id, list(text ORDER BY n) AS s, list_concat(coalesce(list(n + 1 ORDER BY n) FILTER (WHERE cut), []), [count(*)]) AS ends FROM d GROUP BY doc_id),
g AS (SELECT doc_id, {GROUPS} AS groups FROM e),
m AS (SELECT doc_id, {MERGED.format(small="len(x[1]) < 2")} AS groups FROM g),
p AS (SELECT doc_id, {BY_CHARS} AS p FROM m),
{node_sql("agentic", " ")}""")
def chunk_agentic(spark, sf_dir):
    return modeled.split_agentic(_docs(spark, sf_dir), RuleModel(), LetterEmbedding(), threshold=0.75)


SEMANTIC_SQL = f"""
w AS (SELECT doc_id, i - 1 AS pos, s[i] AS text, array_to_string(s[greatest(1, i - 1):i + 1], ' ') AS ctx FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM ({_ITEMS}))),
v AS (SELECT doc_id, pos, text, {LETTERS.format(x="ctx")} AS e FROM w),
l AS (SELECT *, lead(e) OVER (PARTITION BY doc_id ORDER BY pos) AS f FROM v),
c AS (SELECT doc_id, pos, text, {SIM} AS sim FROM l),
lim AS (SELECT doc_id, quantile_cont(1 - sim, 0.95) AS lim FROM c GROUP BY doc_id),
k AS (SELECT doc_id, pos, text, coalesce(round(1 - sim, 9) > round(lim, 9), false) AS b FROM c JOIN lim USING (doc_id)),
i AS (SELECT doc_id, pos, text, coalesce(sum(CAST(b AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM k),
n AS (SELECT doc_id, CAST(part AS INT) AS pos, string_agg(text, ' ' ORDER BY pos) AS text FROM i GROUP BY doc_id, part)"""


@query(f"WITH {SEMANTIC_SQL} SELECT * FROM n")
def chunk_semantic(spark, sf_dir):
    return chunks.semantic(_docs(spark, sf_dir), LetterEmbedding())


@query(f"""
WITH {SEMANTIC_SQL},
g AS (SELECT doc_id, list([text] ORDER BY pos) AS groups FROM n GROUP BY doc_id),
m AS (SELECT doc_id, {MERGED.format(small=est_sql("array_to_string(x[1], ' ')") + " < 50")} AS groups FROM g),
t AS (SELECT doc_id, i - 1 AS pos, array_to_string(groups[i], ' ') AS text FROM (SELECT doc_id, groups, unnest(range(1, len(groups) + 1)) AS i FROM m)),
h AS (SELECT doc_id, pos, [{SENTENCES_SQL}] AS groups FROM t),
p AS (SELECT doc_id, pos, {by_tokens(512)} AS p FROM h WHERE len(groups[1]) > 0)
SELECT doc_id, CAST(pos AS INT) AS pos, CAST(i - 1 AS INT) AS piece, array_to_string(p[i], ' ') AS text FROM (SELECT doc_id, pos, p, unnest(range(1, len(p) + 1)) AS i FROM p)""")
def chunk_semantic_dual(spark, sf_dir):
    return chunks.semantic_dual(_docs(spark, sf_dir), LetterEmbedding())


def _sentence_sql(size: int, overlap: int) -> str:
    most = 4 * (size - 1)
    pieces = f"list_transform(range(0, greatest(CAST(ceil(length(x) / {most}) AS INT) - 1, 0) + 1), lambda k: x[k * {most} + 1:k * {most} + {most}])"
    tail = f"list_max(list_filter(range(0, len(b) + 1), lambda k: coalesce(list_sum(list_transform(b[len(b) - k + 1:], lambda z: {est_sql('z')})), 0) <= {overlap}))"
    return f"""
WITH c AS (SELECT doc_id, [flatten(list_transform(s, lambda x: CASE WHEN {est_sql("x")} > {size} THEN {pieces} ELSE [x] END))] AS groups FROM ({_ITEMS}) WHERE len(s) > 0),
p AS (SELECT doc_id, {by_tokens(size)} AS p FROM c),
g AS (SELECT doc_id, i, p[i] AS g, CASE WHEN i > 1 THEN p[i - 1] ELSE [] END AS b FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM p))
SELECT doc_id, CAST(i - 1 AS INT) AS pos, array_to_string(list_concat(b[len(b) - {tail} + 1:], g), ' ') AS text FROM g"""


@query(_sentence_sql(256, 0))
def chunk_sentence(spark, sf_dir):
    return chunks.by_sentence(_docs(spark, sf_dir), 256)


@query(_sentence_sql(256, 50))
def chunk_sentence_overlap(spark, sf_dir):
    return chunks.by_sentence(_docs(spark, sf_dir), 256, 50)


@query(f"""
SELECT doc_id, CAST(k AS BIGINT) AS pos, array_to_string(t[k * 462 + 1:k * 462 + 512], ' ') AS text FROM (SELECT doc_id, t, unnest({WIN.format(n='len(t)', size=512, step=462)}) AS k FROM (SELECT doc_id, string_split(text, ' ') AS t FROM documents WHERE doc_id % 3 = 0))
UNION ALL SELECT doc_id, k, text[k * 824 + 1:k * 824 + 1024] FROM (SELECT doc_id, text, unnest({WIN.format(n='length(text)', size=1024, step=824)}) AS k FROM documents WHERE doc_id % 3 = 1)
UNION ALL SELECT doc_id, i - 1, s[i] FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM ({_ITEMS} WHERE doc_id % 3 = 2))""")
def auto_split(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("token"), F.lit("simple"), F.lit("sentence_window")), (F.col("doc_id") % 3 + 1).cast("int"))
    return chunks.auto_split(_docs(spark, sf_dir).withColumn("doc_type", kind), None, ("token", "simple", "sentence_window"))


@query("""
SELECT doc_id, path, path || ' ' || value AS text FROM (SELECT doc_id, unnest(['id', 'tags 0', 'tags 1', 'size chars', 'size even']) AS path,
  unnest([CAST(doc_id AS VARCHAR), lang, source, CAST(n_chars AS VARCHAR), CAST(n_chars % 2 = 0 AS VARCHAR)]) AS value FROM documents)""")
def chunk_json_paths(spark, sf_dir):
    size = F.struct(F.col("n_chars").alias("chars"), (F.col("n_chars") % 2 == 0).alias("even"))
    rows = _docs(spark, sf_dir).select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), F.array("lang", "source").alias("tags"), size.alias("size"))).alias("json"))
    return chunks.json_paths(rows, "doc_id", "json").select("doc_id", "path", "text")


@query("""
SELECT doc_id, CAST(pos AS INT) AS pos, 0 AS piece, text FROM (SELECT doc_id, unnest([0, 1, 2]) AS pos, unnest(['import ' || lang || chr(10), '@once' || chr(10) || 'def f_' || doc_id || '(x):' || chr(10) || '    return x' || chr(10),
  'class C_' || doc_id || ':' || chr(10) || '    def size(self):' || chr(10) || '        return ' || n_chars]) AS text FROM documents)""")
def chunk_code(spark, sf_dir):
    code = F.format_string("import %s\n\n@once\ndef f_%d(x):\n    return x\n\nclass C_%d:\n    def size(self):\n        return %d", "lang", "doc_id", "doc_id", F.col("n_chars").cast("long"))
    return chunks.code_blocks(_docs(spark, sf_dir).select("doc_id", code.alias("text")))


@query(f"""
WITH g AS (SELECT doc_id, list_transform(s, lambda x: [x]) AS groups FROM ({_ITEMS}) WHERE len(s) > 0),
m AS (SELECT doc_id, {MERGED.format(small="length(array_to_string(x[1], '')) < 100")} AS groups FROM g),
p AS (SELECT doc_id, {PIECES.format(used="length(array_to_string(acc[len(acc)], ''))", size="length(y[1][1])", limit=300)} AS p FROM m)
SELECT doc_id, CAST(i - 1 AS INT) AS pos, array_to_string(p[i], '') AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)""")
def merge_small_split_large(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(F.array(F.transform(sentences("text"), lambda s: F.array(s)))).alias("groups"))
    tidy = rows.select("doc_id", F.posexplode(chunks.tidy_groups(F.col("groups"), 100, 300)).alias("pos", "group"))
    return tidy.select("doc_id", "pos", F.array_join("group", "").alias("text"))
