"""Conversations and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import chat, evaluation, index, retrievers
from brindle.operators.providers import ExtractiveModel, LetterEmbedding, OverlapJudge, RuleModel

from .models import LETTERS
from .registry import query, table
from .retrieval import BM25_SQL, FUSED_SQL, TOKENS_SQL
from .texts import SENTENCES_SQL

_TOKENS = "(CASE WHEN text = '' THEN 0 ELSE CAST(floor((length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g'))) / 1.5 + length(regexp_replace(text, '[一-鿿]', '', 'g')) / 4) AS INT) + 1 END)"


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@query(f"SELECT conv_id, turn, role, text, CAST(sum({_TOKENS}) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used_tokens FROM conversations QUALIFY used_tokens <= 300")
def memory_trim(spark, sf_dir):
    return chat.trim_memory(_messages(spark, sf_dir), 300)


@query("SELECT conv_id, chr(10) || chr(10) || '[History]' || chr(10) || string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS history FROM conversations GROUP BY conv_id")
def history_format(spark, sf_dir):
    return chat.history(_messages(spark, sf_dir))


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')"


@query(f"""
WITH n AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS w FROM benchmark),
q AS (SELECT DISTINCT conv_id, turn, unnest({_WORDS}) AS w FROM conversations WHERE role = 'user'),
h AS (SELECT conv_id, turn, item_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY count(*) DESC, item_id) AS rank FROM q JOIN n USING (w) GROUP BY conv_id, turn, item_id QUALIFY rank <= 3),
x AS (SELECT conv_id, turn, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM h JOIN benchmark USING (item_id) GROUP BY conv_id, turn)
SELECT conv_id, turn, 'Context:' || chr(10) || coalesce(context, '(no context found)') || chr(10) || chr(10) || 'Question: ' || c.text AS prompt
FROM conversations c LEFT JOIN x USING (conv_id, turn) WHERE c.role = 'user'""")
def chat_prompt(spark, sf_dir):
    asked = _messages(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", F.struct("conv_id", "turn").alias("query_id"), F.col("text").alias("query"))
    nodes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("node_id"), "text")
    hits = index.keyword_hits(nodes, asked, 3).join(nodes, "node_id")
    rows = asked.join(chat.context(hits), "query_id", "left")
    return rows.select("conv_id", "turn", chat.prompt(F.col("context"), F.col("query")).alias("prompt"))


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _nodes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text")


ANSWERS_SQL = BM25_SQL + """,
top AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s QUALIFY rank <= 5),
x AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) FILTER (WHERE text <> '') AS context, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY rank) AS nodes FROM top JOIN documents ON doc_id = node_id GROUP BY query_id),
a AS (SELECT item_id AS query_id, nodes, 'Answer from the context only.' || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(context, '(no context found)') || chr(10) || chr(10) || 'Question: ' || text AS prompt
  FROM benchmark LEFT JOIN x ON item_id = query_id),
r AS (SELECT query_id, nodes, prompt, trim(regexp_extract(prompt, 'Context:\\s*([^.!?]*[.!?]?)', 1)) AS response FROM a)
"""


def _answered(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return chat.respond(_asked(spark, sf_dir), retrievers.Bm25(index.build_index(nodes)), nodes, ExtractiveModel())


@query(ANSWERS_SQL + "SELECT query_id, response FROM r")
def chat_answers(spark, sf_dir):
    return _answered(spark, sf_dir).select("query_id", "response")


@query(ANSWERS_SQL + """SELECT query_id, 1 AS event_no, 'retrieve' AS kind, coalesce(nodes, '') AS payload FROM r
UNION ALL SELECT query_id, 2, 'prompt', CASE WHEN length(prompt) > 800 THEN prompt[1:800] || '...' ELSE prompt END FROM r
UNION ALL SELECT query_id, 3, 'answer', CASE WHEN length(response) > 800 THEN response[1:800] || '...' ELSE response END FROM r""")
def chat_trace(spark, sf_dir):
    hits = retrievers.Bm25(index.build_index(_nodes(spark, sf_dir))).retrieve(_asked(spark, sf_dir), 5)
    return chat.trace(hits, _answered(spark, sf_dir))


_LAST = "(SELECT conv_id, max(turn) AS last, coalesce(arg_max(replace(text, chr(10), ' '), turn) FILTER (WHERE role = 'user'), '') AS said FROM conversations GROUP BY conv_id)"


@query(f"SELECT conv_id, trim(said || ' And what else?') AS query FROM {_LAST}")
def chat_condensed(spark, sf_dir):
    flat = _messages(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    asked = flat.select("conv_id").distinct().withColumn("query", F.lit("And what else?"))
    return chat.condensed(asked, flat, RuleModel()).select("conv_id", "query")


@query("""WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id)
SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations WHERE conv_id % 3 <> 0
UNION ALL SELECT conv_id, last + 1, 'user', 'Why?' FROM l UNION ALL SELECT conv_id, last + 2, 'assistant', 'So.' FROM l""")
def chat_memory(spark, sf_dir):
    memory = _messages(spark, sf_dir)
    kept = chat.reset(memory, memory.where("conv_id % 3 = 0"))
    said = kept.select("conv_id").distinct().select("conv_id", F.lit(1).alias("query_id"), F.lit("Why?").alias("query"), F.lit("So.").alias("response"))
    return chat.recorded(kept, said).withColumn("turn", F.col("turn").cast("long"))


_VECTOR = LETTERS.format(x="text")
_UNIT = f"list_transform(list_zip({_VECTOR}, range(1, 27)), lambda z: z[1] / (sqrt(list_sum(list_transform({_VECTOR}, lambda x: x * x))) + 1e-9))"


@query(BM25_SQL + f""", v AS (SELECT doc_id AS node_id, {_UNIT} AS e FROM documents), u AS (SELECT item_id AS query_id, {_UNIT} AS e FROM benchmark),
d AS (SELECT query_id, node_id, round(list_sum(list_transform(list_zip(v.e, u.e), lambda z: z[1] * z[2])), 6) AS score FROM v CROSS JOIN u),
l AS (SELECT query_id, 0 AS list_idx, CAST(node_id AS VARCHAR) AS node_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM d QUALIFY rank <= 20
  UNION ALL SELECT query_id, 1, CAST(node_id AS VARCHAR), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s QUALIFY rank <= 20),
f AS (SELECT query_id, node_id, round(sum(1.0 / (60 + rank)), 9) AS score, min((list_idx, rank)) AS seen FROM l GROUP BY ALL)
""" + FUSED_SQL)
def hybrid_built(spark, sf_dir):
    found = retrievers.build_hybrid(_nodes(spark, sf_dir), embedding=LetterEmbedding(), fetch_k=20).retrieve(_asked(spark, sf_dir))
    return found.select("query_id", "node_id", "score", F.col("rank").cast("long").alias("rank"))


_QA = "(SELECT conv_id || '-' || turn % 3 AS question, text AS ground_truth FROM conversations WHERE role = 'user')"
_RES = "(SELECT conv_id || '-' || turn % 4 AS question, CASE WHEN turn % 5 = 0 THEN NULL ELSE text END AS answer, turn AS seq FROM conversations WHERE role <> 'user')"


def _pairs(spark, sf_dir):
    rows = _messages(spark, sf_dir)
    name = lambda n: F.concat_ws("-", "conv_id", F.col("turn") % n)
    qa = rows.where("role = 'user'").select(name(3).alias("question"), F.col("text").alias("ground_truth"))
    results = rows.where("role <> 'user'").select(name(4).alias("question"), F.when(F.col("turn") % 5 != 0, F.col("text")).alias("answer"), F.array("text").alias("contexts"), F.col("turn").alias("seq"))
    return qa, results


@query(f"SELECT question, ground_truth, coalesce(answer, '') AS answer FROM {_QA} JOIN (SELECT * FROM {_RES} QUALIFY row_number() OVER (PARTITION BY question ORDER BY seq DESC) = 1) USING (question)")
def align_eval(spark, sf_dir):
    return evaluation.align(*_pairs(spark, sf_dir)).drop("contexts")


@query(f"SELECT question, ground_truth FROM {_QA} WHERE question NOT IN (SELECT question FROM {_RES})")
def align_skipped(spark, sf_dir):
    return evaluation.unaligned(*_pairs(spark, sf_dir))


@query("""WITH v AS (SELECT doc_id % 50 AS query_id, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS rank, quality AS relevant FROM labels WHERE quality IS NOT NULL),
p AS (SELECT *, avg(relevant) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS p FROM v)
SELECT query_id, round(CASE WHEN sum(relevant) > 0 THEN sum(p * relevant) / sum(relevant) ELSE 0.0 END, 6) AS context_precision FROM p GROUP BY query_id""")
def context_precision(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "labels").where("quality is not null").withColumn("query_id", F.col("doc_id") % 50)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    return evaluation.context_precision(ranked.select("query_id", "rank", F.col("quality").alias("relevant")))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations WHERE text <> '' GROUP BY conv_id")
def context_extract(spark, sf_dir):
    hits = _messages(spark, sf_dir).select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text")
    return chat.context(hits).withColumnRenamed("query_id", "conv_id")


_HEAD = "(CASE WHEN length(text) > 2400 THEN text[1:2400] || '...' ELSE text END)"


@query(f"""
SELECT node_id, 'What does the text say after: ' || s[1][1:40] || '?' AS question, s[1] AS ground_truth, source_chunk
FROM (SELECT node_id, source_chunk, {SENTENCES_SQL} AS s FROM (SELECT doc_id AS node_id, text AS source_chunk, {_HEAD} AS text FROM documents WHERE trim(text) <> '')) WHERE len(s) > 0""")
def testset_questions(spark, sf_dir):
    return evaluation.questions_from(_nodes(spark, sf_dir))


_SUPPORTED = "len(list_distinct({c})) > 0 AND len(list_intersect(list_distinct({c}), {x})) / len(list_distinct({c})) >= 0.5"
EVAL_SQL = f"""
WITH b AS (SELECT item_id, b.text AS question, substr(d.text, 1, 400) || '. ' || substr(e.text, 1, 200) AS answer, [d.text, e.text, b.text] AS contexts, b.text || '. ' || substr(d.text, 1, 200) AS truth
  FROM benchmark b JOIN documents d ON d.doc_id = b.item_id JOIN documents e ON e.doc_id = b.item_id + 1),
c AS (SELECT item_id, unnest(contexts) AS text, unnest([1, 2, 3]) AS rank FROM b),
ct AS (SELECT item_id, rank, {TOKENS_SQL} AS t FROM c),
whole AS (SELECT item_id, flatten(list(t)) AS t FROM ct GROUP BY item_id),
cl AS (SELECT item_id, 'a' AS kind, unnest({SENTENCES_SQL}) AS text FROM (SELECT item_id, answer AS text FROM b) UNION ALL SELECT item_id, 't', unnest({SENTENCES_SQL}) FROM (SELECT item_id, truth AS text FROM b)),
clt AS (SELECT item_id, kind, text, {TOKENS_SQL} AS c FROM cl),
ok AS (SELECT item_id, kind, CAST({_SUPPORTED.format(c="c", x="t")} AS INT) AS v FROM clt JOIN whole USING (item_id)),
sh AS (SELECT item_id, round(avg(v) FILTER (WHERE kind = 'a'), 6) AS faithfulness, round(avg(v) FILTER (WHERE kind = 't'), 6) AS context_recall FROM ok GROUP BY item_id),
tt AS (SELECT item_id, {TOKENS_SQL} AS c FROM (SELECT item_id, truth AS text FROM b)),
hv AS (SELECT item_id, rank, CAST({_SUPPORTED.format(c="c", x="t")} AS INT) AS v FROM tt JOIN ct USING (item_id)),
hp AS (SELECT *, sum(v) OVER (PARTITION BY item_id ORDER BY rank) / rank AS p FROM hv),
pr AS (SELECT item_id, round(CASE WHEN sum(v) > 0 THEN sum(v * p) / sum(v) ELSE 0.0 END, 6) AS context_precision FROM hp GROUP BY item_id),
qv AS (SELECT item_id, {_UNIT} AS q FROM (SELECT item_id, question AS text FROM b)),
av AS (SELECT item_id, {_UNIT} AS e FROM cl WHERE kind = 'a'),
re AS (SELECT item_id, round(avg(list_sum(list_transform(list_zip(q, e), lambda z: z[1] * z[2]))), 6) AS answer_relevancy FROM av JOIN qv USING (item_id) GROUP BY item_id),
m AS (SELECT item_id, faithfulness, answer_relevancy, context_precision, context_recall FROM b JOIN sh USING (item_id) JOIN pr USING (item_id) JOIN re USING (item_id))"""
METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")


def _scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    d, e = docs.select(F.col("doc_id").alias("item_id"), F.col("text").alias("d")), docs.select((F.col("doc_id") - 1).alias("item_id"), F.col("text").alias("e"))
    rows = table(spark, sf_dir, "benchmark").join(d, "item_id").join(e, "item_id").select(
        "item_id", F.col("text").alias("question"), F.concat(F.substring("d", 1, 400), F.lit(". "), F.substring("e", 1, 200)).alias("answer"),
        F.array("d", "e", "text").alias("contexts"), F.concat("text", F.lit(". "), F.substring("d", 1, 200)).alias("ground_truth"),
    )
    return evaluation.evaluate(rows, evaluation.default_metrics(OverlapJudge(), LetterEmbedding()))


@query(EVAL_SQL + "SELECT * FROM m")
def eval_metrics(spark, sf_dir):
    return _scored(spark, sf_dir).select("item_id", *METRICS)


@query(EVAL_SQL + f"SELECT count(*) AS n, {', '.join(f'round(avg({x}), 6) AS {x}' for x in METRICS)} FROM m")
def eval_summary(spark, sf_dir):
    return evaluation.mean_scores(_scored(spark, sf_dir), list(METRICS))
