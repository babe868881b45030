"""Inverted index, ranked retrieval, dense and sparse search, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions.text import STOP_CHARACTERS, STOP_WORDS, tokens
from brindle.operators import dense, fusion, index

from .registry import query, table

_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
TOKENS_SQL = f"""list_concat(
  list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: len(x) >= 2 AND NOT list_contains({_LIST(STOP_WORDS)}, x)),
  list_filter(regexp_extract_all(coalesce(text, ''), '[一-鿿]'), lambda x: NOT list_contains({_LIST(STOP_CHARACTERS)}, x)))"""
INDEX_SQL = f"""
WITH tok AS (SELECT doc_id AS node_id, {TOKENS_SQL} AS t FROM documents),
post AS (SELECT term, node_id, count(*) AS tf FROM (SELECT node_id, unnest(t) AS term FROM tok) GROUP BY ALL),
len AS (SELECT node_id, CAST(len(t) AS BIGINT) AS dl FROM tok),
terms AS (SELECT term, count(*) AS df FROM post GROUP BY term),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
q AS (SELECT query_id, term, count(*) AS m FROM (SELECT item_id AS query_id, unnest({TOKENS_SQL}) AS term FROM benchmark) GROUP BY ALL),
mat AS (SELECT * FROM q JOIN terms USING (term) JOIN post USING (term) JOIN len USING (node_id) CROSS JOIN st)"""
TOP_SQL = "SELECT * FROM (SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s) WHERE rank <= 10"
K1, B = 1.5, 0.75
NORM = f"(1 - {B} + {B} * dl / avgdl)"


def _index(spark, sf_dir):
    return index.build_index(table(spark, sf_dir, "documents"), id_col="doc_id")


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(INDEX_SQL + "SELECT term, node_id, tf FROM post")
def postings_tf(spark, sf_dir):
    return _index(spark, sf_dir).postings.drop("dl")


@query(INDEX_SQL + "SELECT term, df FROM terms")
def doc_freq(spark, sf_dir):
    return _index(spark, sf_dir).terms


@query(INDEX_SQL + "SELECT n, round(avgdl, 6) AS avgdl, (SELECT max(dl) FROM len) AS max_dl FROM st")
def doc_len_stats(spark, sf_dir):
    found = _index(spark, sf_dir)
    return found.stats.crossJoin(found.lengths.agg(F.max("dl").alias("max_dl"))).select("n", F.round("avgdl", 6).alias("avgdl"), "max_dl")


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) GROUP BY ALL")
def tokenize_counts(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(tokens("text")).alias("term"))
    return words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


BM25_SQL = INDEX_SQL + f""",
fl AS (SELECT 0.25 * avg(ln(n - df + 0.5) - ln(df + 0.5)) AS floor FROM terms CROSS JOIN st),
s AS (SELECT query_id, node_id, round(sum(m * CASE WHEN ln(n - df + 0.5) - ln(df + 0.5) < 0 THEN floor ELSE ln(n - df + 0.5) - ln(df + 0.5) END * tf * {K1 + 1} / (tf + {K1} * {NORM})), 6) AS score FROM mat CROSS JOIN fl GROUP BY ALL HAVING score > 0)
"""


@query(BM25_SQL + TOP_SQL)
def bm25_okapi_topk(spark, sf_dir):
    return index.bm25(_index(spark, sf_dir), _queries(spark, sf_dir)).select("query_id", "node_id", "score", F.col("rank").cast("long").alias("rank"))


@query(INDEX_SQL + f""",
c AS (SELECT query_id, sum(m * ln((n + 1) / df)) AS idle FROM q JOIN terms USING (term) CROSS JOIN st GROUP BY query_id),
g AS (SELECT query_id, node_id, sum(m * ln((n + 1) / df) * tf * {K1 + 1} / ({K1} * {NORM} + tf)) AS gain FROM mat GROUP BY ALL),
s AS (SELECT query_id, node_id, round(coalesce(gain, 0) + idle, 6) AS score FROM c CROSS JOIN (SELECT node_id FROM len) LEFT JOIN g USING (query_id, node_id))
""" + TOP_SQL)  # fmt: skip
def bm25_plus_topk(spark, sf_dir):
    return index.bm25(_index(spark, sf_dir), _queries(spark, sf_dir), variant="plus").select("query_id", "node_id", "score", F.col("rank").cast("long").alias("rank"))


_L = f"(ln(n + 1) - ln(df + 0.5)) * {K1 + 1} * ({{c}} + 0.5) / ({K1} + {{c}} + 0.5)"


@query(INDEX_SQL + f""",
c AS (SELECT query_id, sum(m * {_L.format(c="0")}) AS idle FROM q JOIN terms USING (term) CROSS JOIN st GROUP BY query_id),
g AS (SELECT query_id, node_id, sum(m * ({_L.format(c=f"(tf / {NORM})")} - {_L.format(c="0")})) AS gain FROM mat GROUP BY ALL),
s AS (SELECT query_id, node_id, round(coalesce(gain, 0) + idle, 6) AS score FROM c CROSS JOIN (SELECT node_id FROM len) LEFT JOIN g USING (query_id, node_id))
""" + TOP_SQL)  # fmt: skip
def bm25_l_topk(spark, sf_dir):
    return index.bm25(_index(spark, sf_dir), _queries(spark, sf_dir), variant="l").select("query_id", "node_id", "score", F.col("rank").cast("long").alias("rank"))


TFIDF_SQL = INDEX_SQL + """,
s AS (SELECT query_id, node_id, round(sum(m * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * (1 + ln(tf)) / greatest(dl, 1)), 6) AS score FROM mat GROUP BY ALL)
"""


@query(TFIDF_SQL + TOP_SQL)
def tfidf_topk(spark, sf_dir):
    return index.tfidf(_index(spark, sf_dir), _queries(spark, sf_dir)).select("query_id", "node_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""
WITH n AS (SELECT DISTINCT doc_id AS node_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM documents),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM benchmark),
s AS (SELECT query_id, node_id, CAST(count(*) AS DOUBLE) AS score FROM q JOIN n USING (w) GROUP BY ALL)
""" + TOP_SQL)
def keyword_simple_topk(spark, sf_dir):
    nodes = table(spark, sf_dir, "documents")
    return index.keyword_hits(nodes, _queries(spark, sf_dir), id_col="doc_id").select("query_id", "node_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""
SELECT DISTINCT item_id, trim(phrase) AS phrase FROM (SELECT item_id, unnest(string_split(array_to_string(list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: CASE WHEN list_contains({_LIST(STOP_WORDS)}, w) THEN '|' ELSE w END), ' '), '|')) AS phrase FROM benchmark) WHERE trim(phrase) <> ''""")
def rake_keywords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(index.rake_phrases("text")).alias("phrase"))


@query(INDEX_SQL + "SELECT t.term, t.df, st.n FROM terms t CROSS JOIN st")
def append_rebuild_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = index.build_index(docs.where("doc_id % 2 = 0"), id_col="doc_id")
    both = index.append_nodes(first, docs.where("doc_id % 2 <> 0"), id_col="doc_id")
    return both.terms.crossJoin(both.stats.select("n"))


DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
DENSE_SQL = f"WITH s AS (SELECT b.vec_id AS query_id, a.vec_id AS node_id, round({DOT}, 6) AS score FROM embeddings a CROSS JOIN embeddings b WHERE b.vec_id % 100 = 0)"


def _dense(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"))
    asked = vectors.where("node_id % 100 = 0").select(F.col("node_id").alias("query_id"), F.col("vector").alias("q"))
    return dense.dense_hits(vectors, asked).withColumn("rank", F.col("rank").cast("long"))


@query(DENSE_SQL + TOP_SQL)
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir)


NORMAL_SQL = "SELECT query_id, node_id, rank, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN {} / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END, 6) AS score FROM (" + TOP_SQL + ") WINDOW w AS (PARTITION BY query_id)"


@query(DENSE_SQL + NORMAL_SQL.format("(score - min(score) OVER w)"))
def dense_topk_normalized(spark, sf_dir):
    return fusion.normalized(_dense(spark, sf_dir))


@query(DENSE_SQL + NORMAL_SQL.format("(max(score) OVER w - score)"))
def dense_topk_inverted(spark, sf_dir):
    return fusion.normalized(_dense(spark, sf_dir), invert=True)


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT vec_id, i, round(e[i] / (sqrt(list_sum(list_transform(e, lambda x: x * x))) + 1e-9), 6) AS x FROM (SELECT vec_id, e, unnest(range(1, 65)) AS i FROM v)""")
def l2_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(dense.l2_normalize(F.col("embedding"))).alias("i", "x"))
    return rows.select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


SIM_SQL = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, lead(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM embeddings),
sim AS (SELECT vec_id, label, CASE WHEN f IS NOT NULL THEN list_sum(list_transform(list_zip(e, f), lambda z: z[1] * z[2])) / ((sqrt(list_sum(list_transform(e, lambda x: x * x))) + 1e-9) * (sqrt(list_sum(list_transform(f, lambda x: x * x))) + 1e-9)) END AS sim FROM v)"""


def _similar(spark, sf_dir):
    return dense.adjacent_similarity(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


@query(SIM_SQL + "SELECT vec_id, label, round(sim, 6) AS sim FROM sim")
def adjacent_cosine(spark, sf_dir):
    return _similar(spark, sf_dir).select("vec_id", "label", F.round("sim", 6).alias("sim"))


PART = "CAST(coalesce(sum(CAST(b AS INT)) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS part"


@query(SIM_SQL + f""", l AS (SELECT label, quantile_cont(1 - sim, 0.95) AS lim FROM sim GROUP BY label),
m AS (SELECT vec_id, label, coalesce(round(1 - sim, 9) > round(lim, 9), false) AS b FROM sim JOIN l USING (label))
SELECT vec_id, label, b AS breaks, {PART} FROM m""")
def semantic_breaks(spark, sf_dir):
    return dense.percentile_breaks(_similar(spark, sf_dir), "label", "vec_id").select("vec_id", "label", "breaks", "part")


TOPIC_SQL = SIM_SQL + ", m AS (SELECT vec_id, label, sim IS NOT NULL AND round(avg(sim) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 9) < 0.05 AS b FROM sim)"


@query(TOPIC_SQL + "SELECT vec_id, label, b AS breaks FROM m")
def topic_breaks(spark, sf_dir):
    return dense.topic_breaks(_similar(spark, sf_dir), "label", "vec_id", threshold=0.05).select("vec_id", "label", "breaks")


@query(TOPIC_SQL + f"SELECT vec_id, label, {PART} FROM m")
def island_groups(spark, sf_dir):
    marked = dense.topic_breaks(_similar(spark, sf_dir), "label", "vec_id", threshold=0.05)
    return dense.islands(marked, "label", "vec_id", "breaks").select("vec_id", "label", "part")


SPARSE_SQL = """
WITH d AS (SELECT doc_id AS node_id, unnest(list_distinct(string_split(text, ' '))) AS token FROM documents),
q AS (SELECT item_id AS query_id, unnest(list_distinct(string_split(text, ' '))) AS token FROM benchmark),
s AS (SELECT query_id, node_id, round(CAST(count(*) AS DOUBLE), 6) AS score FROM q JOIN d USING (token) GROUP BY ALL)
"""


def _sparse(spark, sf_dir):
    """Hits by the distinct space-separated words of whole texts."""
    sparse = lambda c: F.map_from_entries(F.transform(F.array_distinct(F.split(c, " ")), lambda t: F.struct(t, F.lit(1.0).cast("float"))))
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), sparse("text").alias("sparse"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), sparse("text").alias("sparse"))
    return index.sparse_hits(nodes, asked).withColumn("rank", F.col("rank").cast("long"))


@query(SPARSE_SQL + TOP_SQL)
def sparse_dot_topk(spark, sf_dir):
    return _sparse(spark, sf_dir)


RAKE_WORDS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: NOT list_contains({_LIST(STOP_WORDS)}, w))"


@query(f"""
WITH n AS (SELECT DISTINCT doc_id AS node_id, unnest({RAKE_WORDS}) AS w FROM documents),
q AS (SELECT DISTINCT item_id AS query_id, unnest({RAKE_WORDS}) AS w FROM benchmark),
s AS (SELECT query_id, node_id, CAST(count(*) AS DOUBLE) AS score FROM q JOIN n USING (w) GROUP BY ALL)
""" + TOP_SQL)
def keyword_rake_topk(spark, sf_dir):
    hits = index.rake_hits(table(spark, sf_dir, "documents"), _queries(spark, sf_dir), id_col="doc_id")
    return hits.select("query_id", "node_id", "score", F.col("rank").cast("long").alias("rank"))


LISTS_SQL = TFIDF_SQL + """, a AS (SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s QUALIFY rank <= 10),
kn AS (SELECT DISTINCT doc_id AS node_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM documents),
kq AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM benchmark),
b AS (SELECT query_id, node_id, CAST(count(*) AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, node_id) AS rank FROM kq JOIN kn USING (w) GROUP BY query_id, node_id QUALIFY rank <= 10),
l AS (SELECT query_id, 0 AS list_idx, CAST(node_id AS VARCHAR) AS node_id, score, rank FROM a UNION ALL SELECT query_id, 1, CAST(node_id AS VARCHAR), score, rank FROM b),
"""
FUSED_SQL = "SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, node_id) AS rank FROM f QUALIFY rank <= 10"


def _lists(spark, sf_dir):
    words = _queries(spark, sf_dir)
    return [index.tfidf(_index(spark, sf_dir), words), index.keyword_hits(table(spark, sf_dir, "documents"), words, id_col="doc_id")]


def _fused(spark, sf_dir, **options):
    return fusion.hybrid(_lists(spark, sf_dir), **options).select("query_id", "node_id", "score", F.col("rank").cast("long").alias("rank"))


@query(LISTS_SQL + "f AS (SELECT query_id, node_id, round(sum(1.0 / (60 + rank)), 9) AS score, min((list_idx, rank)) AS seen FROM l GROUP BY ALL)" + FUSED_SQL)
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir)


_SCALED = "CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE score END"
_WEIGHT = "CASE list_idx WHEN 0 THEN 0.7 ELSE 0.3 END"


@query(LISTS_SQL + f"p AS (SELECT query_id, node_id, list_idx, rank, ({_SCALED}) * CAST({_WEIGHT} AS DOUBLE) AS part FROM l WINDOW w AS (PARTITION BY query_id, list_idx)), f AS (SELECT query_id, node_id, round(sum(part), 9) AS score, min((list_idx, rank)) AS seen FROM p GROUP BY ALL)" + FUSED_SQL)
def weighted_fusion(spark, sf_dir):
    return _fused(spark, sf_dir, method="weighted", weights={0: 0.7, 1: 0.3})


@query(LISTS_SQL + f"f AS (SELECT query_id, node_id, round(sum(score * CAST({_WEIGHT} AS DOUBLE)), 9) AS score, min((list_idx, rank)) AS seen FROM l GROUP BY ALL)" + FUSED_SQL)
def weighted_fusion_raw(spark, sf_dir):
    first, second = _lists(spark, sf_dir)
    part = lambda hits, i: hits.select("query_id", F.lit(i).alias("list_idx"), F.col("node_id").cast("string").alias("node_id"), "score", "rank")
    fused = fusion.weighted(part(first, 0).unionByName(part(second, 1)), {0: 0.7, 1: 0.3}, normalize=False)
    return fused.select("query_id", "node_id", "score", F.col("rank").cast("long").alias("rank"))


@query(LISTS_SQL + "f AS (SELECT query_id, node_id, max(score) AS score, min((list_idx, rank)) AS seen FROM l GROUP BY ALL)" + FUSED_SQL)
def concat_fusion(spark, sf_dir):
    return _fused(spark, sf_dir, method="concat")


@query(LISTS_SQL + "f AS (SELECT query_id, node_id, max(score) AS score FROM l GROUP BY ALL) SELECT * FROM f")
def dedup_max(spark, sf_dir):
    first, second = _lists(spark, sf_dir)
    part = lambda hits, i: hits.select("query_id", F.lit(i).alias("list_idx"), F.col("node_id").cast("string").alias("node_id"), "score", "rank")
    return fusion.dedup_max(part(first, 0).unionByName(part(second, 1))).select("query_id", "node_id", "score")


@query(SPARSE_SQL + f""", v AS (SELECT b.vec_id AS query_id, a.vec_id AS node_id, round({DOT}, 6) AS score FROM embeddings a CROSS JOIN embeddings b WHERE b.vec_id % 100 = 0),
l AS (
  SELECT query_id, 0 AS list_idx, CAST(node_id AS VARCHAR) AS node_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM v QUALIFY rank <= 10
  UNION ALL SELECT query_id, 1, CAST(node_id AS VARCHAR), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s QUALIFY rank <= 10),
f AS (SELECT query_id, node_id, round(sum(1.0 / (60 + rank)), 9) AS score, min((list_idx, rank)) AS seen FROM l GROUP BY ALL)
""" + FUSED_SQL)  # fmt: skip
def dense_sparse_rrf(spark, sf_dir):
    fused = fusion.hybrid([_dense(spark, sf_dir), _sparse(spark, sf_dir)])
    return fused.select("query_id", "node_id", "score", F.col("rank").cast("long").alias("rank"))
