"""Registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import crc_remainder, shared_dir
from .backoff_lm import score_texts
from .decontaminate import find_items
from .interleave import interleave_shards
from .language_id import fit, identify
from .licenses import MIN_DICE, scan_licenses, template_bigrams
from .near_text import near_classes
from .near_vectors import near_vectors
from .packing import pack_documents
from .secret_scan import RULES, scan_secrets
from .token_orc import document_starts, read_tokens, with_checksum, write_tokens

SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(_table(spark, sf_dir, "documents"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_id"
    )


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens"
    write_tokens(_table(spark, sf_dir, "documents"), path)
    return with_checksum(document_starts(read_tokens(spark, path)), "doc_id", "start", "n_tokens")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "shared", "item_shingles", F.round("containment", 6).alias("containment"))


def op4_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = interleave_shards(_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(_table(spark, sf_dir, "documents"), crc_remainder(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = fit(docs.where("not held_out"))
    return identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = {rule.kind: k for k, rule in enumerate(RULES)}
    joined = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.col("counts")[number[kind]].alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, "base_sha256", joined.alias("spans"))


def op8_near_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(_table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "word_no", "words", "license", "template_no", F.round("dice", 6).alias("dice"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_token_orc": op2_token_orc,
    "op3_decontaminate": op3_decontaminate,
    "op4_interleave": op4_interleave,
    "op5_backoff_lm": op5_backoff_lm,
    "op6_language_id": op6_language_id,
    "op7_secrets": op7_secrets,
    "op8_near_text": op8_near_text,
    "op9_near_vectors": op9_near_vectors,
    "op10_licenses": op10_licenses,
}


def _shingle_sql(table: str, key: str, name: str) -> str:
    return rf"""
  SELECT DISTINCT {key} AS {name}, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) AS h
  FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\p{{M}}]+'), lambda x: x <> '') AS w FROM {table})
  WHERE len(w) > 0 AND {key} IS NOT NULL"""


def _contained_sql() -> str:
    return f"""
WITH d AS ({_shingle_sql("documents", "doc_id", "doc_id")}),
i AS ({_shingle_sql("benchmark", "item_id", "item_id")}),
n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN i USING (h) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared, item_shingles, round(shared / item_shingles, 6) AS containment
FROM s JOIN n USING (item_id) WHERE shared / item_shingles >= 0.8"""


def _license_sql() -> str:
    rows = ",\n".join(
        f"({k}, '{name}', [{', '.join(repr(b) for b in bigrams)}])" for k, name, bigrams in template_bigrams()
    )
    return f"""
WITH t(template_no, license, grams) AS (VALUES {rows}),
g AS (SELECT template_no, license, len(grams) AS n, unnest(grams) AS gram FROM t),
x AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(0, len(w) - 1)) AS pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS gram FROM x WHERE len(w) > 1),
h AS (
  SELECT doc_id, template_no, license, n, pos, count(*) OVER (PARTITION BY doc_id, template_no) AS hits,
    lag(pos, 1, -1) OVER (PARTITION BY doc_id, template_no, gram ORDER BY pos) AS prev
  FROM p JOIN g USING (gram)),
c AS (SELECT * FROM h WHERE hits >= n * ({MIN_DICE} / (2 - {MIN_DICE})) * (1 - 1e-9)),
-- a window from one hit to another; s: distinct bigrams of the template in it
v AS (
  SELECT a.doc_id, a.template_no, a.license, a.n, a.pos AS start, b.pos - a.pos + 1 AS w,
    sum(CASE WHEN b.prev < a.pos THEN 1 ELSE 0 END) OVER (PARTITION BY a.doc_id, a.template_no, a.pos ORDER BY b.pos) AS s
  FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.template_no = b.template_no AND b.pos >= a.pos
    AND b.pos < a.pos + ceil(a.n / (CAST({MIN_DICE} AS DOUBLE) / (2 - {MIN_DICE})))),
d AS (SELECT *, CAST(2.0 AS DOUBLE) * s / (w + n) AS dice FROM v),
o AS (
  SELECT doc_id, dice * s AS score, dice, template_no, start, w, license FROM d WHERE dice >= {MIN_DICE}
  QUALIFY row_number() OVER (PARTITION BY doc_id, template_no, start ORDER BY dice * s DESC, w) = 1),
-- of windows that overlap the best one stands
r AS (
  SELECT doc_id, list([{{'start': start, 'w': w, 'license': license, 'template_no': template_no, 'dice': dice}}]
    ORDER BY score DESC, dice DESC, template_no, start, w) AS ranked FROM o GROUP BY doc_id),
k AS (
  SELECT doc_id, unnest(list_reduce(ranked, lambda kept, x: CASE
    WHEN len(list_filter(kept, lambda y: x[1].start <= y.start + y.w AND y.start <= x[1].start + x[1].w)) > 0 THEN kept
    ELSE list_concat(kept, x) END)) AS f
  FROM r)
SELECT doc_id, CAST(f.start AS INTEGER) AS word_no, CAST(f.w + 1 AS INTEGER) AS words, f.license AS license,
  CAST(f.template_no AS INTEGER) AS template_no, round(f.dice, 6) AS dice
FROM k"""


#: Links and components of vectors: the closure of links by a recursive query.
NEAR_VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(vec_id, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT vec_id, min(seen) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""


ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": _contained_sql(),
    "op9_near_vectors": NEAR_VECTORS_SQL,
    "op10_licenses": _license_sql(),
}
