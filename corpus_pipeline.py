"""The corpus pipeline: language, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and
applies an operator of ``brindle.llm``; all but the last return the columns of
``docs``, further ones too, whatever their names. ``run`` applies them to the
table ``documents``, each result written to the shared folder as Parquet and
read again; what a stage has read is then removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm._common import BATCH_BYTES, BYTES_CONF, conf_for, remove, shared_dir
from brindle.llm.decontaminate import drop_contaminated
from brindle.llm.language_id import UNKNOWN, fit, identify
from brindle.llm.near_text import drop_near_duplicates
from brindle.llm.packing import pack_documents
from brindle.llm.secret_scan import redact_secrets

#: Languages to keep (None: all that are learnt), and the least posterior probability of a prediction.
LANGUAGES: tuple[str, ...] | None = None
LEAST_SCORE = 0.5


def known_language(
    spark: SparkSession, docs: DataFrame, sf_dir: str, languages: tuple[str, ...] | None = LANGUAGES, least_score: float = LEAST_SCORE
) -> DataFrame:
    """Keeps documents that the classifier finds in a wanted language with enough certainty, and writes that language to ``lang``.

    The model is learnt from the rows with a text and a ``lang``. A null text, or
    one without a letter, has no language and goes. Repeated rows are judged
    each. An empty table stays empty; without any labelled row nothing is known
    and all rows go.
    """
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    found = identify(named, fit(docs.select("text", "lang"))).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    if languages is not None:
        found = found.where(F.col("lang_pred").isin(*languages))
    lang = F.col("lang_pred").cast(docs.schema["lang"].dataType).alias("lang")
    return found.select(*[lang if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least id of each class of near duplicates.

    Rows with a null id stay; of rows with one id one stays (see
    ``drop_near_duplicates``). An empty table stays empty.
    """
    return drop_near_duplicates(docs)


def no_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain an item of the table ``benchmark``.

    Null and empty texts contain none; rows with a null id stay; rows with one
    id go together. An empty table stays empty.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; ``n_chars`` follows the text. Null texts stay null, every row stays, an empty table stays empty."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into token sequences: one row for each piece, with its token ids.

    A null or empty text is its end id alone; repeated rows are packed each; an
    empty table gives no rows. Workers of earlier stages are there still, so it
    takes less memory: a smaller cache and, from here on in this session, smaller
    Arrow batches (``run`` puts the setting back).
    """
    spark.conf.set(BYTES_CONF, BATCH_BYTES)
    return pack_documents(docs, max_chunks=200_000, group_bytes=1_500_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("decontaminate", no_benchmark_leaks),
    ("secret_scan", no_secrets),
    ("pack", packed),
]

#: Classifiers, sampling and tokenization are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    with conf_for(spark, {BYTES_CONF: spark.conf.get(BYTES_CONF)}):
        for _, stage in STAGES:
            path = shared_dir(spark)
            stage(spark, docs, sf_dir).write.parquet(path)
            if before is not None:
                remove(spark, before)
            docs, before = spark.read.parquet(path), path
    return docs
