"""A corpus pipeline over the table ``documents``, in stages that each work on what the one before kept.

Every stage but the last returns the columns of ``documents`` as they came in,
also where a column bears the name of a stage's own result.  Null and empty
texts, and texts without a letter, go with the language stage; repeated rows of
one id and text count as copies, of which one stays; very long texts are read
whole.  An empty table stays empty.  Where nothing is labelled the quality stage
has learned nothing and lets everything pass.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, crf, decontaminate, langid, neardup
from plumbline.llm.shared import fresh, quoted
from plumbline.session import cut_lineage

#: A text of at least so many three-grams whose cosine with the nearest language is below this is in none of them.
#: On held-out labels such texts are one word over and over; unrelated vectors meet at about 1 / sqrt(1024) = 0.03.
ENOUGH_GRAMS = 80
LEAST_COSINE = 0.25


def _aside(docs: DataFrame, *results: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns that bear a result's name under other names, and the columns as they were."""
    names = {c: fresh(docs, f"__own_{c}") if c.lower() in results else c for c in docs.columns}
    return docs.select(*[quoted(c).alias(n) for c, n in names.items()]), [quoted(n).alias(c) for c, n in names.items()]


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language: those without a letter, and those of enough three-grams that no prototype is near to.

    A short text goes to its nearest language however small its cosine is.  If
    no language was learned, nothing is of a language.
    """
    prototypes = langid.train(docs.where(~langid.held_out("doc_id", 3, 1)))
    rows, columns = _aside(docs, "lang_pred", "score", "grams")
    told = langid.predict(rows, prototypes, keep_text=True, counted="grams")
    none = (F.col("lang_pred") == langid.UNKNOWN) | ((F.col("grams") >= ENOUGH_GRAMS) & (F.col("score") < LEAST_COSINE))
    return told.where(~none).select(*columns)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the line field finds bad, by the decision of op2; it learns from the labelled ones that are not held out."""
    held = langid.held_out("doc_id", 4, 2)
    field = crf.train(docs.where(~held), spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held))
    if not (field.weights.any() or field.moves.any()):
        return docs
    rows, columns = _aside(docs, "score", "predicted")
    return crf.score(rows, field, keep_text=True).where("predicted = 1").select(*columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return neardup.keep_one(docs).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark passages contaminate."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with the digests of ids and decoded text."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", in_a_language),
    ("quality_classifier", of_quality),
    ("near_duplicates", one_of_each),
    ("benchmark_decontamination", without_benchmark),
    ("byte_bpe", as_tokens),
]

#: Learned models and hashing decide here, which SQL cannot express; tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
