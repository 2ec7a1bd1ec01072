"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.llm import copies, language, packing, secrets, substrings
from tessaline.llm.common import Written, documents, free_name

#: A document whose best language is less likely than this is rejected.
LEAST_LANGUAGE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay if a language is told from their text.

    The classifier learns from the stage's own labelled rows. Texts that are null or have
    no letter go. Where no row has a language nothing can be told, and all rows stay.
    """
    model = language.fit(docs.select("doc_id", "text", "lang"))
    if not model.languages:
        return docs
    told = language.identify(docs, model, lang="__stage_lang", score="__stage_score")
    good = (F.col("__stage_lang") != language.UNKNOWN) & (F.col("__stage_score") >= LEAST_LANGUAGE)
    return told.filter(good).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies (shingle similarity 0.8 or more) stays, the one with the smallest id.

    SimHash fingerprints link the texts; the similarity of each pair of a group is checked, and MinHash bands add the
    pairs of that similarity that the fingerprints don't link.
    """
    return copies.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 20-word windows that also start earlier are cut; documents left without a word go.

    `n_chars` follows the text.
    """
    n_words, n_removed = (free_name(c, docs.columns) for c in ("n_words", "n_removed"))
    cut = substrings.drop_repeats(docs)
    return cut.filter(F.col(n_words) > F.col(n_removed)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret becomes its kind in brackets; `n_chars` follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all token pieces in sequences."""
    return packing.op2(docs)


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]
#: Language models, XXH64 fingerprints and token ids are beyond SQL; a brute-force version tests the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in their order, over `documents`. A stage's documents go when the next one's are written."""
    docs, last = documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            written = Written(docs, "documents")
            if last:
                last.drop()
            docs, last = written.df, written
    return docs
