"""Corpus preparation: five stages, each over all that the one before kept.

Language identification drops documents whose language stays unknown; of every
group of near duplicates one document stays; documents that share a window with
the benchmark go; personal data in the rest is replaced in the text; the mix
says how many words to take of each document. All stages but the last return
the columns of ``documents``, whatever others the table has are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm import decontaminate, language_id, mixing, ngram_join, pii
from presswork.llm.common import materialize, read_table

#: The columns of ``documents``.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Texts whose language scores less than this are rejected (clean texts score above 0.4).
MIN_LANGUAGE_SCORE = 0.2


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a recognised language; a null text and one without letters go."""
    return language_id.keep_identified(_columns(docs), MIN_LANGUAGE_SCORE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the least id."""
    return ngram_join.drop_near(_columns(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that share no window of ten words with the benchmark."""
    return decontaminate.decontaminate(_columns(docs), read_table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows, all documents stay."""
    return pii.redact(_columns(docs)).withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words to take of each document (the columns of query op3)."""
    return mixing.mixing_report(_columns(docs))


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
]

#: Profiles, n-gram tries and co-occurrence have no form in SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
