"""A corpus pipeline: every stage reads what its predecessor kept.

Language identification, near-duplicates, benchmark decontamination, personal data, SentencePiece ids. All stages
but the last return the columns of documents; a stage that filters only lets go of what its operator rejects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import decontaminate, language, minhash, personal, pieces
from netloom.llm.common import saved

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def beside(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], rows: str, *made: str) -> DataFrame:
    """The rows of ``docs`` that pass ``rows``, a condition on what the operator adds; columns of the same names stay as they were."""
    mine = {c: f"__kept_{c}" for c in docs.columns if c.lower() in made}
    out = operator(docs.withColumnsRenamed(mine)).where(rows).drop(*made)
    return out.withColumnsRenamed({new: old for old, new in mine.items()}).select(*[f"`{c}`" for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no text or no letter) go; nothing is left of a table where no language was learned.

    Rows are judged by their text alone: null ids and repeated rows stay. Ties go to the first language by name. An empty table stays empty.
    """
    model = language.fit(docs)
    return beside(docs, lambda d: language.identified(d, model), f"lang_pred <> '{language.UNKNOWN}'", "lang_pred", "score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id (five words, similarity 0.8).

    One row of those that repeat an id stays. Rows without an id are compared too and give way to rows with one; texts without a word are linked with
    nothing. An empty table stays empty.
    """
    return minhash.deduplicated(docs, width=5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts are clean; rows are judged by their text alone. With an empty benchmark, or one without a word, all stay.
    """
    index = decontaminate.fit(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return beside(docs, lambda d: decontaminate.searched(d, index), "NOT contaminated", "contaminated", "item_ids", "common")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind; n_chars follows the new text (null for a null text).

    Every row stays, with or without an id; rows that repeat an id are masked each by its own spans.
    """
    masked = personal.masked(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds SentencePiece ids and whether they decode to the text. Every row stays; null and empty texts have no ids."""
    return pieces.encoded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("personal_data", mask_personal_data),
    ("sentencepiece", encode),
]
#: No SQL: the first stage is a learned classifier and the last an encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, name)
    return docs
