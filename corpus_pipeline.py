"""A training corpus from raw documents: language ID, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with their columns; the last one returns the
packed pieces. Between stages the documents are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import table, written
from listwright.llm.decontamination import decontaminate
from listwright.llm.language import SURE_WORDS, UNKNOWN, identified, learn
from listwright.llm.line_dedup import dedup_lines
from listwright.llm.near_dedup import drop_near_duplicates
from listwright.llm.packing import pack
from listwright.session import ship_package

#: Documents of at least SURE_WORDS words whose language is less sure than this are rejected; what is in one language is
#: far above it. Shorter ones are unsure for want of evidence, which is no reason to reject them.
LEAST_SCORE = 0.5
#: Documents of at least SURE_WORDS words or SURE_LETTERS letters, of whose letters the model knows a smaller share, are
#: rejected. This does not depend on how many languages were learned, nor on white space.
LEAST_KNOWN, SURE_LETTERS = 0.5, 5 * SURE_WORDS


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or text, and longer ones whose language is not sure or whose letters are not
    known. Words are those of the model, runs of letters."""
    ship_package(spark)
    found = identified(docs, learn(docs), spent=True)
    words, letters, known = (F.col(f"answer.{c}") for c in ("n_words", "n_letters", "n_known"))
    sure = (words < SURE_WORDS) | (F.col("answer.score") >= LEAST_SCORE)
    is_known = ((words < SURE_WORDS) & (letters < SURE_LETTERS)) | (known >= letters * LEAST_KNOWN)
    return found.filter((F.col("answer.lang") != UNKNOWN) & sure & is_known).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that are near an earlier one; documents that lose all their text go."""
    ship_package(spark)
    return _counted(dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    ship_package(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages of the benchmark; documents that are mostly such passages go."""
    ship_package(spark)
    return _counted(decontaminate(docs, table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the tokens of all documents in sequences."""
    ship_package(spark)
    return pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can express neither the tokenizer nor the edit join at this size; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"after-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
