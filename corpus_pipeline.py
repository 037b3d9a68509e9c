"""The corpus pipeline: five stages from raw documents to packed sequences, each over all that its predecessor kept.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows and empty tables; columns beyond those
of documents are left out, whatever their names. What becomes of such rows is said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import dart_minhash, hilbert_packing, line_runs, pii_bootstrap, toxicity_kn
from millrace.llm._common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _as_documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew; a null text stays null."""
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models don't call toxic; the labels teach the models, they don't decide.

    A null text counts as an empty one; rows with equal texts stay or go together; a null doc_id is no reason to go.
    """
    model = toxicity_kn.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity_kn.score(docs, model).filter("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more hold, but for the last holder's. All rows stay; a null text becomes an empty one.

    Rows that share a doc_id are one document; a null doc_id counts for no line, and loses those that three others hold.
    """
    return _as_documents(line_runs.drop_repeated(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one of smallest doc_id.

    Texts without words are copies only if equal; a null text counts as an empty one. Rows without a doc_id stay, and so do
    all rows that share the doc_id that stays.
    """
    return dart_minhash.drop_near_duplicates(docs).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind. All rows stay; null and empty texts stay as they are; equal rows stay equal."""
    return _as_documents(pii_bootstrap.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences: rows as op2 returns them. A null text counts as an empty one and has its one closing id."""
    import public_tokenizers

    return hilbert_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("pii", redact),
    ("packing", pack),
]

#: Trained models, signatures and an external vocabulary have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
