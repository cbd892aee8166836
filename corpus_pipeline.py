"""The corpus pipeline: toxic documents go, lines and documents lose their copies, sources are mixed, texts become tokens.

Each stage takes the documents its predecessor kept; all but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrow.llm import bpe, jaccard_join, line_dedup, mixing, toxicity
from loomrow.llm.common import quoted, table, written


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the field learns from the labels of documents that may be learnt from."""
    return toxicity.without_toxic(docs, toxicity.learnt(docs, table(spark, sf_dir, "labels")))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat earlier ones go; every document stays, with the length of its text put right."""
    cleaned = line_dedup.dedup_lines(docs, counts=False)
    columns = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return cleaned.withColumns(columns).select(*map(quoted, docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return jaccard_join.without_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text."""
    return bpe.encoded(docs.select("doc_id", "source", "text"), bpe.default_tokenizer()).select(
        "doc_id", "source", F.size("tokens").cast("long").alias("n_tokens"), "tokens"
    )


STAGES = [
    ("toxicity", toxic_documents),
    ("line_dedup", repeated_lines),
    ("jaccard_join", near_copies),
    ("mixing", source_mix),
    ("bpe", tokens),
]

#: SQL has no way to train the field, nor to merge by rank: the stages are tested against plain versions instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
