"""A training-data pipeline over documents: each stage works on the rows that its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import minhash, mixing, quality_cnn, sentencepiece, suffix_dedup
from tallyforge.llm.common import unused
from tallyforge.sources.shared import fresh_folder, remove, scope

#: SQL cannot express the classifier or the tokenizer.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on the labelled ones among them, accepts.

    Columns all stay, whatever their names. A null or empty text is scored as
    padding alone; repeated rows share their score; without labels of both
    classes every document stays; an empty table stays empty.
    """
    params = quality_cnn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = unused(docs, "score", "predicted")
    return quality_cnn.score(docs, params, names).where(F.col(names[1]) == 1).drop(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates.

    Texts without words have no duplicates and stay. Of rows that repeat an id,
    and of rows without one, one of each group stays, as minhash.deduplicate() says.
    """
    return minhash.deduplicate(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that occur anywhere else; null texts stay null, rows and columns all stay."""
    return suffix_dedup.strip(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them; those without words once, as they cost nothing."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each row the number of token ids, their hash, and that of the text they decode to; a null text counts as empty."""
    return sentencepiece.digest(docs, sentencepiece.default_model())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written to the shared folder and read again, and nothing but the last one stays there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES:
        folder = fresh_folder(spark, f"stage-{name}")
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(folder)
        remove(spark, before)
        docs, before = spark.read.parquet(folder), [folder]
    return docs
