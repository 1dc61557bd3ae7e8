"""From raw documents to a weighted training mix, in five stages.

Each stage takes all documents its predecessor kept. Between stages the documents are written as
Parquet below the shared folder and read again, so a lost executor repeats one stage at most.

Defined cases: rows with nulls pass a stage unless its operator finds a reason against them; extra
columns are carried up to the last stage; an empty table gives an empty mix.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import decontam, linedup, mixing, neardup, quality
from ledgerlake.llm.queries import table
from ledgerlake.llm.words import free_name
from ledgerlake.sources.scratch import stored


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their later similar lines; those that lose all their words go."""
    lines, removed = (free_name(c, docs) for c in ("_lines", "_removed"))
    done = linedup.without_lines(docs, counts=(lines, removed))
    left = done.filter((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. Stages read files, so rows are known by their places there."""
    return neardup.keep_one(docs, neardup.file_places(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("near-duplicate removal", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("source mixing", mix),
]

#: The classifier cannot be expressed in SQL; the tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
