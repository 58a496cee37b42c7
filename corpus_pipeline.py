"""The corpus pipeline: quality, near duplicates, repeated passages, mixture, packing.

Each stage gets what the one before kept and returns the columns of documents, but for the last, whose rows are packed pieces.

Nulls, empty and very long texts, repeated rows, ties and empty tables are what each stage's operator says of them: null and empty texts are scored like any other text
(``quality.keep_good``), are one group, of which one document stays (``similar.keep_one``), lose nothing (``substrings.remove_repeats``), are never taken by a mixture, having no
words (``mixing.training_order``), and are one end id in packing (``packing.pack``). An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, quality, queries, similar, substrings
from tessera.plans.scratch import written

#: Near duplicates: texts whose sets of five-word shingles agree to 0.8 and more.
NEAR = {"shingle": 5, "similarity": 0.8}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, queries.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the smallest id."""
    return similar.keep_one(docs, **NEAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the words of windows that start earlier in the corpus; texts that lose none stay as they are."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = substrings.remove_repeats(docs, with_text=True, keep=rest)
    size = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("of_n_chars"))
    given = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": size}
    return found.select(*[given.get(c, F.col(f"of_{c}")).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, in training order."""
    return mixing.training_order(docs, docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids."""
    return packing.pack(docs, queries.vocabulary(queries.WORD_BPE), capacity=2048)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packing", packed),
]

#: Learned scores, fingerprints, spans and best-fit rounds are beyond SQL; tests hold the stages to plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
