"""A training corpus from ``documents``: each stage reads what the one before it wrote as Parquet.

The stages, in order: the quality classifier rejects documents, exact dedup keeps one document of each text, near-dedup
keeps one document of each group of similar ones (SimHash filters, Jaccard decides), suffix-array dedup removes repeated passages, best-fit packing places what
is left into sequences. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstone.llm.common import drop_tables, stored, table, tables
from wardstone.llm.exact_dedup import exact_dedup
from wardstone.llm.packing import best_fit_packing
from wardstone.llm.quality_model import score_quality
from wardstone.llm.simhash import near_dedup
from wardstone.llm.suffix_dedup import suffix_array_dedup

#: SQL can express neither the classifier nor the stages that follow it; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None
#: Near copies: this much Jaccard similarity of the sets of shingles of so many words. op1's 3 bits bind only its query.
SIMILARITY, SHINGLE = 0.8, 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among ``docs``, does not reject.

    A null or empty text is scored as one without words; rows that repeat an id, or have a null one, are scored each.
    """
    scored = score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space left aside; nulls and empty texts are one."""
    return exact_dedup(docs).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts of SIMILARITY or more, the one of the least id; a wordless one is a group's."""
    return near_dedup(docs, similarity=SIMILARITY, shingle=SHINGLE).select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; n_chars follows the text. A document that loses all its text stays, empty.

    A null text becomes the empty one. Rows that share an id lose nothing to each other, and a row with a null id loses nothing.
    """
    left = suffix_array_dedup(docs)
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of what is left, and its place in a sequence; a null or empty text is its end alone.

    Rows that repeat an id, or have a null one, are packed each.
    """
    return best_fit_packing(docs)


STAGES = [("quality_model", quality), ("exact_dedup", exact), ("simhash", near), ("suffix_array_dedup", passages), ("best_fit_packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last returns is written to the shared folder and read again.

    What a stage has left there goes once its result is written, and with it what the stage before it returned. The last
    stage's tables stand, as its result reads them.
    """
    docs, others = table(spark, sf_dir, "documents"), set(tables())
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        drop_tables(spark, [x for x in tables()[:-1] if x not in others])
    return STAGES[-1][1](spark, docs, sf_dir)
