"""The corpus pipeline: quality rules, language ID, exact dedup, near-dedup, packing, one after another.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents``. ``run`` writes each stage's result as a table in the shared folder and rereads it, so every stage
starts from files and not from its predecessors' lineage.

Edge cases. A null or empty text, and one without a word, goes in the first stage, one without a letter in the second
at the latest; so later stages see none. A null id is kept, is copy of nothing but an exact copy, and is packed. Rows
that repeat id and text are exact copies and one stays; rows that repeat an id with other texts are kept or go together
as near copies and are packed one by one. Of copies the least id stays. Very long texts are judged and packed whole.
Columns beyond those of ``documents`` pass through all stages but the last; the last returns ``bin_id``, ``doc_id``, ``piece``,
``start``, ``length`` and ``tokens``, whatever the input's other columns are called. An empty table gives an empty result. A
corpus without a single label in ``lang`` raises in the second stage: it declares no language to keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from variorum.llm.common import written
from variorum.llm.exact import exact_dedup
from variorum.llm.langid import language_filter, train
from variorum.llm.packing import pack
from variorum.llm.repetition import quality_filter
from variorum.llm.simhash import near_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a repetition rule go."""
    return quality_filter(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are unlikely in every language that the corpus declares (in ``lang``), or in none with confidence, go."""
    return language_filter(docs, train(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the least id stays."""
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays."""
    return near_dedup(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: the tokens of the documents' pieces, and which pieces share a sequence (``bin_id``)."""
    return pack(docs)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("exact_copies", exact_copies), ("near_copies", near_copies), ("best_fit_packing", packing)]

#: Fingerprints, naive Bayes and packing have no SQL form; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
