"""Review files: one JSON object with a format version and records by entry key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.operators.apparatus import ATTRIBUTION, PARSED

FORMAT = "variorum-overrides/1"
_READING = "struct<text:string,wits:array<string>,editors:array<string>,qualifiers:array<string>>"
RECORD = f"struct<source_sha:string,source_excerpt:string,action:string,lemma:string,lemma_wits:array<string>,lemma_editors:array<string>,lemma_qualifiers:array<string>,readings:array<{_READING}>,comments:array<string>,note:string>"
_FILE = f"format string, entries map<string,{RECORD}>"


def _list(c):
    return F.coalesce(c, F.array().cast("array<string>"))


def _attribution(wits, editors, qualifiers):
    none = F.array().cast("array<string>")
    return F.struct(_list(wits).alias("witnesses"), _list(editors).alias("editors"), _list(qualifiers).alias("qualifiers"), none.alias("sources"), none.alias("references")).cast(ATTRIBUTION)


def load(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``doc_id``, ``entry_key``, ``action``, ``source_sha``, ``reviewed`` of the files (``doc_id``, ``content``). A file of
    another version and a record that can't be bound or used fail the job, before anything is replayed."""
    f = files.select("doc_id", F.from_json("content", _FILE).alias("f"))
    version = F.col("f.format")
    f = f.withColumn("entries", F.when(version.eqNullSafe(FORMAT) & F.col("f.entries").isNotNull(), F.col("f.entries")).otherwise(F.raise_error(F.concat(F.lit("not a review file of version " + FORMAT + ": "), F.coalesce(version, F.lit("none"))))))
    e = f.select("doc_id", F.explode("entries").alias("entry_key", "r"))
    bad = ~F.coalesce(F.col("r.action").isin("parse", "verbatim"), F.lit(False)) | ~F.coalesce(F.length("r.source_sha") == 12, F.lit(False)) | (F.col("r.action") == "parse") & F.col("r.lemma").isNull()
    action = F.when(bad, F.raise_error(F.concat(F.lit("unusable review record "), F.col("entry_key")))).otherwise(F.col("r.action"))
    readings = F.transform(F.coalesce("r.readings", F.array().cast(f"array<{_READING}>")), lambda x: F.struct(F.coalesce(x["text"], F.lit("")).alias("text"), _attribution(x["wits"], x["editors"], x["qualifiers"]).alias("attribution")))
    parsed = F.struct(F.col("r.lemma").alias("lemma"), _attribution(F.col("r.lemma_wits"), F.col("r.lemma_editors"), F.col("r.lemma_qualifiers")).alias("lemma_attribution"), readings.alias("readings"), _list(F.col("r.comments")).alias("comments")).cast(PARSED)
    return e.select("doc_id", "entry_key", action.alias("action"), F.col("r.source_sha").alias("source_sha"), F.when(F.col("r.action") == "parse", parsed).alias("reviewed"))


def export(records: DataFrame) -> DataFrame:
    """``doc_id``, ``content``: a review file per document, of rows with ``entry_key`` and ``record`` (``RECORD``)."""
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct("entry_key", F.to_json(F.col("record").cast(RECORD)).alias("j")))))
    body = F.concat_ws(",", F.transform(F.map_entries("m"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])))
    return records.groupBy("doc_id").agg(m.alias("m")).select("doc_id", F.concat(F.lit('{"format":"' + FORMAT + '","entries":{'), body, F.lit("}}")).alias("content"))
