"""The review queue and the small JSON outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.operators import apparatus as A


def queue(entries: DataFrame) -> DataFrame:
    """``status`` of each entry, in the reviewer's order of precedence, with its binding and a short excerpt."""
    d = A.entry_keys(entries)
    reviewed = F.col("override_action").isNotNull() if "override_action" in d.columns else F.lit(False)
    on = F.coalesce(A.is_anchored(), F.lit(False))
    status = F.when(reviewed, "reviewed").when(F.col("refusal_evidence") != "", "refused").when(~on, "unanchored").when(F.col("parsed").isNull(), "refused").otherwise("parsed")
    return d.select("doc_id", "page_index", "entry_key", "source_sha", status.alias("status"), A.X.source_excerpt(F.col("source_slice")).alias("excerpt"), F.col("parsed.lemma").alias("lemma"))


def html(queue_rows: DataFrame) -> DataFrame:
    """``doc_id``, ``html``: a page of cards per document. Text is escaped; page images need a raster library and aren't
    shown."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "&", "&amp;"), "<", "&lt;")
    card = F.concat(F.lit('<article id="'), F.col("entry_key"), F.lit('" class="'), F.col("status"), F.lit('"><b>'), F.col("status"), F.lit("</b> <code>"), F.col("source_sha"), F.lit("</code><p>"), esc(F.col("excerpt")), F.lit("</p></article>"))
    cards = F.array_sort(F.collect_list(F.struct("page_index", "entry_key", card.alias("c"))))
    return queue_rows.groupBy("doc_id").agg(F.concat(F.lit("<!doctype html><meta charset=utf-8>"), F.array_join(F.transform(cards, lambda x: x["c"]), "\n")).alias("html"))


def witnesses_json(table: DataFrame) -> DataFrame:
    """``doc_id``, ``content``: the witness table of each document as a JSON array, sorted by siglum."""
    row = F.struct("siglum", "base", "hand", "hand_label", "description")
    return table.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("content"))
