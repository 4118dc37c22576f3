"""Layered bands to blocks: layer names, printed footers, degenerate pages and their folios."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from variorum.functions import text as X

LAYERS = {"apparatus": "apparatus", "heading": "heading", "notes": "notes", "page_number": "page_number", "running_head": "running_head", "text": "text", "translation": "translation"}
LATIN = {"notes": "apparatus", "translation": "text"}


def layer_of_band(band: Column, text_lang: str = "grc") -> Column:
    """The band's layer, unknown where it has no name here; a Latin edition's translation is its text and its notes
    are its apparatus."""
    names = LAYERS | (LATIN if text_lang == "la" else {})
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[band], F.lit("unknown"))


def is_apparatus_like(c: Column) -> Column:
    return F.contains(c, F.lit(" : ")) | F.contains(c, F.lit(" | ")) | F.contains(c, F.lit("∥")) | F.contains(c, F.lit("]"))


def tail_of(c: Column) -> Column:
    """The last line that isn't blank, white space collapsed; null where all are."""
    lines = F.filter(F.transform(F.split(c, "\n"), X.normalise), lambda x: x != "")
    return F.try_element_at(lines, F.lit(-1))


def footers(blocks: DataFrame, group: tuple[str, ...] = ("doc_id",), least: int = 3, chars: int = 25) -> DataFrame:
    """Last lines that repeat in ``least`` or more foot bands of a document, are long enough for a sentence and aren't
    apparatus: ``tail``, ``n``. Combined map-side."""
    t = blocks.select(*group, tail_of(F.col("text")).alias("tail")).where((F.length("tail") >= chars) & ~is_apparatus_like(F.col("tail")))
    return t.groupBy(*group, "tail").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def strip_footers(blocks: DataFrame, found: DataFrame, group: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``body`` and ``footer`` of each block: trailing lines that are footers of its document go to the footer."""
    sets = found.groupBy(*group).agg(F.collect_set("tail").alias("__tails"))
    lines = F.split("text", "\n")
    solid = F.filter(F.transform(F.sequence(F.lit(1), F.size(lines)), lambda i: F.struct(i.alias("i"), X.normalise(F.element_at(lines, i)).alias("s"))), lambda x: x["s"] != "")
    last = F.coalesce(F.array_max(F.transform(F.filter(solid, lambda x: ~F.coalesce(F.array_contains("__tails", x["s"]), F.lit(False))), lambda x: x["i"])), F.lit(0))
    d = blocks.join(sets, list(group), "left").withColumn("__last", last)
    return d.withColumn("body", F.array_join(F.slice(lines, 1, F.col("__last")), "\n")).withColumn("footer", F.array_join(F.slice(lines, F.col("__last") + 1, F.size(lines)), "\n")).drop("__tails", "__last")


def colophons(lines: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_index", "block")) -> DataFrame:
    """Per line (``line``, ``y0``, ``y1``, ``text``, from the top down) whether it belongs to a colophon: the last one or
    two lines of a band, below a gap of five median line heights, none of them apparatus."""
    w = Window.partitionBy(*keys)
    o = w.orderBy("line")
    h = F.sort_array(F.collect_list(F.col("y1") - F.col("y0")).over(w))
    d = lines.withColumn("__n", F.count("*").over(w)).withColumn("__h", F.element_at(h, (F.size(h) / 2).cast("int") + 1))
    d = d.withColumn("__gap", F.lag("y0").over(o) - F.col("y0")).withColumn("__k", F.row_number().over(o))
    left = F.col("__n") - F.col("__k") + 1  # lines from this one to the end
    plain = F.min((~is_apparatus_like(F.col("text"))).cast("int")).over(o.rowsBetween(0, Window.unboundedFollowing)) == 1
    opens = left.isin(1, 2) & (F.col("__k") > 1) & (F.col("__h") > 0) & (F.col("__gap") >= 5 * F.col("__h")) & plain
    d = d.withColumn("__opens", opens)
    return d.withColumn("colophon", F.max(F.col("__opens").cast("int")).over(o.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("__n", "__h", "__gap", "__k", "__opens")


def degenerate(blocks: DataFrame) -> DataFrame:
    """Pages starved of text: no apparatus, no text of three lines that isn't itself an apparatus, no translation of
    seven."""
    breaks = F.length("text") - F.length(F.regexp_replace("text", "\n", ""))
    opens = X.normalise(F.col("text")).rlike("^[0-9]{1,2} \\S[^:]* : ")
    normal = (F.col("layer") == "apparatus") | (F.col("layer") == "text") & (breaks >= 2) & ~opens | (F.col("layer") == "translation") & (breaks >= 6)
    return blocks.groupBy("doc_id", "page_index").agg(F.bool_or(normal).alias("__n")).where("not __n").drop("__n")


def reclassify(blocks: DataFrame) -> DataFrame:
    """On degenerate pages, text that opens like an entry becomes apparatus and a running head with two markers text."""
    d = blocks.join(degenerate(blocks).withColumn("__d", F.lit(True)), ["doc_id", "page_index"], "left")
    opens = X.normalise(F.col("text")).rlike("^[0-9]{1,2} \\S[^:]* : ")
    marked = F.regexp_count("text", F.lit("[α-ωΑ-ΩA-Zø-ÿà-öa-z][0-9]\\b")) >= 2
    layer = F.when(F.col("__d") & (F.col("layer") == "text") & opens, "apparatus").when(F.col("__d") & (F.col("layer") == "running_head") & marked, "text").otherwise(F.col("layer"))
    return d.withColumn("layer", layer).drop("__d")


def recover_folios(pages: DataFrame) -> DataFrame:
    """``printed_page`` of degenerate pages without one: the previous page's number and one, if it ends a line. A
    recovered folio feeds the next page, so a document's pages are folded in order; only numbers travel, no texts.
    ``pages``: doc_id, page_index, printed_page, degenerate, ends (the numbers that end a line)."""

    def fold(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("page_index").reset_index(drop=True)
        out, before = [], None
        for folio, bad, ends in zip(d["printed_page"], d["degenerate"], d["ends"]):
            if folio is None and bad and before is not None and before.isdigit() and str(int(before) + 1) in set(ends if ends is not None else ()):
                folio = str(int(before) + 1)
            out.append(folio)
            before = folio
        return d.assign(recovered=out)[["doc_id", "page_index", "printed_page", "recovered"]]

    return pages.groupBy("doc_id").applyInPandas(fold, f"doc_id {pages.schema['doc_id'].dataType.simpleString()}, page_index int, printed_page string, recovered string")
