"""Golden editions against emitted TEI: typed findings, as joins by page and number.

``ERROR_*`` findings fail a build; ``GAP_*`` are honest refusals (an entry kept verbatim, or without an anchor).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variorum.functions import rows
from variorum.functions import text as X
from variorum.kernels import golden as kernel

SIDE = "struct<text:string,wits:array<string>,editors:array<string>>"
_SIDE = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("wits", "editors"))])
_KINDS = {"number": T.IntegerType(), "attached": T.BooleanType(), "lemma": _SIDE, "readings": T.ArrayType(_SIDE)}
ITEM = T.StructType([T.StructField(n, _KINDS.get(n, T.StringType())) for n in ("kind", "folio", "n", "number", "attached", "verbatim", "trouble", "lemma", "readings", "before", "span")])


def items(docs: DataFrame, text: str = "tei") -> DataFrame:
    """The pages and entries of each document's TEI (``doc_id`` and the columns of ``ITEM``)."""
    names = ITEM.names
    return rows.read(docs, text, lambda s: [tuple([r.get(k) for k in names]) for r in kernel.items(s)], ITEM)


def strict(editors: Column) -> Column:
    """Editors by name, without those that name nobody."""
    named = F.filter(editors, lambda e: ~e.isin(sorted(kernel.NOBODY)))
    return F.array_sort(F.transform(named, lambda e: F.regexp_replace(e, "[.]+$", "")))


def compare(golden: DataFrame, emitted: DataFrame) -> DataFrame:
    """``doc_id``, ``folio``, ``n``, ``kind`` of each finding. ``golden`` has ``doc_id``, ``folio``, ``n``, ``lemma`` (a side),
    ``readings`` (sides), ``band`` (number and printed entry) and ``anchor_word``; ``emitted`` comes from ``items``. Of several
    entries with a number the first printed counts."""
    page = ["doc_id", "folio"]
    # both sides are read once: a page's entries meet in arrays, and the first printed of a number has the least place
    row = F.struct("number", *[c for c in emitted.columns if c not in (*page, "number")])
    got = emitted.groupBy(*page).agg(F.bool_or(F.col("kind") == "page").alias("seen"), F.collect_list(F.when(F.col("kind") != "page", row)).alias("said"))
    want = golden.groupBy(*page).agg(F.collect_list(F.struct(*[c for c in golden.columns if c not in page])).alias("wanted"))
    first = lambda k: F.array_min(F.filter("said", lambda e: (e["n"] == F.col("g.n")) & (e["kind"] == k)))
    pages = want.join(got, page, "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    size = F.when(~F.col("seen"), "ERROR_MISSING_PAGE").when(F.size("said") > F.size("wanted"), "ERROR_PHANTOM").when(F.size("said") < F.size("wanted"), "ERROR_LOST")
    listed = pages.select(*page, "said", F.when(F.col("seen"), F.col("wanted")).alias("wanted"), size.alias("size"))
    # a row without a golden entry carries what is found of the page itself
    each_ = listed.select(*page, "said", "size", F.explode(F.concat(F.when(F.col("size").isNotNull(), F.array(F.lit(None))).otherwise(F.array()), F.coalesce("wanted", F.array()))).alias("g"))
    one, each = X.fold_with("golden"), X.fold_each_with("golden")
    met = each_.select(*page, "size", "g", F.when(F.col("g").isNotNull(), first("app")).alias("app"), F.when(F.col("g").isNotNull(), first("note")).alias("note"))
    printed = F.regexp_extract("g.band", "^[^ ]* (.*)$", 1)
    j = met.select(
        *page, F.col("g.n").alias("n"), "size", F.col("g").isNull().alias("whole"), "app", "note", F.col("g.lemma").alias("g"), F.col("g.readings").alias("gr"),
        one(F.coalesce("app.verbatim", "note.verbatim")).alias("verbatim"), one(printed).alias("printed"), one(F.col("app.lemma.text")).alias("lemma"), one(F.col("g.lemma.text")).alias("g_lemma"),
        each(F.col("app.readings.text")).alias("texts"), each(F.col("g.readings.text")).alias("g_texts"), one(F.col("app.before")).alias("before"), one(F.col("app.span")).alias("span"), one(F.col("g.anchor_word")).alias("word"),
    )
    app, words = F.col("app"), X.folded_words
    no = lambda c: ~F.coalesce(c, F.lit(False))
    both = F.least(F.size("texts"), F.size("g_texts"))
    upto = F.when(both > 0, F.sequence(F.lit(0), both - 1)).otherwise(F.array().cast("array<int>"))
    differ = lambda f: F.transform(F.filter(upto, f), lambda i: F.lit(1))
    times = lambda kind, hits: F.transform(hits, lambda _: F.lit(kind))
    when = lambda kind, c: F.when(F.coalesce(c, F.lit(False)), F.array(F.lit(kind))).otherwise(F.array().cast("array<string>"))
    last = lambda ws: F.when(F.size(ws) > 0, F.element_at(ws, -1))
    parsed = F.concat(
        when("ERROR_LEMMA", no(F.col("lemma") == F.col("g_lemma"))),
        when("ERROR_WIT", app["lemma"].isNotNull() & no(F.array_sort(app["lemma"]["wits"]) == F.array_sort(F.col("g.wits")))),
        when("ERROR_EDITOR", app["lemma"].isNotNull() & no(strict(app["lemma"]["editors"]) == strict(F.col("g.editors")))),
        when("ERROR_READING", F.size("texts") != F.size("g_texts")),
        times("ERROR_READING", differ(lambda i: F.get("texts", i) != F.get("g_texts", i))),
        times("ERROR_WIT", differ(lambda i: F.array_sort(F.get(app["readings"], i)["wits"]) != F.array_sort(F.get("gr", i)["wits"]))),
        times("ERROR_EDITOR", differ(lambda i: strict(F.get(app["readings"], i)["editors"]) != strict(F.get("gr", i)["editors"]))),
        when("ERROR_VERBATIM", no(F.col("verbatim") == F.col("printed"))),
        when("GAP_UNANCHORED", ~app["attached"]),
        when("ERROR_ANCHOR", app["attached"] & (app["trouble"] == "no end")),
        when("ERROR_ANCHOR", app["attached"] & no(app["trouble"] == "no end") & no(last(words(F.col("before"))) == last(words(F.col("word"))))),
        when("ERROR_ANCHOR", app["trouble"].isin("no start", "inverted") | (F.col("span").isNotNull() & (words(F.col("span")) != words(F.col("g_lemma"))))),
    )
    kept = F.concat(F.array(F.when(no(F.col("verbatim") == F.col("printed")), "ERROR_VERBATIM").otherwise("GAP_UNPARSED")), when("GAP_UNANCHORED", ~F.col("note.attached")))
    kinds = F.when(F.col("whole"), F.array("size")).when(app.isNotNull(), parsed).when(F.col("note").isNotNull(), kept).otherwise(F.array(F.lit("ERROR_LOST")))
    return j.select(*page, F.when(F.col("whole"), "-").otherwise(F.col("n")).alias("n"), F.explode(kinds).alias("kind"))


def adjudicated(findings: DataFrame, records: DataFrame, profile: str = "line") -> DataFrame:
    """``key``, ``kind``, ``verdict`` of each finding (``key``, ``kind``, ``band``) and of each kind of a record that no finding
    fired. A finding is 'excused' where a record names its kind and the record's ``print_form`` stands in both its stored
    ``band_evidence`` and the extracted band, all folded; a record without evidence needs none. 'unproven' and 'no evidence'
    excuse nothing; a kind that never fired is 'stale'."""
    fold = X.fold_with(profile)
    r = records.select("key", "error_kinds", fold("print_form").alias("form"), fold("band_evidence").alias("stored"), F.coalesce("unproven", F.lit(False)).alias("unproven"), (F.col("band_evidence") != "").alias("bound"))
    j = findings.select("key", "kind", fold("band").alias("band")).join(r, "key", "left")
    held = ~F.col("bound") | (F.col("form") != "") & F.contains("stored", "form") & F.contains("band", "form")
    verdict = F.when(~F.coalesce(F.array_contains("error_kinds", F.col("kind")), F.lit(False)), "error").when(F.col("unproven"), "unproven").when(held, "excused").otherwise("no evidence")
    said = j.select("key", "kind", verdict.alias("verdict"))
    fired = said.where("verdict = 'excused'").select("key", "kind").distinct()
    stale = records.select("key", F.explode("error_kinds").alias("kind")).join(fired, ["key", "kind"], "left_anti")
    return said.unionByName(stale.select("key", "kind", F.lit("stale").alias("verdict")))
