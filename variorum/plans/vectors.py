"""Queries over small literal inputs whose results are written out by hand: what no table of the driver carries."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.functions import text as X
from variorum.kernels import mdce
from variorum.operators import apparatus as A
from variorum.operators import evidence as E
from variorum.operators import golden, qa
from variorum.sinks import documents as D
from variorum.sources import conspectus, layers, ocr, overrides


def literal(rows: list[tuple]) -> str:
    """Rows as SQL values."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"CAST({v} AS DOUBLE)"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS BIGINT)"

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def values(rows: list[tuple], *names: str) -> str:
    return f"SELECT {', '.join(names)} FROM (VALUES {literal(rows)}) t({', '.join(names)})"


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# Scalar functions.
SCALARS: dict[str, tuple] = {
    "fold": (lambda c: X.fold(c), [("Λόγος ΉΣ", "λογοσ ησ"), ("É", "e"), (None, None)]),
    "layer_of_label": (lambda c: X.layer_of_label(c), [("App-Crit", "apparatus"), ("OCR_pageno", "page_number"), (" ocr_title ", "heading"), ("caption", "unknown"), ("running  head", "running_head"), (None, "unknown")]),
    "bracket_markers": (lambda c: X.bracket_markers(c), [("λόγος12, x3", "λόγος⟦12⟧, x⟦3⟧"), ("p. 45", "p. 45"), ("a123", "a123")]),
    "marginal_numbers": (lambda c: X.has_marginal_numbers(c).cast("string"), [("5 a 10 b 15", "true"), ("5 a 10 b", "false"), ("a5 b10 c15", "false")]),
    "normalise_answer": (lambda c: X.normalise_answer(c), [(" 'Straße'  ", "strasse"), ('"The  Word"', "the word"), ("A, B", "a, b"), ("`x`", "x")]),
    "source_excerpt": (lambda c: X.source_excerpt(c), [("a\n b", "a b"), ("x" * 130, "x" * 119 + "…")]),
    "refusal_key": (lambda c: X.refusal_key(c), [("only 3/4 (75.5%; minimum 90%)", "only n/n (n, minimum n)"), ("a · b", "a . b")]),
    "hand": (lambda c: X.hand(c), [("Aac", "ac"), ("B2", "2"), ("AB", ""), ("ωc", "c")]),
}


def scalar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, (f, cases) in SCALARS.items():
        d = spark.createDataFrame([(given,) for given, _ in cases], "given string")
        parts.append(d.select(F.lit(name).alias("function"), "given", f(F.col("given")).alias("got")))
    return union(parts)


# Page regions and sampling.
SPEC = ["1,5-7", "3", "2-2, 1"]


def sampling_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("page_spec", s, json.dumps(E.page_spec(s))) for s in SPEC]
    rows += [("evenly", f"{n} of {m}", json.dumps(E.evenly(n, m))) for n, m in ((0, 5), (4, 8), (100, 15), (30, 8))]
    crop = spark.createDataFrame([("crop", "-1 2.7 300 90 in 200 100", -1.0, 2.7, 300.0, 90.0, 200.0, 100.0)], "what string, given string, x0 double, y0 double, x1 double, y1 double, w double, h double")
    box = X.crop(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("w"), F.col("h"))
    cut = crop.select("what", "given", F.format_string("[%d, %d, %d, %d]", *(box[c] for c in ("x0", "y0", "x1", "y1"))).alias("got"))
    floors = spark.createDataFrame([("floor", str(n), n) for n in (0, 770, 563)], "what string, given string, n bigint").select("what", "given", E.floor_of(F.col("n")).cast("string").alias("got"))
    return union([spark.createDataFrame(rows, "what string, given string, got string"), cut, floors])


SAMPLED = [
    ("page_spec", "1,5-7", "[0, 4, 5, 6]"), ("page_spec", "3", "[2]"), ("page_spec", "2-2, 1", "[0, 1]"), ("evenly", "0 of 5", "[]"), ("evenly", "4 of 8", "[0, 1, 2, 3]"),
    ("evenly", "100 of 15", "[0, 1, 2, 3, 4, 5, 6, 7, 30, 52, 74, 96, 97, 98, 99]"), ("evenly", "30 of 8", "[0, 1, 2, 3, 4, 5, 6, 7]"),
    ("crop", "-1 2.7 300 90 in 200 100", "[0, 2, 200, 90]"), ("floor", "0", "1"), ("floor", "770", "77"), ("floor", "563", "57"),
]

# md-ce: a file and its mutations, one invariant each.
SUM = "1 entries — 1 parsed, 0 refused, 0 unparsed; 1 anchored (1 attached, 0 end-only), 0 unanchored"
GOOD = f"""# t

<!-- md-ce/{mdce.VERSION} · v 1 · ingest: x · pages: 0-0 · coverage: {SUM} · refusals: none · generative-blocks: 0 · escaped-lines: 0 · tei: t.xml -->

## page 5 (file index 0) [markers=1 entries=1 unresolved=0]
<!-- md-ce page: {SUM} -->

### text [source=born_digital generative=false confidence=1.00 block=0]

Alpha⟦5:1⟧

### apparatus [source=born_digital generative=false confidence=1.00 block=1]

⟦5:1⟧ Alpha A : Beta B
"""
SECOND = f"\n## page 5 (file index 0) [markers=0 entries=0 unresolved=0]\n<!-- md-ce page: {SUM.replace('1', '0')} -->\n"
MUTATIONS = [
    ("none", "", "", None), ("carriage return", "\n\n", "\r\n\n", "I12"), ("no final line break", "Beta B\n", "Beta B", "I12"), ("decomposed letter", "Beta B", "Béta B", "I12"), ("no title", "# t", "t", "grammar"),
    ("other version", f"md-ce/{mdce.VERSION}", "md-ce/0.2", "grammar"), ("unescaped heading", "Alpha⟦5:1⟧", "# Alpha⟦5:1⟧", "I1"), ("marker lost", "Alpha⟦5:1⟧", "Alpha", "I3"), ("marker of another page", "Alpha⟦5:1⟧", "Alpha⟦6:1⟧", "I3"),
    ("stray bracket", "Alpha⟦5:1⟧", "Alpha⟦5:1⟧ ⟧", "I4"), ("block without number", "block=1]", "block=x]", "I5"), ("block twice", "block=1]", "block=0]", "I6"), ("generative not counted", "generative=false", "generative=true", "I10"),
    ("escapes miscounted", "escaped-lines: 0", "escaped-lines: 3", "I1"), ("refusals miscounted", "refusals: none", "refusals: 2× why", "I11"), ("entries miscounted", "entries=1 ", "entries=2 ", "I11"),
]


def mdce_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each mutated file breaks its invariant, and that the file itself breaks none."""
    rows = [(name, GOOD.replace(old, new, 1) if old else GOOD, code) for name, old, new, code in MUTATIONS]
    d = spark.createDataFrame(rows, "doc_id string, md string, code string")
    found = D.violations(d).groupBy("doc_id").agg(F.collect_set("invariant").alias("found"))
    j = d.join(found, "doc_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    return j.select(F.col("doc_id").alias("mutation"), F.when(F.col("code").isNull(), F.when(F.size("found") == 0, "valid")).when(F.array_contains("found", F.col("code")), F.col("code")).alias("found"))


# OCR formats.
ALTO = """<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Tags><OtherTag ID="T1" LABEL="app-crit"/></Tags><Layout><Page><PrintSpace>
<TextBlock ID="b1"><TextLine><String CONTENT="Bellum" WC="0.9"/><SP/><String CONTENT="ciuile" WC="0.7"/></TextLine><TextLine><String CONTENT="alterum" WC="0.8"/></TextLine></TextBlock>
<TextBlock ID="b2" TAGREFS="T1"><TextLine><String CONTENT="1"/><SP/><String CONTENT="om."/></TextLine></TextBlock></PrintSpace></Page></Layout></alto>"""
HOCR = """<html><body><div class='ocr_page' title='bbox 0 0 9 9; lpageno 12'><div class='ocr_carea'><p class='ocr_par'><span class='ocr_line'><span class='ocrx_word' title='x_wconf 90'>Bellum</span>
<span class='ocrx_word' title='x_wconf 80'>ciuile</span></span></p></div><div class='ocr_carea ocr_header'><span class='ocr_line'>CAESAR</span></div></div></body></html>"""
PAGE = """<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page><TextRegion id="r1" type="heading"><TextLine id="l1"><TextEquiv index="1" conf="0.2"><Unicode>wrong</Unicode></TextEquiv>
<TextEquiv index="0" conf="0.9"><Unicode>LIBER</Unicode></TextEquiv></TextLine></TextRegion><TextRegion id="r2"><TextLine id="l2"><Word><TextEquiv conf="0.5"><Unicode>Bellum</Unicode></TextEquiv></Word><Word><TextEquiv conf="0.7"><Unicode>ciuile</Unicode></TextEquiv></Word></TextLine></TextRegion></Page></PcGts>"""
OCR = [
    ("alto", None, 0, "unknown", "Bellum ciuile\nalterum", 0.8), ("alto", None, 1, "apparatus", "1 om.", 0.0), ("hocr", "12", 0, "unknown", "Bellum ciuile", 0.85), ("hocr", "12", 1, "running_head", "CAESAR", 0.0),
    ("pagexml", None, 0, "heading", "LIBER", 0.9), ("pagexml", None, 1, "unknown", "Bellum ciuile", 0.6), ("empty", None, None, None, None, None), ("pdf", None, None, None, None, None), ("other", None, None, None, None, None),
]


def ocr_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of each format, and three files that are none."""
    one = lambda name, content: spark.createDataFrame([(name, content)], "path string, content string")
    bad = spark.createDataFrame([("empty", " "), ("pdf", "%PDF-1.7"), ("other", "<ead/>")], "path string, content string")
    d = union([ocr.alto(one("alto", ALTO)), ocr.hocr(one("hocr", HOCR)), ocr.pagexml(one("pagexml", PAGE)), ocr.alto(bad)])
    return d.select("path", "printed_page", F.col("block").cast("bigint").alias("block"), "layer", "text", F.round("confidence", 6).alias("confidence"))


# Bands to layers, footers, colophons, folios.
FOOT = "Downloaded from a library of the university"
FOOTED = [(i, f"{i} alpha A : beta B\n{FOOT}\n \n" if i < 3 else "no footer here, only a long last line of text") for i in range(4)]


def footer_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([("d", i, t) for i, t in FOOTED], "doc_id string, page bigint, text string")
    return layers.strip_footers(d, layers.footers(d)).select("page", "body", F.trim(F.regexp_replace("footer", "\\s+", " ")).alias("footer"))


def layer_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([(b,) for b in ("translation", "notes", "text", "margin")], "band string")
    return d.select("band", layers.layer_of_band(F.col("band")).alias("greek"), layers.layer_of_band(F.col("band"), "la").alias("latin"))


#: Lines of a band from the top (y falls) and whether they make a colophon.
COLOPHON = [("a", 0, 700.0, 710.0, "text of the page", False), ("a", 1, 685.0, 695.0, "more of it", False), ("a", 2, 670.0, 680.0, "and more", False), ("a", 3, 100.0, 110.0, "Printed in Oxford", True), ("b", 0, 700.0, 710.0, "text", False), ("b", 1, 100.0, 110.0, "1 alpha A : beta", False)]


def colophon_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([("d", 0, b, i, y0, y1, t) for b, i, y0, y1, t, _ in COLOPHON], "doc_id string, page_index int, block string, line bigint, y0 double, y1 double, text string")
    return layers.colophons(d).select("block", "line", "colophon")


FOLIOS = [(0, "11", False, [], "11"), (1, None, True, ["12", "3"], "12"), (2, None, True, ["13"], "13"), (3, None, False, ["14"], None), (4, None, True, ["15"], None), (5, "xv", False, [], "xv")]


def folio_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([("d", i, f, bad, ends) for i, f, bad, ends, _ in FOLIOS], "doc_id string, page_index int, printed_page string, degenerate boolean, ends array<string>")
    return layers.recover_folios(d).select(F.col("page_index").cast("bigint").alias("page"), "recovered")


BLOCKS = [(0, "text", "12 alpha A : beta B"), (0, "running_head", "word1 and word2"), (1, "text", "one\ntwo\nthree"), (1, "running_head", "word1 and word2"), (2, "apparatus", "x"), (2, "text", "1 a : b")]


def reclassified_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([("d", p, b, t) for p, b, t in BLOCKS], "doc_id string, page_index bigint, layer string, text string")
    return layers.reclassify(d).select("page_index", "text", "layer")


# Conspectus pages, registries.
CONSPECTUS = [(0, "Title page"), (1, "CONSPECTUS SIGLORUM\nA = Parisinus"), (2, "B = Romanus\nC = Londinensis"), (3, "Text begins\nB = Romanus once\nand goes on\nat length"), (4, "D = later\nE = later")]


def conspectus_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([("d", i, t) for i, t in CONSPECTUS], "doc_id string, page_index bigint, text string")
    found = conspectus.conspectus_pages(d).select(F.lit("found").alias("how"), "first", "last")
    given = conspectus.conspectus_from(d, 4).select(F.lit("given").alias("how"), "first", "last")
    return found.unionByName(given)


def registry_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda *rows: spark.createDataFrame(rows, "token string, role string, description string")
    return conspectus.merged([part(("A", "witness", "declared"), ("Otto", "editor", None)), part(("A", "witness", "other"), ("B", "witness", "added"))]).select("token", "role", "description")


# Reviews.
REVIEWS = {"format": overrides.FORMAT, "entries": {"p0-e0": {"source_sha": "cbf68924a0c3", "source_excerpt": "x", "action": "parse", "lemma": "ac", "lemma_wits": ["M", "V"], "readings": [{"text": "et", "wits": ["U"]}]}, "p0-e1": {"source_sha": "0" * 12, "source_excerpt": "y", "action": "verbatim"}}}


def override_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = overrides.load(spark, spark.createDataFrame([("d", json.dumps(REVIEWS))], "doc_id string, content string"))
    return d.select("entry_key", "action", "source_sha", F.col("reviewed.lemma").alias("lemma"), F.array_join("reviewed.lemma_attribution.witnesses", ",").alias("wits"), F.element_at("reviewed.readings", 1)["text"].alias("reading"))


def digest_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([("12 ac MTV | et U | a S",)], "slice string")
    return d.select("slice", X.source_digest(F.col("slice")).alias("source_sha"))


# Probe.
PROBED = [
    ("d", 0, "text", "title only"), ("d", 2, "text", "λόγος"), ("d", 2, "apparatus", "1 a : b"), ("d", 5, "text", "λόγος"), ("d", 5, "notes", "n"), ("d", 20, "translation", "words"), ("d", 20, "apparatus", "1 a : b"), ("d", 21, "heading", "end"),
    ("e", 0, "text", "verba latina sunt"), ("e", 0, "apparatus", "x"), ("f", 0, "heading", "nothing"),
]


def probe_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame(PROBED, "doc_id string, page_index bigint, layer string, text string")
    return E.probe(d).select("doc_id", "pages", "text_lang", "command")


# Reports.
def report_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([("d", "why", 2), ("d", "because", 5), ("d", "also", 2)], "doc_id string, reason string, n bigint")
    tally = A.tally_line(t, "doc_id").select(F.lit("tally").alias("what"), F.col("refusals").alias("said"))
    b = spark.createDataFrame([("x", "text", 1), ("y", "apparatus", 2), ("z", "text", 3), ("z", "apparatus", 4)], "doc_id string, layer string, n int")
    e = spark.createDataFrame([("y",)], "doc_id string")
    bad = A.degeneracies(b, e).select(F.lit("degenerate").alias("what"), F.concat_ws(": ", "doc_id", "degeneracy").alias("said"))
    x, y = (spark.createDataFrame(r, "path string, content string") for r in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("b", "9"), ("d", "4")]))
    same = E.same_files(x, y).select(F.lit("builds").alias("what"), F.concat_ws(": ", "path", "verdict").alias("said"))
    p = spark.createDataFrame([("d", k, c) for k, c in enumerate((3, 4, 4, 20, 1))], "doc_id string, k int, c int")
    pages = E.paginate(p, "doc_id", "k", "c", 10).select(F.lit("pages").alias("what"), F.concat_ws(": ", "k", "page").alias("said"))
    return union([tally, bad, same, pages])


REPORTED = [
    ("tally", "5× because; 2× also; 2× why"), ("degenerate", "y: no constituted text"), ("degenerate", "z: apparatus bands without an entry"), ("builds", "a: match"), ("builds", "b: differ"), ("builds", "c: only in build 1"), ("builds", "d: only in build 2"),
    ("pages", "0: 0"), ("pages", "1: 0"), ("pages", "2: 1"), ("pages", "3: 2"), ("pages", "4: 3"),
]

# Questions.
ANSWERED = [
    (1, "A, B", ["B", "A"], True, True), (2, "[#wit-A; 'B']", ["A", "B"], True, True), (3, "A B C", ["A", "B"], True, False), (4, "ed-Otto", ["#Otto"], True, True), (5, " 'Alpha  Beta' ", ["alpha beta"], False, True),
    (6, "alpha", ["alpha beta"], False, False), (7, "straße", ["STRASSE"], False, True), (8, "", ["A"], True, False),
]


def answer_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([r[:4] for r in ANSWERED], "n bigint, response string, gold array<string>, is_set boolean")
    return qa.scored(d).select("n", "correct")


LONG = " ".join(f"w{i}" for i in range(100))
CUT = [("short text", "text", "short text"), (LONG, "w50 w51", "… " + " ".join(f"w{i}" for i in range(14, 86)) + " …"), (LONG, "W99", "… " + " ".join(f"w{i}" for i in range(28, 100))), (LONG, "absent", " ".join(f"w{i}" for i in range(72)) + " …")]
PRINTED = ["5 alpha M | beta U ∥ 7 gam-", "ma S | delta T ∥ 9 epsilon", "zeta eta theta iota kappa M"]
SPANS = [("alpha M | beta U", 0, 0), ("epsilon zeta", 1, 2), ("zeta eta theta iota kappa lambda", 2, 2), ("absent words", None, None), ("gam- ma S", 0, 1)]
WINDOWS = [("one two three two", "three", 4, "two three two"), ("one two three two", "two", 4, None), ("onetwo", "two", 4, None), ("abc", "", 4, None)]


def context_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = spark.createDataFrame([r[:2] for r in CUT], "t string, given string").select(F.lit("excerpt").alias("what"), "given", X.excerpt("t", "given").alias("got"))
    span = X.line_span(F.array(*map(F.lit, PRINTED)), F.col("given"))
    lines = spark.createDataFrame([r[:1] for r in SPANS], "given string").withColumn("s", span).select(F.lit("lines").alias("what"), "given", F.when(F.col("s.first").isNotNull(), F.concat_ws("-", "s.first", "s.last")).alias("got"))
    around = spark.createDataFrame([r[:3] for r in WINDOWS], "t string, given string, r int").select(F.lit("window").alias("what"), "given", X.lemma_window("t", "given", "r").alias("got"))
    mark = spark.createDataFrame([("ante alpha beta", "alpha"), ("ante", "alpha")], "t string, given string").select(F.lit("marked").alias("what"), "given", qa.marked(F.col("t"), F.col("given")).alias("got"))
    ask = spark.createDataFrame([("why?",)], "given string").select(F.lit("prompt").alias("what"), "given", F.substring_index(qa.prompt(F.lit("flat"), F.lit("ante"), F.col("given"), F.lit("a1")), "\n\n", -4).alias("got"))
    return union([cut, lines, around, mark, ask])


CONTEXTS = [
    *(("excerpt", g, w) for _, g, w in CUT), *(("lines", g, None if a is None else f"{a}-{z}") for g, a, z in SPANS), *(("window", g, w) for _, g, _, w in WINDOWS), ("marked", "alpha", "ante alpha⟦eval:1⟧ beta"), ("marked", "alpha", "ante ⟦eval:1⟧"),
    ("prompt", "why?", "Condition: FLAT PRINTED-PAGE TRANSCRIPTION\nApp reference: a1\n\nCONTEXT\nante\n\nQUESTION\nwhy?\n\nANSWER\n"),
]
ITEMS = [("q1", ["a"], "r1", "count"), ("q2", ["a", "b"], "r2", "witness"), (" ", ["a"], "r3", "count"), ("q4", [], "r4", "count"), ("q5", ["a"], "r5", "other")]


def dataset_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame(ITEMS, "question string, gold_answer array<string>, app_ref string, type string")
    return qa.invalid(d, ["count", "witness"], 5)


FAULTS = [("r3", "an empty field"), ("r4", "no gold answer"), ("r5", "a type that this edition hasn't"), (None, "1 items of type witness, not 2"), (None, "1 items of type other, not 0")]
BAND = "1 alpha A beta 2 gamma gamma B delta 3 epsilon zeta eta C"
ALIGNED = [(0, "alpha", "beta", 2), (1, "gamma", "x", 17), (2, "absent", None, None), (3, "alpha", "epsilon", 39), (4, "epsilon theta eta", None, None), (5, "zeta", "eta", 47)]


def alignment_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.createDataFrame([("d", n, a, b) for n, a, b, _ in ALIGNED], "doc_id string, n bigint, lemma string, reading string")
    return qa.aligned(spark.createDataFrame([("d", BAND)], "doc_id string, band string"), e, "doc_id").select("n", F.col("at"))


PAGES = [(1, "πριν Ἴδιον λῆμμα· μετα"), (2, "allo λημμα"), (3, "unica uox"), (4, None)]
APPS = [(10, "ἴδιον, λῆμμα", 1, None), (11, "λῆμμα", None, "lemma occurs on multiple selected pages"), (12, "absens", None, "lemma absent from selected page text"), (13, "UNICA", 3, None), (14, "nica", None, "lemma absent from selected page text")]


def located_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.createDataFrame([r[:2] for r in APPS], "app bigint, lemma string")
    return qa.located(a, spark.createDataFrame(PAGES, "page bigint, text string"), "app", "page")


LIMITS = [("contamination", 518, 555), ("structure", 0, 555), ("at the floor", 77, 770), ("below it", 76, 770), ("no source", 0, 0)]


def floor_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.unproven(spark.createDataFrame(LIMITS, "name string, examined bigint, source_apps bigint")).select("name", "floor")


# Typed divergences.
RECORDS = [
    ("b:1", ["LEMMA", "WIT"], "alpha", "12 Alpha A", None), ("b:2", ["LEMMA"], "beta", "12 gamma", None), ("b:3", ["LEMMA"], "x", "x", True), ("b:4", ["LEMMA"], "", "", None), ("b:5", ["LEMMA"], "delta", "9 delta B", None),
]
FOUND = [("b:1", "LEMMA", "12 ⟨Alpha⟩ A : omega"), ("b:1", "READING", "12 Alpha"), ("b:2", "LEMMA", "12 beta"), ("b:3", "LEMMA", "x"), ("b:4", "LEMMA", "anything"), ("b:6", "LEMMA", "y")]
VERDICTS = [
    ("b:1", "LEMMA", "excused"), ("b:1", "READING", "error"), ("b:2", "LEMMA", "no evidence"), ("b:3", "LEMMA", "unproven"), ("b:4", "LEMMA", "excused"), ("b:6", "LEMMA", "error"),
    ("b:1", "WIT", "stale"), ("b:2", "LEMMA", "stale"), ("b:3", "LEMMA", "stale"), ("b:5", "LEMMA", "stale"),
]


def divergence_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.createDataFrame(RECORDS, "key string, error_kinds array<string>, print_form string, band_evidence string, unproven boolean")
    return golden.adjudicated(spark.createDataFrame(FOUND, "key string, kind string, band string"), r)


QUERIES = {
    "divergence_vectors": (divergence_vectors, values(VERDICTS, "key", "kind", "verdict")),
    "answer_vectors": (answer_vectors, values([(r[0], r[-1]) for r in ANSWERED], "n", "correct")),
    "context_vectors": (context_vectors, values(CONTEXTS, "what", "given", "got")),
    "dataset_vectors": (dataset_vectors, values(FAULTS, "app_ref", "fault")),
    "alignment_vectors": (alignment_vectors, values([(r[0], r[-1]) for r in ALIGNED], "n", "at_").replace("SELECT n, at_", 'SELECT n, at_ AS "at"')),
    "located_vectors": (located_vectors, values([(a, p, w) for a, _, p, w in APPS], "app", "page", "why")),
    "floor_vectors": (floor_vectors, values([("structure", 56), ("below it", 77), ("no source", 1)], "name", "floor")),
    "scalar_vectors": (scalar_vectors, values([(n, a, b) for n, (_, cases) in SCALARS.items() for a, b in cases], "function", "given", "got")),
    "sampling_vectors": (sampling_vectors, values(SAMPLED, "what", "given", "got")),
    "mdce_mutations": (mdce_mutations, values([(n, c or "valid") for n, _, _, c in MUTATIONS], "mutation", "found")),
    "ocr_vectors": (ocr_vectors, values(OCR, "path", "printed_page", "block", "layer", "text", "confidence")),
    "footer_vectors": (footer_vectors, values([(i, t.split("\n")[0], FOOT if i < 3 else "") for i, t in FOOTED], "page", "body", "footer")),
    "layer_vectors": (layer_vectors, values([("translation", "translation", "text"), ("notes", "notes", "apparatus"), ("text", "text", "text"), ("margin", "unknown", "unknown")], "band", "greek", "latin")),
    "colophon_vectors": (colophon_vectors, values([(b, i, c) for b, i, *_, c in COLOPHON], "block", "line", "colophon")),
    "folio_vectors": (folio_vectors, values([(r[0], r[-1]) for r in FOLIOS], "page", "recovered")),
    "reclassified_vectors": (reclassified_vectors, values([(0, BLOCKS[0][2], "apparatus"), (0, "word1 and word2", "text"), *((p, t, b) for p, b, t in BLOCKS[2:])], "page_index", "text", "layer")),
    "conspectus_vectors": (conspectus_vectors, values([("found", 1, 2), ("given", 4, 4)], "how", "first", "last").replace('"last"', "last")),
    "registry_vectors": (registry_vectors, values([("A", "witness", "declared"), ("Otto", "editor", None), ("B", "witness", "added")], "token", "role", "description")),
    "override_vectors": (override_vectors, values([("p0-e0", "parse", "cbf68924a0c3", "ac", "M,V", "et"), ("p0-e1", "verbatim", "0" * 12, None, None, None)], "entry_key", "action", "source_sha", "lemma", "wits", "reading")),
    "digest_vector": (digest_vector, values([("12 ac MTV | et U | a S", "cbf68924a0c3")], "slice", "source_sha")),
    "probe_vectors": (probe_vectors, values([("d", "3-6,21", "grc", "variorum build d --pages 3-6,21 --text-lang grc"), ("e", "1", "la", "variorum build e --pages 1 --text-lang la"), ("f", None, "grc", None)], "doc_id", "pages", "text_lang", "command")),
    "report_vectors": (report_vectors, values(REPORTED, "what", "said")),
}
