import pytest
from pyspark.sql import functions as F

from variorum.functions import text as X
from variorum.operators import apparatus as A
from variorum.operators import evidence as E
from variorum.sources import conspectus, layers, ocr

ALTO = "<alto><Tags><OtherTag ID='T1' LABEL='Apparatus'/></Tags><Layout><Page><PrintSpace><TextBlock TAGREFS='T1'><TextLine><String CONTENT='a' WC='0.5'/><SP/><String CONTENT='b' WC='1'/></TextLine></TextBlock><TextBlock><TextLine/></TextBlock></PrintSpace></Page></Layout></alto>"
PAGE = "<PcGts><Page><TextRegion type='heading'><TextLine><TextEquiv index='1'><Unicode>no</Unicode></TextEquiv><TextEquiv index='0' conf='0.8'><Unicode>yes</Unicode></TextEquiv></TextLine><TextRegion><TextLine><Word><TextEquiv conf='7'><Unicode>x</Unicode></TextEquiv></Word><Word><TextEquiv><Unicode>y</Unicode></TextEquiv></Word></TextLine></TextRegion></TextRegion></Page></PcGts>"
HOCR = "<div class='ocr_page' title='lpageno 7'><div class='ocr_carea'><p class='ocr_par'><span class='ocr_line'><span class='ocrx_word' title='x_wconf 80'>one</span> <span class='ocrx_word' title='x_wconf 100'>two</span></span></p></div></div><div class='ocr_page'><span class='ocr_line ocr_header'>flat</span></div>"


def test_ocr(spark):
    f = spark.createDataFrame([("a", ALTO), ("b", "%PDF-1.4"), ("c", ""), ("d", "<alto"), ("e", "<x/>"), ("f", None)], "path string, content string")
    got = {r.path: r for r in ocr.alto(f).collect()}
    assert (got["a"].layer, got["a"].text, got["a"].confidence) == ("apparatus", "a b", 0.75)
    assert all(got[x].refused for x in "bcdef") and "a PDF" in got["b"].refused
    p = ocr.pagexml(spark.createDataFrame([("p", PAGE)], "path string, content string")).first()
    assert (p.layer, p.text, p.confidence) == ("heading", "yes\nx y", 0.8)
    h = ocr.hocr(spark.createDataFrame([("h", HOCR), ("t", HOCR + "<span class='ocr_line'")], "path string, content string")).orderBy("path", "page").collect()
    assert [(r.printed_page, r.text, r.layer, r.confidence) for r in h[:2]] == [("7", "one two", "unknown", 0.9), (None, "flat", "running_head", 0.0)]
    assert "truncated" in h[2].refused


def test_footers_and_colophons(spark):
    foot = "Printed by the press of the town in 1890"
    b = spark.createDataFrame([(1, i, 0, f"5 a] b {i}\n{foot}\n") for i in range(3)] + [(1, 3, 0, "om. RP")], "doc_id int, page_index int, block int, text string")
    found = layers.footers(b)
    assert [(r.tail, r.n) for r in found.collect()] == [(foot, 3)]
    got = {r.page_index: r for r in layers.strip_footers(b, found).collect()}
    assert got[0].body == "5 a] b 0" and got[0].footer.strip() == foot and (got[3].body, got[3].footer) == ("om. RP", "")
    lines = spark.createDataFrame([(1, 0, 0, i, y, y + 10.0, t) for i, (y, t) in enumerate([(300.0, "a : b"), (288.0, "c : d"), (100.0, "Press")])], "doc_id int, page_index int, block int, line int, y0 double, y1 double, text string")
    assert [r.colophon for r in layers.colophons(lines).orderBy("line").collect()] == [False, False, True]


def test_degenerate_pages(spark):
    b = spark.createDataFrame([(1, 0, "text", "3 lemma A : x"), (1, 0, "running_head", "abc1 def2"), (1, 1, "apparatus", "x"), (1, 1, "text", "3 lemma A : x")], "doc_id int, page_index int, layer string, text string")
    assert sorted((r.page_index, r.layer) for r in layers.reclassify(b).collect()) == [(0, "apparatus"), (0, "text"), (1, "apparatus"), (1, "text")]
    p = spark.createDataFrame([(1, 0, "60", False, []), (1, 1, None, True, ["61"]), (1, 2, None, True, ["62", "9"]), (1, 3, None, True, ["99"])], "doc_id int, page_index int, printed_page string, degenerate boolean, ends array<string>")
    assert [r.recovered for r in layers.recover_folios(p).orderBy("page_index").collect()] == ["60", "61", "62", None]
    assert spark.range(1).select(layers.layer_of_band(F.lit("notes"), "la").alias("x")).first().x == "apparatus"


def test_conspectus_pages_and_merging(spark):
    t = ["preface", "CONSPECTUS SIGLORUM\nA = x", "B = y\nC = z", "running text\nof a page\nD = w", "E = v\nF = u"]
    pages = spark.createDataFrame([(1, i, x) for i, x in enumerate(t)], "doc_id int, page_index int, text string")
    assert tuple(conspectus.conspectus_pages(pages).first()) == (1, 1, 2)
    mine = spark.createDataFrame([("Otto", "editor", "mine")], "token string, role string, description string")
    got = {r.token: r.description for r in conspectus.merged([mine, conspectus.builtin(spark)]).collect()}
    assert got["Otto"] == "mine" and got["Mign."] == "Migne"
    maps = conspectus.as_maps(mine.withColumn("doc_id", F.lit(1)), "doc_id").first()
    assert maps.editors == {"Otto": "mine"} and maps.witnesses == {}


def test_a_page_with_its_own_registry(spark):
    p = spark.createDataFrame([(1, 0, [("text", "est in"), ("apparatus", "18 est] om. R 20 in] om. R")], {"R": ""}, {}), (2, 0, [("apparatus", None)], {}, {})], "doc_id int, page_index int, blocks array<struct<layer:string,text:string>>, witnesses map<string,string>, editors map<string,string>")
    got = A.entries(p).orderBy("k").collect()
    assert [(r.doc_id, r.parsed.lemma, r.lemma_start) for r in got] == [(1, "est", 0), (1, "in", 4)]


def test_paginate_and_helpers(spark):
    d = spark.createDataFrame([(1, i, c) for i, c in enumerate([5, 5, 5, 30, 1])], "doc_id int, i int, c int")
    assert [r.page for r in E.paginate(d, "doc_id", "i", "c", 10).orderBy("i").collect()] == [0, 0, 1, 2, 3]
    assert E.page_spec("1,5-7,6") == [0, 4, 5, 6]
    for bad in ("0", "3-2", "x", ""):
        with pytest.raises(ValueError):
            E.page_spec(bad)
    assert E.evenly(5, 24) == [0, 1, 2, 3, 4] and len(E.evenly(500, 24)) == 24 and E.evenly(0, 5) == []
    assert E.bootstrap([1, 1], 10, 1) == (1.0, 1.0) and E.bootstrap([0, 1] * 50, 200, 1)[0] < 0.5
    r = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3), ("s", 7)], "g string, n int")
    assert E.range_text(E.ranges(r, "g", "n"), "g").first().pages == "1-3,7"


def test_scalars(spark):
    d = spark.createDataFrame([("12 ac MTV | et U | a S", "ocr_appcrit", "Mc", "a  b\n5 x 10 y 15", "word1 and 2")], "a string, l string, s string, t string, m string")
    r = d.select(X.source_digest(F.col("a")).alias("d"), X.layer_of_label(F.col("l")).alias("l"), X.hand_label(X.hand(F.col("s"))).alias("h"), X.normalise(F.col("t")).alias("n"), X.bracket_markers(F.col("m")).alias("m"), X.has_marginal_numbers(F.col("t")).alias("g"), X.fold(F.lit("ΛΌΓΟΣ")).alias("f"), X.refusal_key(F.lit("left 41.7% (maximum 20%); x")).alias("k")).first()
    assert tuple(r) == ("cbf68924a0c3", "apparatus", "after correction / corrector", "a b 5 x 10 y 15", "word⟦1⟧ and 2", True, "λογοσ", "left n (maximum n), x")


def test_drift_fails_the_whole_replay(spark):
    p = spark.createDataFrame([(1, 0, [("text", "est in"), ("apparatus", "18 est] om. R 20 in] om. R")], {"R": ""}, {})], "doc_id int, page_index int, blocks array<struct<layer:string,text:string>>, witnesses map<string,string>, editors map<string,string>")
    o = spark.createDataFrame([(1, "p0-e0", "verbatim", "0" * 12, None)], f"doc_id int, entry_key string, action string, source_sha string, reviewed {A.PARSED}")
    assert A.drifted(A.entries(p), o).count() == 1
    with pytest.raises(Exception, match="no longer matches"):
        A.apply_overrides(A.entries(p), o).collect()
