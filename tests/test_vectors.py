"""Entry shapes of real editions, as input and expected reading, for each convention; and files handed over by mistake."""

import pytest
from pyspark.sql import functions as F

from variorum.kernels import folds
from variorum.kernels import grammars as G
from variorum.kernels.attribution import burst, is_empty
from variorum.kernels.page import page_entries
from variorum.kernels.registry import Registry
from variorum.sources import ocr, tei
from variorum.sources.conspectus import EDITORS

NAMED = {"Marc.": "Marcovich", "Mign.": "Migne", "Thirlb.": "Thirlby", "Sylb.": "Sylburg", "Steph.": "Estienne", "Mar.": "Maran", "Goodsp.": "Goodspeed"}
GREEK = Registry({"A": "Parisinus", "B": "Musaei", "A1": "A prima manu"}, {**NAMED, **{v or k: k for k, v in EDITORS.items()}})
LINE = Registry({s: s for s in ("M", "U", "S", "T", "V", "Tc", "Uc", "Vac", "Uac")}, {e: e for e in ("Nipperdey", "Klotz", "Schneider", "Larsen", "Vielhaber", "Du Pontet", "DuPontet", "Fleischer")})


def bare(names):
    return [n.rstrip(",.") for n in names]


MARKER = [
    # entry, lemma, its (witnesses, editors, qualifiers, sources), readings with theirs, comments
    ("Μωσέως : Μωϋσέως Mign., Otto, Goodsp. (hic et infra : 45, 3)", "Μωσέως", {}, [("Μωϋσέως", {"editors": ["Mign", "Otto", "Goodsp"]})], ["(hic et infra : 45, 3)"]),
    ("Γένους edd. a Mar. : γένος codd., cett. edd.", "Γένους", {"qualifiers": ["edd"]}, [("γένος", {})], None),
    ("Οὐδ’ οὐ μὴ codd., LXX : οὐδὲ μὴ Steph., Mar., Mign., Otto.", "Οὐδ’ οὐ μὴ", {"sources": ["LXX"]}, [("οὐδὲ μὴ", {"editors": ["Steph", "Mar", "Mign", "Otto"]})], None),
    ("Obiectis scripsimus : obiectis A B", "Obiectis", {"editors": ["scripsimus"]}, [("obiectis", {"witnesses": ["A", "B"]})], None),
    ("Τοὺς add. sup. l. A1.", "Τοὺς", {"qualifiers": ["add", "sup. l"], "witnesses": ["A1"]}, [], None),
    ("Cappadociae : cappado(t/c)i(a)e A B", "Cappadociae", {}, [("cappado(t/c)i(a)e", {"witnesses": ["A", "B"]})], None),
    ("Habebat : habebat et A B", "Habebat", {}, [("habebat et", {"witnesses": ["A", "B"]})], None),
    ("Cohortibus XXII : cohortibus XXX A B", "Cohortibus XXII", {}, [("cohortibus XXX", {"witnesses": ["A", "B"]})], None),
    ("alpha : beta", "alpha", {}, [("beta", {})], None),
    ("Ἰακὼβ :   Ἰὼβ Sylb.   [ὅτι] prop. Thirlb.", "Ἰακὼβ", {}, None, None),
    ("Κατα(να)θεματίζοντας − ὅπως Sylb., Marc. : καταθεματίζοντας A", "Κατα(να)θεματίζοντας − ὅπως", {"editors": ["Sylb", "Marc"]}, [("καταθεματίζοντας", {"witnesses": ["A"]})], None),
]


@pytest.mark.parametrize("raw, lemma, by, readings, comments", MARKER)
def test_marker_entries(raw, lemma, by, readings, comments):
    p = G.parse_marker(G.Item("1", raw, raw), GREEK)
    assert p["lemma"] == lemma
    for kind, want in by.items():
        assert set(want) <= set(bare(p["lemma_attribution"][kind]))
    if readings is not None:
        assert [r["text"] for r in p["readings"]] == [t for t, _ in readings]
        for r, (_, want) in zip(p["readings"], readings):
            assert {k: bare(r["attribution"][k]) for k in want} == want
    assert comments is None or p["comments"] == comments


def test_marker_transposition_and_open_parenthesis():
    p = G.parse_marker(G.Item("1", "Κατὰ − βουλὴν post εἰς τὸν transponendum Thirlb., transp. Marc.", ""), GREEK)
    assert p["lemma"] == "Κατὰ − βουλὴν" and any(q.startswith("post ") for q in p["lemma_attribution"]["qualifiers"])
    p = G.parse_marker(G.Item("1", "Αἱρέσεις prop. Thirlb., Mar., coni. Otto (cf. I Cor. 11, 19 : αἱρέσεις ; Dial. 35,", ""), GREEK)
    assert p["lemma"] == "Αἱρέσεις" and p["comments"][0].startswith("(cf.")


@pytest.mark.parametrize("raw", ["ἐστιν] εσται 458", "Ναβαυ] ιωʹ ναβω 86", "om τῶν 2° 78-569 76", "om σπεῖρον—σπορίμου 59(c pr m): homoiar", "Post ἐσταυρωμένος Thirlb. et Mar. interrogationis signum collocarunt"])
def test_other_series_and_prose_are_refused(raw):
    assert G.parse_marker(G.Item("1", raw, raw), GREEK) is None


PROSE = "no witness, editor or source is named"
BANDS = [
    ([("46", "See the printed text, vol. VIII, comm. 14 f. 117E."), ("47", "Here the author plainly leans on a second rule : “all that is said is meant so”.")], PROSE),
    ([("13", "See, e.g., Meyer, ‘Being and Saying’, p. 198.")], PROSE),
    ([("1", "Ἰακὼβ : Ἰὼβ"), ("2", "Μωσέως : Μωϋσέως Mign.")], ""),
    ([("4", "Ἔθνεσιν : τῷ ἔθνει LXX")], ""),
    ([("5", "Alpha : beta om."), ("6", "Gamma : delta cf.")], PROSE),
    ([("1", "Alpha : beta || Gamma : delta")], "foreign separator '||'"),
]


@pytest.mark.parametrize("entries, reason", BANDS)
def test_marker_bands(entries, reason):
    items = [G.Item(n, raw, raw) for n, raw in entries]
    for i in items:
        i.parse = G.parse_marker(i, GREEK)
    said = G.gate_marker("", items, GREEK, 1)
    assert reason in said if reason else said == ""
    if entries[0][1] == "Ἰακὼβ : Ἰὼβ":
        assert is_empty(items[0].parse["readings"][0]["attribution"])


SPLIT = [
    ("5 alpha M ∥ beta U ∥ 7 gamma S", [("5", "alpha M"), ("5", "beta U"), ("7", "gamma S")]),
    ("5 alpha M (cf. BC 1.2) 7 beta U | an gamma (u. supra)? 9 delta S | sed cf. 57.6 11 epsilon T", [("5", None), ("7", None), ("9", None), ("11", "epsilon T")]),
    ("11–12 ◊ alpha M ∥ 14.24–15.2 beta U", [("11–12", None), ("14.24–15.2", "beta U")]),
    ("5 duodecim M | (ut dicitur) 12 milia U | duodecim V", [("5", "duodecim M | (ut dicitur) 12 milia U | duodecim V")]),
]


@pytest.mark.parametrize("band, want", SPLIT)
def test_line_splitting(band, want):
    items = G.split_line(band)
    assert [i.value for i in items] == [v for v, _ in want]
    assert all(raw is None or i.raw == raw for i, (_, raw) in zip(items, want))


def one(raw):
    (item,) = G.split_line(f"5 {raw}")
    return G.parse_line(item, LINE)


ENTRIES = [
    ("aptantur MUSTV | temptantur Nipperdey", "aptantur", [("temptantur", {"editors": ["Nipperdey"]})]),
    ("intermittebat U (cf. 37.1) | intermittebant (sc. Alexandrini) M", "intermittebat", [("intermittebant (sc. Alexandrini)", {"witnesses": ["M"]})]),
    ("in MUSTV | [in] Schneider coll. Hirt. 8.27.4", "in", [("[in]", {"editors": ["Schneider"]})]),
    ("suffossa Uc | soffosa Vac uel soffossa", "suffossa", [("soffosa", {"witnesses": ["Vac"]})]),
    ("obiectis M | an contexerant (cf. BC 2.10.5)?", "obiectis", [("contexerant", {"qualifiers": ["an?"]})]),
    ("hostium MUSTV | an secludendum ut glossema?", "hostium", []),
    ("obiectis M | nisi mauis iunctis (cf. Vitr. 10.2.14) uel adiunctis", "obiectis", [("iunctis", {"qualifiers": ["nisi mauis"]}), ("adiunctis", {"qualifiers": ["nisi mauis"]})]),
    ("casum M | nisi mauis casum secludere (cf. Liu. 21.34.8)", "casum", []),
    ("alpha M | constantiaque uirtutum Klotz post facta transposuerit", "alpha", [("constantiaque uirtutum", {"editors": ["Klotz"]})]),
    ("Nam palam sexagiens cum ] | alpha M", "Nam palam sexagiens cum", [("alpha", {"witnesses": ["M"]})]),
    ("defensionem eius1 M | defensonem eius Uc", "defensionem eius", [("defensonem eius", {"witnesses": ["Uc"]})]),
    ("adiuuante natura MUSTV | adiuuante ⟨nostros⟩ natura Du Pontet", "adiuuante natura", [("adiuuante ⟨nostros⟩ natura", {"editors": ["DuPontet"]})]),
]


@pytest.mark.parametrize("raw, lemma, readings", ENTRIES)
def test_line_entries(raw, lemma, readings):
    p = one(raw)
    assert (p["lemma"], [r["text"] for r in p["readings"]]) == (lemma, [t for t, _ in readings])
    for r, (_, want) in zip(p["readings"], readings):
        assert {k: r["attribution"][k] for k in want} == want


def test_line_notes_stay_out_of_readings():
    p = one("foramina U | foramina S, quos secutus foramina seclusit Vielhaber ut glossema")
    assert p["readings"][0]["text"] == "foramina" and any("quos secutus" in c for c in p["comments"])
    p = one("alpha M | ut uix defendi posse se confiderent, quibus et superioribus locis subleuabantur Larsen")
    assert p["readings"][0]["text"].startswith("ut uix") and "quibus et superioribus" in p["readings"][0]["text"]
    for raw, tail in (("in MUSTV | [in] Schneider coll. Hirt. 8.27.4", "coll."), ("suffossa Uc | soffosa Vac uel soffossa", "uel"), ("intermittebat U (cf. 37.1) | x M", "(cf. 37.1)")):
        assert any(c.startswith(tail) for c in one(raw)["comments"])


@pytest.mark.parametrize("words, reg, want", [(["MUSTV"], LINE, ["M", "U", "S", "T", "V"]), (["USTcV"], LINE, ["U", "S", "Tc", "V"]), (["MUX"], LINE, ["MUX"]), (["multa"], LINE, ["multa"]), (["ABVG²"], Registry({c: c for c in "ABVG"}), ["A", "B", "V", "G"])])
def test_glued_sigla(words, reg, want):
    assert burst(words, reg) == want


GATES = [
    ("line", "5 alpha M | beta U ∥ 7 gamma S | delta T", ""),
    ("line", "5 Verg. Aen. 1.1 | Hor. Carm. 1.2 ∥ 7 Liv. 2.3 | Cic. Off. 1.4", "trial parse"),
    ("verse", "1:1 α WH ] β RP • γ WH ] δ Treg", ""),
    ("verse", "1:1 α WH ] β RP ∥ 2 γ WH ] δ Treg", "'∥'"),
]


@pytest.mark.parametrize("name, band, reason", GATES)
def test_whole_bands(name, band, reason):
    g = next(x for x in G.GRAMMARS if x.name == name)
    items = g.split(band)
    for i in items:
        i.parse = g.parse(i, LINE)
    said = g.gate(band, items, LINE)
    assert reason in said if reason else said == ""


def test_verse_splitting_keeps_source_slices():
    items = G.split_verse("1:1 α WH ] β RP•γ WH ] δ Treg")
    assert [(i.value, i.raw, i.source) for i in items] == [("1:1", "α WH ] β RP", "1:1 α WH ] β RP"), ("1:1", "γ WH ] δ Treg", "γ WH ] δ Treg")]
    assert G.parse_verse(G.Item("1:1", "α WH ] β", ""), LINE) is None


def test_verse_lemma_is_the_printed_form_and_editions_are_declared(spark):
    from variorum.sinks import documents as D

    text, band = "18 alpha, beta gamma 19 delta end", "1:18 alpha beta WH NA ] omega RP • gam ma gamma NA ] – RP 19 delta Treg ] eps WHspur"
    es = page_entries([{"layer": "text", "text": text}, {"layer": "apparatus", "text": band}], LINE)
    assert [(e["parsed"]["lemma"], e["resolved_lemma"]) for e in es] == [("alpha beta", "alpha, beta"), ("gamma", "gamma"), ("delta", "delta")]
    kind = "array<struct<layer:string,text:string>>"
    d = D.documents(spark.createDataFrame([("d", 0, [("text", text), ("apparatus", band)])], f"doc_id string, page_index int, blocks {kind}"), LINE)
    assert tei.bad_references(d).count() == 0
    xml = d.first().tei
    assert "Byzantine Textform (2005)" in xml and 'xml:id="wit-Treg"' in xml and xml.index('xml:id="wit-M"') < xml.index('xml:id="wit-NA"')


def test_folds_differ_on_purpose():
    said = {p: folds.fold(p, "δ[ε] a—b κατ’ λό-\nγος…") for p in folds.FOLDS}
    assert said == {"golden": "δ[ε] a b κατ' λογοσ…", "line": "δε a b κατ λογος", "verse": "δε a b κατ λο γοσ", "real": "δε a—b κατ λογοσ", "scholastic": "δ ε a b κατ λογος…"}
    assert folds.words("similiter.Et (sic)") == ["similiter", "et", "sic"]


ALTO = '<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout><Page><PrintSpace><TextBlock ID="b"><TextLine><String CONTENT="Bellum" WC="0.98"/><SP/><String CONTENT="ciuile" WC="0.97"/></TextLine></TextBlock></PrintSpace></Page></Layout></alto>'
HOCR = "<html><body><div class='ocr_page'><span class='ocr_line'><span class='ocrx_word' title='x_wconf 96'>Bellum</span></span></div></body></html>"
PAGE = '<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page><TextRegion id="r"><TextLine id="l"><TextEquiv conf="0.95"><Unicode>Bellum ciuile</Unicode></TextEquiv></TextLine></TextRegion></Page></PcGts>'
FOREIGN = '<ead xmlns="urn:isbn:1-931666-22-9"><archdesc><did><unittitle>Papiers</unittitle></did></archdesc></ead>'
WRONG = ["", "   \n", FOREIGN, "%PDF-1.7 binary", "PK\x03\x04 zip", "Gallia est omnis divisa in partes tres."]


@pytest.mark.parametrize("kind, good", [("alto", ALTO), ("hocr", HOCR), ("pagexml", PAGE)])
def test_files_handed_over_by_mistake(spark, kind, good):
    read = getattr(ocr, kind)
    bad = [*WRONG, good[: len(good) // 2]]
    d = spark.createDataFrame([(f"f{i}", c) for i, c in enumerate([good, *bad])], "path string, content string")
    rows = read(d.withColumn("content", F.col("content"))).collect()
    assert [r.text for r in rows if r.path == "f0"] and all(r.refused is None for r in rows if r.path == "f0")
    for i in range(1, len(bad) + 1):
        own = [r for r in rows if r.path == f"f{i}"]
        assert own and all(r.refused and r.text is None for r in own), (kind, bad[i - 1][:40])
