"""Vectors of the grammars and of anchoring, without Spark."""

import pytest

from variorum.kernels import grammars as G
from variorum.kernels import mdce
from variorum.kernels.attribution import burst, peel
from variorum.kernels.matching import find_lemma, follows, lemma_start, markers, verse_span
from variorum.kernels.page import page_entries
from variorum.kernels.registry import Registry, xml_id

REG = Registry({s: s for s in ["A", "B", "M", "U", "S", "T", "V", "Tc", "R"]}, {"Otto": "Otto", "Marc.": "Marcovich", "Du Pontet": "x", "DuPontet": "x", "Klotz": "Klotz"})


def who(a):
    return {k: v for k, v in a.items() if v}


@pytest.mark.parametrize(
    "segment, text, found",
    [
        ("regnum et M U", "regnum et", {"witnesses": ["M", "U"]}),
        ("lexis coni. Otto", "lexis", {"editors": ["Otto"], "qualifiers": ["coni."]}),
        ("lexis scripsi", "lexis", {"editors": ["scripsi"]}),
        ("cohortibus XXX", "cohortibus XXX", {}),
        ("V M U S", "V", {"witnesses": ["M", "U", "S"]}),
        ("logos LXX", "logos", {"sources": ["LXX"]}),
        ("logos p. corr. A", "logos", {"qualifiers": ["p. corr."], "witnesses": ["A"]}),
        ("logos edd. ab Otto", "logos", {"qualifiers": ["edd."], "editors": ["Otto"]}),
        ("in urbe ab", "in urbe ab", {}),
        ("", "", {}),
    ],
)
def test_peel(segment, text, found):
    t, a = peel(segment, REG)
    assert (t, who(a)) == (text, found)


def test_burst_is_greedy_and_whole():
    assert burst(["MUSTcV", "Marcus", "A."], REG) == ["M", "U", "S", "Tc", "V", "Marcus", "A"]
    assert burst(["MUSTV."], REG) == ["M", "U", "S", "T", "V."]
    assert burst(["MU"], Registry()) == ["MU"]


def entries(text, band, reg=REG):
    return page_entries([{"layer": "text", "text": text}, {"layer": "apparatus", "text": band}], reg)


def test_marker_numbers_rise_outside_parentheses():
    band = "1 Alpha A : Beta B (Dial.  2  Gamma)  3 Delta : Eta Otto  2 Iota"
    assert [i.value for i in G.split_marker(band)] == ["1", "3"]
    head, one = G.split_marker("preface words\n1 Alpha")
    assert (head.boundary, one.value) == (False, "1")


def test_marker_ambiguity_and_detached():
    e = entries("Alpha1 and beta1 end", "1 Alpha A : Beta B")[0]
    assert not e["ambiguous"] or e["anchor"]["char_offset"] is None
    e = entries("the word Alpha 1 end", "1 Alpha A : Beta B")[0]
    assert (e["anchor"]["char_offset"], e["anchor"]["digit_start"], e["anchor"]["digit_end"]) == (15, 14, 16)


def test_prose_band_is_refused():
    es = entries("Alpha1 beta2", "1 He says : well then  2 She says : no")
    assert all(e["parsed"] is None and "a numbered prose band" in e["refusal_evidence"] for e in es)


def test_no_registry_refuses():
    es = entries("Alpha1", "1 Alpha A : Beta B", None)
    assert es[0]["refusal_evidence"].endswith("no registry is available for a trial parse")
    assert "line convention gate" in entries("x", "5 a U | b M ∥ 7 c U | d M", None)[0]["refusal_evidence"]


def test_line_notes():
    p = entries("cotidie in urbe", "5 cotidie MU | nisi mauis hodie uel heri ∥ 7 in urbe S (cf. BC 3.1) | in urbem an secludendum T")
    assert [r["text"] for r in p[0]["parsed"]["readings"]] == ["hodie", "heri"]
    assert "(cf. BC 3.1)" in p[1]["parsed"]["comments"]


def test_paragraph_preamble_and_loci():
    items = G.split_paragraph("56-57 I Ad Corinthios 13:12 18 est] om. R 20 in] om. S")
    assert [(i.boundary, i.value) for i in items] == [(False, ""), (True, "18"), (True, "20")]
    assert G.gate_paragraph("SIGLA 18 est] om. R 20 in] om. S", G.split_paragraph("SIGLA 18 est] om. R 20 in] om. S"), REG).startswith("a short non-locus preamble")


def test_duplicate_siglum():
    p = G.parse_paragraph(G.Item("1", "1 est] R R a S", ""), REG)
    assert [(r["text"], r["attribution"]["witnesses"]) for r in p["readings"]] == [("R", ["R"]), ("a", ["S"])]
    assert G.parse_paragraph(G.Item("1", "1 est] x R S R", ""), REG) is None


def test_verse_candidates_and_spuria():
    assert G.verse_candidates("ab ab") == ["ab ab", "ab", "a§b", "ab"]
    p = G.parse_verse(G.Item("1:1", "λόγος ] 〚WH〛".replace("〚WH〛", "WHspur"), ""), REG)
    assert p["readings"] == [] and p["lemma_attribution"]["witnesses"] == ["WHspur"]
    items = G.split_verse("1:18 a WH ] b RP • c NA ] – TR 19 d WH ] e RP")
    assert [i.value for i in items] == ["1:18", "1:18", "1:19"]


def test_bude_refuses_narrative_and_continuation():
    assert G.parse_bude(G.Item("", "5 uerbum A : aliud B", ""), REG) is None
    assert not G.looks_bude("1 a] b : c || 2 d] e")
    assert [i.value for i in G.split_bude("5 a A : b B || c A : d B 1.11 e A : f B")] == ["5", "5", "1.11"]


@pytest.mark.parametrize("lemma, before, yes", [("alpha beta", "x alpha beta", True), ("alpha … gamma", "alpha beta gamma", True), ("beta", "beta a b c d e f g", True), ("beta", "beta a b c d e f g h", False), ("", "x", False), ("x", "", False), ("ΛΌΓΟΣ", "ὁ λόγος", True)])
def test_follows(lemma, before, yes):
    assert follows(lemma, before) is yes


def test_lemma_start_needs_the_whole_sequence():
    assert lemma_start("alpha beta", "see alpha beta", 14) == 4
    assert lemma_start("alpha beta", "see beta", 8) is None
    assert lemma_start("naturam", "see nat-\nuram", 13) == 4
    assert lemma_start("beta", "beta gamma", 10) is None


@pytest.mark.parametrize("lemma", ["stipendiumque", "alpha beta", "alpha, beta", "alpha"])
def test_literal_walk_is_the_pattern(lemma):
    from variorum.kernels.matching import _pattern

    for text in ("alpha 15 beta", "alpha. beta alpha beta", "x alphabeta alpha beta", "alpha 5 alpha  beta", "stipendiumque"):
        for cursor in range(4):
            m = _pattern(tuple(lemma.split())).search(text, cursor) or _pattern(tuple(lemma.split())).search(text)
            if m:
                assert find_lemma(lemma, text, cursor) == m.span()


def test_hyphens_markers_and_ellipses():
    assert find_lemma("stipendiumque", "et stipendi- umque", 0) == (3, 18)
    assert find_lemma("dabatur uictoria", "dabatur uict", 0) == (0, 12)
    assert markers("word1 and word 2, p. 45") == [("1", 4, False), ("2", 15, True)]
    assert verse_span("τὸ κάρφος τὸ τὸ κάρφος ἐν", "τὸ … ἐν")[0] == 13


def test_ids_dont_collide():
    assert [xml_id(x) for x in ("M*", "π", "ω", "A1")] == ["Mu2a", "u3c0", "u3c9", "A1"]


GOOD = """# t

<!-- md-ce/0.3 · v 1 · ingest: x · pages: 0-0 · coverage: 1 entries — 1 parsed, 0 refused, 0 unparsed; 1 anchored (1 attached, 0 end-only), 0 unanchored · refusals: none · generative-blocks: 0 · escaped-lines: 0 · tei: t.xml -->

## page 5 (file index 0) [markers=1 entries=1 unresolved=0]
<!-- md-ce page: 1 entries — 1 parsed, 0 refused, 0 unparsed; 1 anchored (1 attached, 0 end-only), 0 unanchored -->

### text [source=born_digital generative=false confidence=1.00 block=0]

Alpha⟦5:1⟧

### apparatus [source=born_digital generative=false confidence=1.00 block=1]

⟦5:1⟧ Alpha A : Beta B
"""


@pytest.mark.parametrize(
    "old, new, code",
    [
        ("", "", None), ("\n\n", "\r\n\n", "I12"), ("Beta B\n", "Beta B", "I12"), ("Beta B", "Béta B", "I12"), ("# t", "t", "grammar"), ("md-ce/0.3", "md-ce/0.2", "grammar"),
        ("Alpha⟦5:1⟧", "# Alpha⟦5:1⟧", "I1"), ("Alpha⟦5:1⟧", "Alpha", "I3"), ("Alpha⟦5:1⟧", "Alpha⟦6:1⟧", "I3"), ("Alpha⟦5:1⟧", "Alpha⟦5:1⟧ ⟧", "I4"), ("block=1]", "block=x]", "I5"),
        ("block=1]", "block=0]", "I6"), ("generative=false", "generative=true", "I10"), ("escaped-lines: 0", "escaped-lines: 3", "I1"), ("refusals: none", "refusals: 2× why", "I11"), ("entries=1 ", "entries=2 ", "I11"),
    ],
)
def test_each_mutation_has_its_code(old, new, code):
    found = [v[0] for v in mdce.validate(GOOD.replace(old, new, 1) if old else GOOD)]
    assert (code in found) if code else not found
