"""One page: dispatch each apparatus block, gate it, anchor its entries. The cursor of a band runs along the page, so a
page is the unit of work and needs nothing from another."""

from __future__ import annotations

import re
from collections import defaultdict
from typing import Any

from variorum.kernels.grammars import MARKER, Grammar, Item, grammar_of, verse_candidates
from variorum.kernels.matching import find_lemma, follows, lemma_start, markers, verse_span, verse_windows
from variorum.kernels.registry import Registry

HELD = "marker convention gate excluded entry: it was not produced by a numeric-marker boundary"
Anchor = dict[str, Any]


def _anchor(kind: str, value: str) -> Anchor:
    return {"kind": kind, "value": value, "block_index": None, "char_offset": None, "digit_start": None, "digit_end": None}


def _put(a: Anchor, block: int, at: int, start: int | None = None, end: int | None = None) -> None:
    a |= {"block_index": block, "char_offset": at, "digit_start": at if start is None else start, "digit_end": at if end is None else end}


def _by_cursor(item: Item, a: Anchor, texts: list[tuple[int, str]], cursors: dict[int, int]) -> str:
    for b, text in texts:
        if found := find_lemma(item.parse["lemma"], text, cursors[b]):
            _put(a, b, found[1])
            cursors[b] = found[0] + 1
            return text[found[0] : found[1]]
    return ""


def _by_verse(item: Item, a: Anchor, texts: list[tuple[int, str]]) -> str:
    verse = re.split("-", item.value.split(":")[1])[0] if ":" in item.value else re.split("[–-]", item.value)[0]
    for form in verse_candidates(item.parse["lemma"]):
        for b, text in texts:
            for x, y in verse_windows(text, verse):
                if span := verse_span(text[x:y], form):
                    _put(a, b, x + span[1])
                    resolved = text[x + span[0] : x + span[1]]
                    item.parse["lemma"] = resolved if "§" in form else form  # a form with optional spaces isn't a lemma
                    return resolved
    return ""


def _by_marker(item: Item, a: Anchor, found: dict[str, list[tuple[int, int, bool]]], texts: dict[int, str]) -> bool:
    """Whether the number stays ambiguous. A single glued marker needs no proof; else the lemma must single one out."""
    places = found.get(item.value, [])
    glued = [p for p in places if not p[2]]
    if len(glued) != 1:
        lemma = item.parse["lemma"] if item.parse else None
        glued = [p for p in places if lemma is not None and follows(lemma, texts[p[0]][: p[1]])]
    if len(glued) == 1:
        b, at, apart = glued[0]
        _put(a, b, at, at - apart, at + len(item.value))
    return bool(places) and len(glued) != 1


def page_entries(blocks: list[dict[str, Any]], reg: Registry | None) -> list[dict[str, Any]]:
    """Entries of a page's apparatus blocks in order; ``k`` counts them over the page."""
    texts = [(i, b["text"] or "") for i, b in enumerate(blocks) if b["layer"] in ("text", "heading")]
    by_block = dict(texts)
    found: dict[str, list[tuple[int, int, bool]]] = defaultdict(list)
    for b, text in texts:
        for number, at, apart in markers(text):
            found[number].append((b, at, apart))
    out: list[dict[str, Any]] = []
    for index, block in enumerate(blocks):
        if block["layer"] != "apparatus" or block["text"] is None:
            continue
        band = block["text"]
        g = grammar_of(band, reg)
        items = g.split(band)
        for item in items:
            if item.boundary and (reg is not None or g.name == "verse"):
                item.parse = g.parse(item, reg)
        out += _marker_band(index, g, items, band, reg, found, by_block) if g is MARKER else _other_band(index, g, items, band, reg, texts)
    for k, e in enumerate(out):
        a, p = e["anchor"], e["parsed"]
        e["k"] = k
        start = lemma_start(p["lemma"], by_block[a["block_index"]], a["char_offset"]) if p and a and a["block_index"] is not None else None
        e["lemma_start"] = start if start is not None and start < a["digit_start"] else None
    return out


def _entry(index: int, g: Grammar, item: Item, anchor: Anchor | None, parse: dict | None, why: str, resolved: str = "", ambiguous: bool = False) -> dict[str, Any]:
    return {"block": index, "grammar": g.name, "raw": item.shown or item.raw, "source_slice": item.source, "anchor": anchor, "parsed": parse, "resolved_lemma": resolved, "refusal_evidence": why, "ambiguous": ambiguous}


def refusal(g: Grammar, reason: str) -> str:
    return f"{g.name} convention gate refused band: {reason}" if reason else ""


def _other_band(index: int, g: Grammar, items: list[Item], band: str, reg: Registry | None, texts: list[tuple[int, str]]) -> list[dict[str, Any]]:
    why = refusal(g, g.gate(band, items, reg))
    cursors: dict[int, int] = defaultdict(int)
    out = []
    for item in items:
        a = _anchor(g.kind, item.value) if item.boundary else None
        resolved = ""
        if item.parse and not why:
            resolved = _by_verse(item, a, texts) if g.kind == "verse" else _by_cursor(item, a, texts, cursors)
        out.append(_entry(index, g, item, a, None if why or reg is None else item.parse, why, resolved))
    return out


def _marker_band(index: int, g: Grammar, items: list[Item], band: str, reg: Registry | None, found: dict, texts: dict[int, str]) -> list[dict[str, Any]]:
    anchors = [_anchor("marker", i.value) if i.boundary else None for i in items]
    unsure = [a is not None and _by_marker(i, a, found, texts) for i, a in zip(items, anchors)]
    why = refusal(g, g.gate(band, items, reg, sum(a is not None and a["block_index"] is not None for a in anchors)))
    return [_entry(index, g, i, a, None if why else i.parse, why or ("" if i.boundary else HELD), "", u) for i, a, u in zip(items, anchors, unsure)]
