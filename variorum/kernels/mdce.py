"""md-ce files read back: the invariants they must hold, and their rows for the round trip with TEI."""

from __future__ import annotations

import re
import unicodedata
import xml.etree.ElementTree as ET
from collections import Counter
from functools import lru_cache
from typing import Any

VERSION = "0.3"
_FIELDS = ["entries", "parsed", "refused", "unparsed", "anchored", "attached", "end_only", "unanchored"]
_N = lambda f: f"(?P<{f}>[0-9]+)"
_SENTENCE = f"{_N('entries')} entries — {_N('parsed')} parsed, {_N('refused')} refused, {_N('unparsed')} unparsed; {_N('anchored')} anchored [(]{_N('attached')} attached, {_N('end_only')} end-only[)], {_N('unanchored')} unanchored"
_META = re.compile(r"<!-- md-ce/(?P<version>[.0-9]+) · (?P<tool>[^·]+) · ingest: (?P<ingest>\S+) · pages: " + _N("first") + "-" + _N("last") + " · coverage: " + _SENTENCE + " · refusals: (?P<tally>.*?) · generative-blocks: " + _N("gen") + " · escaped-lines: " + _N("esc") + " · tei: [^>]*? -->")
_PAGE = re.compile(r"## page (?P<folio>\S+) [(]file index " + _N("index") + r"[)] \[markers=[0-9]+ entries=" + _N("entries") + " unresolved=" + _N("unresolved") + r"\]")
_COVER = re.compile("<!-- md-ce page: " + _SENTENCE + " -->")
_SECTION = re.compile(r"### (?P<layer>apparatus|heading|notes|text|translation|unclassified) \[source=(?:ocr|born_digital) generative=(?P<gen>false|true) confidence=[0-9][.][0-9]{2} block=" + _N("block") + r"\]")
MARK = re.compile("⟦(?P<folio>[^⟦⟧:]+):(?P<n>[0-9]{1,3})(?P<open>[?])?⟧")
_MARKED = re.compile("^" + MARK.pattern + " ")
_ASIDE = re.compile("[*]refs: .*[*]|<!-- md-ce page: .*")
_STRUCTURE = re.compile("<!-- md-ce|#{1,6} ")
Found = tuple[str, int, str]


@lru_cache(1 << 12)
def _section(line: str) -> tuple[str, bool, int] | None:
    """Layer, generative and block of a section header; a file has few different ones."""
    m = _SECTION.fullmatch(line)
    return m and (m["layer"], m["gen"] == "true", int(m["block"]))


@lru_cache(1 << 12)
def _cover(line: str) -> tuple[tuple[str, int], ...] | None:
    m = _COVER.fullmatch(line)
    return m and tuple(_numbers(m).items())


def _numbers(m: re.Match) -> dict[str, int]:
    return {f: int(m[f]) for f in _FIELDS}


def _sums(where: str, line: int, n: dict[str, int]) -> list[Found]:
    checks = [("parsed + refused + unparsed", n["parsed"] + n["refused"] + n["unparsed"], n["entries"]), ("attached + end-only + unanchored", n["attached"] + n["end_only"] + n["unanchored"], n["entries"]), ("attached + end-only", n["attached"] + n["end_only"], n["anchored"])]
    return [("I11", line, f"{where}: {what} = {got}, not {want}") for what, got, want in checks if got != want]


def validate(content: str) -> list[Found]:
    """Violations as (invariant, line from 1 or 0 for the file, message), by line."""
    out: list[Found] = []
    if "\r" in content:
        out.append(("I12", 0, "a carriage return; lines end in LF"))
    if not unicodedata.is_normalized("NFC", content):
        out.append(("I12", 0, "not in NFC"))
    if content[-1:] not in ("", "\n"):
        out.append(("I12", 0, "no newline at the end"))
    lines = content.split("\n")
    if not re.match(r"# \S", lines[0]):
        out.append(("grammar", 1, "the first line is no title"))
    meta, meta_line, pages, section = None, 0, [], None
    for at, line in enumerate(lines, 1):
        if line[:1] not in ("<", "#"):
            if section:
                section["body"].append((at, line))
            continue
        if at == 1 and line.startswith("# "):
            continue
        page = pages[-1] if pages else None
        if line.startswith("<!-- md-ce page: "):
            m = _cover(line)
            if not m or page and page["cover"]:
                out.append(("I11", at, "a second coverage line" if m else "no valid coverage line"))
            elif not page:
                out.append(("grammar", at, "coverage before any page"))
            else:
                page["cover"], page["cover_line"] = dict(m), at
        elif line.startswith("<!-- md-ce"):
            m = _META.fullmatch(line)
            if not m or meta:
                out.append(("grammar", at, "a second meta comment" if m else "no valid meta comment"))
            else:
                meta, meta_line = m, at
        elif line.startswith("## "):
            if m := _PAGE.fullmatch(line):
                pages.append({"line": at, "folio": m["folio"], "index": int(m["index"]), "entries": int(m["entries"]), "unresolved": int(m["unresolved"]), "cover": None, "cover_line": 0, "sections": []})
                section = None
            else:
                out.append(("grammar", at, "no valid page header"))
        elif line.startswith("### "):
            m = _section(line)
            if not m or not page:
                out.append(("grammar", at, "a section before any page") if m else ("I5", at, f"no valid section header: {line[:80]}"))
            else:
                section = {"line": at, "layer": m[0], "gen": m[1], "block": m[2], "body": []}
                page["sections"].append(section)
        elif _STRUCTURE.match(line):
            out.append(("I1", at, f"a body line that looks like structure: {line[:80]}"))
        elif section:
            section["body"].append((at, line))
    if not meta:
        return sorted(out + [("grammar", 0, "no meta comment")], key=lambda v: (v[1], v[0]))
    if meta["version"] != VERSION:
        out.append(("grammar", meta_line, f"version {meta['version']}, not {VERSION}"))
    indices = [p["index"] for p in pages]
    if any(b <= a for a, b in zip(indices, indices[1:])):
        out.append(("I7", 0, f"page indices don't rise: {indices}"))
    out += [("I7", 0, f"folio {f} more than once") for f, n in sorted(Counter(p["folio"] for p in pages).items()) if n > 1 and f != "–"]
    if pages and (int(meta["first"]), int(meta["last"])) != (indices[0], indices[-1]):
        out.append(("I11", meta_line, "the meta comment names other pages"))
    for p in pages:
        seen: set[int] = set()
        for s in p["sections"]:
            if s["block"] in seen:
                out.append(("I6", s["line"], f"block {s['block']} twice on page {p['folio']}"))
            seen.add(s["block"])
        out += _page(p)
    total = {f: sum(p["cover"][f] for p in pages if p["cover"]) for f in _FIELDS}
    said = _numbers(meta)
    out += _sums("meta", meta_line, said) + [("I11", meta_line, f"meta {f} {said[f]}, pages sum to {total[f]}") for f in _FIELDS if said[f] != total[f]]
    items = [re.fullmatch("([0-9]+)× (.+)", x) for x in meta["tally"].split("; ")] if meta["tally"] != "none" else []
    if not all(items):
        out.append(("I11", meta_line, "a refusal tally that can't be read"))
    elif sum(int(m[1]) for m in items) != said["refused"]:
        out.append(("I11", meta_line, "the refusal tally doesn't sum to refused"))
    bodies = [line for p in pages for s in p["sections"] for _, line in s["body"]]
    for invariant, name, got in (("I10", "gen", sum(s["gen"] for p in pages for s in p["sections"])), ("I1", "esc", sum(_STRUCTURE.match(x[1:]) is not None for x in bodies if x[:1] == "\\"))):
        if int(meta[name]) != got:
            out.append((invariant, meta_line, f"the meta comment counts {meta[name]}, the file has {got}"))
    return sorted(out, key=lambda v: (v[1], v[0]))


def _page(p: dict[str, Any]) -> list[Found]:
    out: list[Found] = []
    closed, opened, in_text, shown = Counter(), Counter(), Counter(), 0
    for s in p["sections"]:
        for at, line in s["body"]:
            found = []
            if "⟦" in line or "⟧" in line:
                if re.search("[⟦⟧]", MARK.sub("", line)):
                    out.append(("I4", at, "a stray marker bracket"))
                found = list(MARK.finditer(line))
                out += [("I3", at, f"{m[0]} on page {p['folio']}") for m in found if m["folio"] != p["folio"]]
            if s["layer"] == "apparatus":
                if line.strip():
                    shown += 1
                    head = found[0] if found and not found[0].start() else None
                    if head:
                        (opened if head["open"] else closed)[head["n"]] += 1
                    out += [("I3", at, f"{m[0]} inside an entry") for m in found[head is not None :]]
            elif not found:
                continue
            elif s["layer"] in ("heading", "text"):
                out += [("I3", at, f"unresolved {m[0]} in a text") for m in found if m["open"]]
                in_text.update(m["n"] for m in found if not m["open"])
            else:
                out += [("I3", at, f"{m[0]} in a {s['layer']} block") for m in found]
    for n in sorted(closed.keys() | opened.keys() | in_text.keys()):
        if closed[n] > 1:
            out.append(("I3", p["line"], f"marker {n} twice in the apparatus"))
        if closed[n] != in_text[n]:
            out.append(("I3", p["line"], f"marker {n}: {closed[n]} resolved entries, {in_text[n]} in the text"))
    c, at = p["cover"], p["cover_line"]
    if not c:
        return out + [("I11", p["line"], f"page {p['folio']} without a coverage line")]
    out += _sums(f"page {p['folio']}", at, c)
    pairs = [("entries of header", p["entries"], c["entries"]), ("unresolved of header", p["unresolved"], c["unanchored"]), ("entry lines", shown, c["entries"])]
    out += [("I11", at, f"{what} {a}, coverage has {b}") for what, a, b in pairs if a != b]
    most = [("resolved markers", sum(closed.values()), c["anchored"]), ("unresolved markers", sum(opened.values()), c["unanchored"])]
    return out + [("I11", at, f"{what} {a}, coverage has {b}") for what, a, b in most if a > b]


def rows_of_markdown(content: str) -> list[tuple[int, str, str]]:
    """(page index, layer, text): one row per entry, one per page for each other layer that the round trip compares."""
    out, bodies, index, layer = [], {}, None, None
    for line in content.split("\n"):
        head = line[:3]
        if head == "## " and (m := _PAGE.fullmatch(line)):
            index, layer = int(m["index"]), None
            bodies |= {(index, x): [] for x in ("notes", "text", "translation")}
        elif head == "###" and (said := _section(line)):
            layer = said[0] if index is not None else None
        elif layer and not (line[:1] in ("*", "<") and _ASIDE.fullmatch(line)):
            text = line[1:] if line[:1] == "\\" and _STRUCTURE.match(line[1:]) else line
            if layer == "apparatus":
                if text.strip():
                    out.append((index, layer, " ".join((_MARKED.sub("", text) if text[0] == "⟦" else text).split())))
            elif (index, layer) in bodies:
                bodies[index, layer].append(MARK.sub("", text) if layer == "text" and "⟦" in text else text)
    return out + [(i, layer, " ".join(" ".join(b).split())) for (i, layer), b in bodies.items()]


_NS = "{http://www.tei-c.org/ns/1.0}"


def rows_of_tei(xml: str) -> list[tuple[int, str, str]]:
    root = ET.fromstring(xml.encode())
    out, bodies, folios, index = [], {}, {}, None
    say = lambda e: " ".join("".join(e.itertext()).split())
    for e in root.iterfind(f"./{_NS}text/{_NS}body/{_NS}div[@type='edition']/*"):
        tag, kind = e.tag.removeprefix(_NS), e.get("type")
        if tag == "pb":
            index = int(e.get("{http://www.w3.org/XML/1998/namespace}id").removeprefix("page-"))
            folios.setdefault(e.get("n") or "–", []).append(index)
            bodies |= {(index, x): [] for x in ("notes", "text", "translation")}
        elif tag == "app":
            out += [(index, "apparatus", say(n)) for n in e.iterfind(f"{_NS}note[@type='verbatim']")]
        elif (tag, kind) == ("note", "apparatus"):
            out.append((index, "apparatus", say(e)))
        elif (tag, kind) == ("note", "editorial"):
            bodies[index, "notes"].append(say(e))
        elif (tag, kind) == ("ab", None):
            bodies[index, "text"].append(say(e))
    for p in root.iterfind(f"./{_NS}text/{_NS}body/{_NS}div[@type='translation']/{_NS}p"):
        own = folios.get(p.get("n") or "–", [])
        if len(own) == 1:
            bodies[own[0], "translation"].append(say(p))
    return out + [(i, layer, " ".join(" ".join(b).split())) for (i, layer), b in bodies.items()]
