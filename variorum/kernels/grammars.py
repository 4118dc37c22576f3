"""The six printed conventions: how each splits a band, parses an item, and refuses a band that isn't its own.

Every grammar is a ``Grammar`` of four functions. ``gate`` gets the items with their trial parses, so a band is split
and parsed once; it returns the reason of the first failing check, or ''. An item that doesn't parse stays verbatim.
A parse is a dict with ``lemma``, ``lemma_attribution``, ``readings`` (dicts of ``text``, ``attribution``), ``comments``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from variorum.kernels.attribution import bare, burst, is_empty, nobody, peel
from variorum.kernels.registry import CONNECTORS, LONG_QUALIFIERS, QUALIFIERS, SOURCES, Registry

NUM = "[0-9]{1,3}"
SPAN = f"{NUM}(?:[–-]{NUM})?"
Parse = dict[str, Any]


@dataclass
class Item:
    value: str  # line, locus, verse reference or marker number, as printed
    raw: str  # white space collapsed, without the leading reference where the convention reads it apart
    source: str  # exact substring of the band
    shown: str = ""  # raw as an entry shows it; raw itself where empty
    crux: bool = False
    boundary: bool = True  # False for a preamble or a head, which no grammar parses
    parse: Parse | None = field(default=None, repr=False)


def flat(text: str) -> str:
    return " ".join(text.split())


def parsed(lemma: str, attribution: dict, readings: list[tuple[str, dict]], comments: list[str] | None = None) -> Parse:
    return {"lemma": lemma, "lemma_attribution": attribution, "readings": [{"text": t, "attribution": a} for t, a in readings], "comments": comments or []}


def unconsumed(items: list[Item]) -> float:
    """Share of the tokens that stand in items without a parse: by tokens, so many short items can't hide a long one."""
    sizes = [(len(i.raw.split()), i.parse is None) for i in items]
    return sum(n for n, lost in sizes if lost) / max(1, sum(n for n, _ in sizes))


def _left_over(items: list[Item], most: float) -> str:
    share = unconsumed(items)
    return f"trial parse left {share:.1%} of tokens unconsumed (maximum {most:.0%})" if share > most else ""


def _foreign(text: str, marks: tuple[str, ...]) -> str:
    return next((f"foreign separator {m!r} is not consumed" for m in marks if m in text), "")


def _sides(items: list[Item]) -> list[dict]:
    return [a for i in items if i.parse for a in (i.parse["lemma_attribution"], *(r["attribution"] for r in i.parse["readings"]))]


# Convention: verse.
EDITIONS = {
    "ECM": "Editio Critica Maior",
    "Greeven": "Huck–Greeven, Synopse der drei ersten Evangelien (1981)",
    "Holmes": "Michael W. Holmes, The Greek New Testament: SBL Edition (2010)",
    "JJM": "J. J. Griesbach (apud SBLGNT apparatus)",
    "NA": "Nestle–Aland, Novum Testamentum Graece",
    "NIV": "Goodrich–Lukaszewski, A Reader's Greek New Testament (2003)",
    "RP": "Robinson–Pierpont, The New Testament in the Original Greek: Byzantine Textform (2005)",
    "SBL": "The Greek New Testament: SBL Edition (Holmes 2010)",
    "TR": "Textus Receptus",
    "Treg": "Tregelles, The Greek New Testament (1857–1879)",
    "WH": "Westcott–Hort, The New Testament in the Original Greek (1881)",
    "WHspur": "Westcott–Hort, passages printed within double brackets (deemed spurious)",
}
_EDITION = "(?:" + "|".join(sorted(set(EDITIONS) - {"WHspur"}, key=len, reverse=True)) + ")"
_SIGLUM = re.compile(f"{_EDITION}(?:app|ed|marg|spur|txt)?")
_GLUED = re.compile(f"(.*?[ἀ-῿Ͱ-Ͽ])({_EDITION}(?:app|ed|marg|txt)?)")
_REFERENCE = re.compile(f"{NUM}:{NUM}(?:[–-]{NUM}(?::{NUM})?)?")
_VERSE = re.compile(SPAN)
_SPURIA = re.compile(r"〚\s*WH\s*〛")
_VERSE_TOKEN = re.compile(_SPURIA.pattern + r"|•|[^•\s]+")


def is_edition(token: str) -> bool:
    return bool(_SIGLUM.fullmatch(token.strip("·;,.")))


def looks_verse(text: str) -> bool:
    one = flat(text)
    return " ] " in one and bool(re.match(rf"{NUM}:{NUM}\s", one))


def split_verse(text: str) -> list[Item]:
    tokens = []
    for m in _VERSE_TOKEN.finditer(text):
        if _SPURIA.fullmatch(m[0]):
            tokens.append(("WHspur", m.start(), m.end()))
            continue
        at = m.start()
        for piece in re.split("(?<=–)(?=[A-Z])", m[0]):
            tokens.append((piece, at, at + len(piece)))
            at += len(piece)
    items: list[Item] = []
    chapter, loc, words, begin, after_siglum = "", "", [], None, False

    def close(end: int) -> None:
        if words and loc and begin is not None:
            raw = " ".join(words)
            items.append(Item(loc, raw, text[begin:end].strip(), f"{loc} {raw}"))
        words.clear()

    for token, a, z in tokens:
        opens = None
        if _REFERENCE.fullmatch(token):
            opens, chapter = token, token.partition(":")[0]
        elif after_siglum and chapter and _VERSE.fullmatch(token):
            opens = f"{chapter}:{token}"
        if opens or token == "•":
            close(a)
            begin, loc, after_siglum = (a, opens, False) if opens else (z, loc, False)
            continue
        begin = a if begin is None else begin
        words.append(token)
        after_siglum = is_edition(token)
    close(len(text))
    return items


def _editions_off(words: list[str]) -> tuple[list[str], list[str]]:
    words, sigla = list(words), []
    while words:
        last = words[-1]
        if is_edition(last):
            sigla.insert(0, last.strip("·;,."))
            del words[-2 if words[-2:-1] == ["em"] else -1 :]
        elif m := _GLUED.fullmatch(last):
            words[-1] = m[1]
            sigla.insert(0, m[2])
        else:
            break
    return words, sigla


def plain_word(w: str) -> str:
    return w.strip("()«»?!:·;,.").lower()


def _half(w: str) -> str:
    """One half of a word printed twice without a gap."""
    k = len(w) // 2
    return w[:k] if len(w) >= 4 and len(w) % 2 == 0 and plain_word(w[:k]) == plain_word(w[k:]) else w


def parse_verse(item: Item, reg: Registry) -> Parse | None:
    left, bracket, right = item.raw.partition("]")
    if not bracket:
        return None
    words, sigla = _editions_off(left.split())
    words = [re.sub("[⸀-⸏][0-9]?", "", w) for w in words]
    words = [_half(w) for w in (re.sub("^[0-9](?=[ἀ-῿Ͱ-Ͽ])", "", w) for w in words) if w]
    if not words:
        return None
    segments: list[str] = []
    for seg in right.split(";"):
        if segments and not _editions_off(segments[-1].split())[1]:
            segments[-1] += ";" + seg
        else:
            segments.append(seg)
    readings, spurious = [], False
    for seg in segments:
        said, by = _editions_off(seg.split())
        text = " ".join(said)
        dash = text in {"-", "—", "–"}
        text = "" if dash else text
        if text or by:
            if by == ["WHspur"] and not (text or dash):
                spurious = True
            else:
                readings.append((text, nobody() | {"witnesses": by}))
    if spurious:
        sigla = sigla + ["WHspur"]
    if not (readings or spurious) or readings and not any(a["witnesses"] for _, a in readings):
        return None
    return parsed(" ".join(words), nobody() | {"witnesses": sigla}, readings)


def gate_verse(text: str, items: list[Item], reg: Registry | None) -> str:
    if not items:
        return "verse-reference splitting found no entry"
    if reason := _foreign(text, ("||", "∥", " | ")):
        return reason
    n = len(items)
    orphans = max(0, text.count("]") - n)
    if orphans > max(1, n // 5):
        return f"{orphans} orphan ']' closer(s) beyond the {n} split verse entries signal an unconsumed foreign structure"
    good = sum(i.parse is not None for i in items) / n
    if good < 0.6 and unconsumed(items) > 0.1:
        return f"trial parse left {unconsumed(items):.1%} of tokens unconsumed and only {good:.0%} of entries parsed"
    sides = _sides(items)
    named = sum(bool(a["witnesses"]) for a in sides)
    share = named / max(1, len(sides))
    return f"only {named}/{len(sides)} trial sides carry edition sigla ({share:.1%}; minimum 90%)" if share < 0.9 else ""


def verse_candidates(lemma: str) -> list[str]:
    """Forms of a printed lemma in the order in which the text is asked for them; '§' marks an optional space."""
    words, out = lemma.split(), [lemma]
    k = len(words) // 2
    same = [plain_word(w) for w in words]
    if words and len(words) % 2 == 0 and same[:k] == same[k:]:
        out.append(" ".join(words[k:]))
    solid = "".join(words)
    c = len(solid) // 2
    if solid and len(solid) % 2 == 0 and solid[:c].lower() == solid[c:].lower():
        out.append("§".join(solid[c:]))
    once = [w for i, w in enumerate(words) if i == 0 or same[i] != same[i - 1]]
    if len(once) < len(words):
        out.append(" ".join(once))
    return [x for x in out if x]


# Convention: line.
_LINE = re.compile(rf"{NUM}(?:[.]{NUM})?(?:[–-]{NUM}(?:[.]{NUM})?)?")
_NO_BAR = re.compile(rf"([0-9]+[.][0-9]+|[?)][?]?)\s+(?={SPAN}\s+\S)")
_NEXT = re.compile(rf"{SPAN}\s+.{{1,120}}?(?:\s[|]\s|\])", re.S)
_AMBIGUOUS = re.compile(rf"(?:\s[|]\s|^)\s*[(][^)]*[)][?]?\s+{SPAN}\s+\S")
_RELATIVE = re.compile(r",?\s+(?:cuius|qua|quae|quam|quas|quem|qui|quibus|quod|quos|ubi|ut)\b.*$")
_CITES = re.compile(r"(?<=\s)(?:cf[.]|coll[.]|teste|testibus|u[.]|uoce|uocibus|ut\s+glossema|ex(?=\s+[0-9]))(?=\s|$)")
_BELOW = re.compile(r",?\s+\S+\s+(?:supra|infra)\s+(?:secutus|sequens|sequitur|seruat\w*)\b.*$")
_GAP = re.compile(r",?\s+quam\s+lacunam\b.*$")
_WHETHER = re.compile(r"\s+an\s+\S+ndum\b.*$")
_OTHERS = re.compile(r"\S+\s+ali[ao]s\s+alii")
_LAST_PAREN = re.compile(r"[(][^()]*[)][;,.?\s]*$")
_UNLESS = re.compile(r"\s+nisi\s+mauis\b.*$")
_ABLATIVE = re.compile(r",?\s+(?:de\s+)?(?:relicto|sensu|compendi[oi]s?)\b.*$")


def looks_line(text: str) -> bool:
    one = flat(text)
    return " | " in one and "∥" in one


def _balanced(text: str, upto: int) -> bool:
    return text.count("(", 0, upto) == text.count(")", 0, upto)


def _unbarred(chunk: str) -> list[str]:
    """A chunk cut where the bar is left out: after a closing note, a '?' or a bare locus, before a line number."""
    parts, start = [], 0
    for m in _NO_BAR.finditer(chunk):
        cut = m.end(1)
        ok = _balanced(chunk, cut)
        if ok and m[1][0] == ")":
            opener = chunk.rfind("(", start, cut)
            side = max(chunk.rfind("|", start, opener), start - 1) + 1
            ok = bool(chunk[side:opener].strip()) and _NEXT.match(chunk[m.end() :]) is not None
        if ok:
            parts.append(chunk[start:cut])
            start = m.end()
    return parts + [chunk[start:]]


def split_line(text: str) -> list[Item]:
    items, line = [], ""
    for chunk in (piece.strip() for bar in text.split("∥") for piece in _unbarred(bar)):
        words, own = chunk.split(), ""
        if words and _LINE.fullmatch(words[0]):
            own = line = words.pop(0)
        crux = words[:1] == ["◊"]
        raw = " ".join(words[crux:])
        if raw:
            items.append(Item(own or line, raw, chunk, " ".join(x for x in (own or line, "◊" * crux, raw) if x), crux))
    return items


class _Notes(list):
    """Comments of one entry, taken off the segments' ends."""

    def cut(self, seg: str, at: int, strip: str = " ,") -> str:
        self.append(seg[at:].strip(strip) if strip else seg[at:].strip())
        return seg[:at]


def _reference_at(seg: str) -> int | None:
    return next((m.start() for m in _CITES.finditer(seg) if _balanced(seg, m.start())), None)


def _tail_parens(seg: str, notes: list[str]) -> str:
    while m := _LAST_PAREN.search(seg):
        notes.append(m[0].strip())
        seg = seg[: m.start()].rstrip()
    return seg


def _unless(seg: str, notes: list[str]) -> list[tuple[str, dict]]:
    """The forms of 'nisi mauis X [uel Y]'; an action instead of a form makes the whole segment a note."""
    forms, own = [], []
    for part in re.split(r"\s+uel\s+(?![^(]*[)])", seg[len("nisi mauis ") :].strip()):
        said: list[str] = []
        if (k := _reference_at(part)) is not None:
            said.append(part[k:].strip())
            part = part[:k].rstrip()
        part = _tail_parens(part, said)
        if not part or part.split()[-1].endswith("re"):
            notes.append(seg)
            return []
        forms.append((part, nobody() | {"qualifiers": ["nisi mauis"]}))
        own += said
    notes += own
    return forms


def _last_word(text: str) -> str:
    return bare(text.split()[-1]) if text.split() else ""


def _strip_narrative(seg: str, notes: _Notes, reg: Registry) -> str:
    """Editorial narrative off a segment, in the fixed order in which its kinds are looked for."""
    if m := _RELATIVE.search(seg):
        last = _last_word(seg[: m.start()])
        if reg.is_witness(last) or reg.is_editor(last) or last in QUALIFIERS or last.endswith(")") or len(burst([last], reg)) > 1:
            seg = notes.cut(seg, m.start())
    if (m := _BELOW.search(seg)) and m.start():
        seg = notes.cut(seg, m.start())
    if m := _GAP.search(seg):
        last = _last_word(seg[: m.start()])
        if reg.is_editor(last) or last in QUALIFIERS:
            seg = notes.cut(seg, m.start())
    for pattern in (_WHETHER, _UNLESS, _ABLATIVE):
        if m := pattern.search(seg):
            seg = notes.cut(seg, m.start(), " ," if pattern is _ABLATIVE else "")
    seg = re.sub("(?<=[A-Za-zø-ÿà-ö]),(?=[0-9])", " ", seg)

    def inside(m: re.Match) -> str:
        said = m[0][1:-1].strip()
        if said.startswith(("per", "sc.", "uel")) or said[:1].isupper():
            return m[0]
        notes.append(m[0])
        return " "

    seg = re.sub(r"(?<=\s)[(][^()]*[)](?=\s)", inside, seg)
    opened, closed = seg.count("("), seg.count(")")
    if opened != closed and opened:
        seg = notes.cut(seg, seg.index("("), "").rstrip()
    elif closed > opened:
        if m := re.search(r",?\s+(?:et,?\s+)?de\s+\S.*$", seg) or re.search(r"\s*[)].*$", seg):
            seg = notes.cut(seg, m.start())
    if (k := _reference_at(seg)) is not None:
        seg = notes.cut(seg, k, "")
    return _tail_parens(seg, notes)


def _is_note(seg: str) -> bool:
    if seg.startswith("lacunam ") or _OTHERS.fullmatch(seg):
        return True
    if any(_balanced(seg, m.start()) for m in re.finditer(r"…|[.]{3}", seg)):
        return True
    return seg.startswith(("post ", "transposu")) and re.search(r"\btranspos", seg) is not None


def parse_line(item: Item, reg: Registry) -> Parse | None:
    if _AMBIGUOUS.search(item.raw):
        return None
    segments = [s.strip() for s in re.split(r"(?<=\s)[|](?=\s)", f" {item.raw} ")]
    if not segments[0]:
        return None
    notes, sides = _Notes(), []
    spaced = [e for e in reg.editors if " " in e]
    for k, seg in enumerate(segments):
        before = len(notes)
        for name in spaced:
            seg = seg.replace(name, name.replace(" ", ""))
        if k and seg.startswith("nisi mauis "):
            sides += _unless(seg, notes)
            continue
        if k and _is_note(seg):
            notes.append(seg)
            continue
        seg = _strip_narrative(seg, notes, reg)
        words = burst(seg.split(), reg)
        at = next((i for i in range(1, len(words)) if words[i] == "uel" and bare(words[i - 1]) in reg.witnesses), None)
        if at is not None:
            notes.append(" ".join(words[at:]))
            words = words[:at]
        doubt = words[:1] == ["an"]
        if doubt:
            action = len(words) > 1 and words[1].rstrip("?").endswith("ndum")
            if action or any(x in c for c in notes[before:] for x in ("u. infra", "u. supra", "u. et supra")):
                notes.append(seg)
                continue
            words = words[1:]
            if words and words[-1] in ("?.", "?"):
                words.pop()
            elif words:
                words[-1] = words[-1].rstrip("?")
        text, a = peel(" ".join(words), reg)
        if text and not (a["witnesses"] or a["editors"]):
            # narrative after the editor hides the attribution: cut behind the last editor inside
            w = text.split()
            inner = [i for i in range(1, len(w) - 1) if reg.is_editor(w[i].rstrip(";,."))]
            if inner:
                shorter, b = peel(" ".join(w[: inner[-1] + 1]), reg)
                if not is_empty(b):
                    notes.append(" ".join(w[inner[-1] + 1 :]))
                    text, a = shorter, b
        text = re.sub(r"(?<=[a-zA-Zø-ÿà-ö])[0-9](?=\s|$)", "", text)
        if text.endswith("]") and text.count("[") < text.count("]"):
            text = text[:-1].rstrip()
        if doubt:
            a["qualifiers"].insert(0, "an?")
        if "ed. pr." in a["qualifiers"]:
            a["qualifiers"].remove("ed. pr.")
            a["editors"].append("ed. pr.")
        sides.append((text, a))
    if not sides or not sides[0][0]:
        return None
    lemma, by = sides[0]
    if item.crux:
        by["qualifiers"].insert(0, "◊")
    readings = []
    for text, a in sides[1:]:
        if text or a["witnesses"] or a["editors"]:
            readings.append((text, a))
        elif a["qualifiers"]:
            notes.append(" ".join(a["qualifiers"]))
    return parsed(lemma, by, readings, list(notes))


def gate_line(text: str, items: list[Item], reg: Registry | None) -> str:
    if reg is None:
        return "no registry is available for a trial parse"
    if len(items) < 2:
        return f"only {len(items)} entry was split"
    if reason := _foreign(text, ("||", "•")) or _left_over(items, 0.2):
        return reason
    sides = _sides(items)
    named = sum(not is_empty(a) for a in sides)
    share = named / max(1, len(sides))
    return f"only {named}/{len(sides)} trial sides carry convention attribution ({share:.1%}; minimum 60%)" if share < 0.6 else ""


# Convention: numbered lemmas closed by a bracket: paragraph and Teubner.
BOUNDARY = re.compile(rf"(?<!\S)({SPAN})\s+([^\]]{{1,120}}?)\s*\]")
_LOCUS_INSIDE = re.compile(r"[0-9]+[.:][0-9]+|(?<!\S)[0-9]+(?:[–-][0-9]+)?(?!\S)")
_OPERATORS = [o.split() for o in ("add. sed del.", "plus lectiones", "corr. ex", "in marg.", "in textu", "interl.", "iterum", "add.", "om.")]
_FOLIO = re.compile("[(][^()]*[)]")


def looks_paragraph(text: str) -> bool:
    one = flat(text)
    return not any(x in one for x in (" : ", " | ", "∥")) and len(BOUNDARY.findall(one)) > 1


def _cut(text: str, hits: list[re.Match]) -> list[Item]:
    ends = [h.start() for h in hits[1:]] + [len(text)]
    pieces = [(h[1], text[h.start() : z].strip()) for h, z in zip(hits, ends)]
    return [Item(line, flat(s), s) for line, s in pieces if s]


def split_paragraph(text: str) -> list[Item]:
    """What stands before the first boundary is an item of its own that nothing parses."""
    hits, at = [], 0
    while m := BOUNDARY.search(text, at):
        head = m[2].partition("…")[0]
        if not m[2].strip().isdigit() and _LOCUS_INSIDE.search(head):
            at = m.end(1)
        else:
            hits.append(m)
            at = m.end()
    before = text[: hits[0].start()].strip() if hits else text.strip()
    return ([Item("", flat(before), before, boundary=False)] if before else []) + _cut(text, hits)


def _operator(words: list[str], i: int) -> list[str] | None:
    return next((o for o in _OPERATORS if words[i : i + len(o)] == o), None)


def parse_paragraph(item: Item, reg: Registry) -> Parse | None:
    m = BOUNDARY.match(item.raw)
    if not m:
        return None
    words = item.raw[m.end() :].split()
    is_wit = lambda k: k < len(words) and reg.is_witness(bare(words[k]))
    done: list[tuple[str, dict, list[str]]] = []
    text, a, notes, running, operator = [], nobody(), [], False, None

    def close() -> None:
        nonlocal text, a, notes, running, operator
        said = " ".join(text)
        if said or not is_empty(a):
            done.append((said, a, notes))
        text, a, notes, running, operator = [], nobody(), [], False, None

    i = 0
    while i < len(words):
        w = words[i]
        if running and _FOLIO.fullmatch(w):
            notes.append(w)
            i += 1
        elif running and not is_wit(i):
            close()
        elif op := _operator(words, i):
            operator = " ".join(op)
            a["qualifiers"].append(operator)
            i += len(op)
            if operator == "corr. ex":
                if i < len(words) and all(map(is_wit, range(i, len(words)))):
                    return None
                first = i
                while i < len(words) and not is_wit(i) and not _operator(words, i):
                    i += 1
                if i > first:
                    notes.append(" ".join(["corr. ex", *words[first:i]]))
        elif is_wit(i):
            s = bare(w)
            if s in a["witnesses"]:
                leading = a["witnesses"][0] == s and not text and not a["qualifiers"]
                if not leading and bare(words[i - 1]) != s:
                    return None
                a["witnesses"].remove(s)
                if not leading:
                    close()
                text.append(s)
            a["witnesses"].append(s)
            running = True
            i += 1
        elif operator not in (None, "plus lectiones"):
            close()
        else:
            text.append(w)
            i += 1
    close()
    while done and not done[-1][1]["witnesses"] and re.fullmatch(r"[0-9\s–-]+", done[-1][0] or " "):
        done.pop()
    if not any(x[1]["witnesses"] or x[1]["qualifiers"] for x in done):
        return None
    return parsed(m[2].strip(), nobody(), [(t, b) for t, b, _ in done], [c for *_, said in done for c in said])


def gate_paragraph(text: str, items: list[Item], reg: Registry | None) -> str:
    own = [i for i in items if i.boundary]
    n = len(own)
    if n < 2:
        return f"only {n} numbered lemma boundary/boundaries found"
    if reason := _foreign(text, ("||", "∥", " | ", "•")):
        return reason
    orphans = max(0, text.count("]") - n)
    if orphans > max(1, n // 5):
        return f"{orphans} orphan ']' closer(s) beyond the {n} split boundaries signal an unconsumed foreign structure"
    head = "" if items[0].boundary else items[0].source
    if head and len(head.split()) < 7 and not any(map(str.isdigit, head)):
        return "a short non-locus preamble signals a tier heading, not a fontes tier"
    if reason := _left_over(own, 0.2):
        return reason
    loose = sum(bool(r["text"]) and is_empty(r["attribution"]) for i in own if i.parse for r in i.parse["readings"])
    return f"trial parse left {loose} nonempty reading segment(s) without a witness or operator" if loose else ""


def looks_teubner(text: str) -> bool:
    one = flat(text)
    return " : " in one and not any(x in one for x in ("||", " | ", "∥")) and BOUNDARY.search(one) is not None


def split_teubner(text: str) -> list[Item]:
    return _cut(text, list(BOUNDARY.finditer(text)))


def parse_teubner(item: Item, reg: Registry) -> Parse | None:
    m = BOUNDARY.match(item.raw)
    if not m:
        return None
    sides = [peel(s, reg) for s in re.split(r"\s+:\s+", item.raw[m.end() :].strip()) if s.strip()]
    if any(not t and not a["qualifiers"] for t, a in sides) or all(is_empty(a) for _, a in sides):
        return None
    return parsed(m[2].strip(), nobody(), sides)


def gate_teubner(text: str, items: list[Item], reg: Registry | None) -> str:
    if not looks_teubner(text):
        return "band lacks the line-lemma] + ' : ' signature"
    if not items:
        return "no LINE lemma] boundary was split"
    if reason := _left_over(items, 0.2):
        return reason
    good = [i.parse for i in items if i.parse]
    if not good:
        return "trial parse produced no structured entry"
    named = sum(not is_empty(r["attribution"]) for p in good for r in p["readings"])
    return f"only {named} attributed reading(s) across {len(good)} parsed entries — a negative apparatus still names who diverges" if named < len(good) else ""


# Convention: Budé.
_CONTINUES = re.compile(rf"[|]{{2}}\s*{SPAN}\s+(?:(?!\s+:\s)[^\]:]){{1,40}}\]")
_STORY = re.compile(r"difficile|euanid|extra\s+marginem|inscriptio|legitur|littera|primae?|primera|uerbum|in\s+[A-Z]\b", re.I)
_PLACE = re.compile(r"([0-9]+(?:[.][0-9]+)?(?:[–-][0-9]+)?[¹²³]?)(?:\s+|$)")
_SECTION = re.compile(r"(?<=\s)[0-9]+[.][0-9]+(?=\s)")


def looks_bude(text: str) -> bool:
    one = flat(text)
    return "||" in one and " : " in one and not _CONTINUES.search(one) and not looks_line(one)


def split_bude(text: str) -> list[Item]:
    items, line = [], ""
    for chunk in re.split(r"\s*[|]{2}\s*", text):
        cuts = [0, *(m.start() for m in _SECTION.finditer(chunk)), len(chunk)]
        for source in (chunk[a:z].strip() for a, z in zip(cuts, cuts[1:])):
            if source:
                raw = flat(source)
                if m := _PLACE.match(raw):
                    line = m[1]
                items.append(Item(line, raw, source))
    return items


def _placed(text: str) -> str:
    m = _PLACE.match(text)
    return text[m.end() :].strip() if m else text


def _odd_lemma(lemma: str) -> bool:
    return len(lemma.split()) > 8 or _STORY.search(lemma) is not None or re.search("[Α-ΩA-Z]{2,}", lemma) is not None


def parse_bude(item: Item, reg: Registry) -> Parse | None:
    left, colon, right = item.raw.partition(" : ")
    if not colon:
        rest = _placed(" ".join(burst(item.raw.split(), reg)))
        lemma, om, tail = rest.partition("om.")
        lemma = lemma.strip()
        a = peel(f"om. {tail}".strip(), reg)[1]
        return parsed(lemma, nobody(), [("", a)]) if om and lemma and not is_empty(a) and not _odd_lemma(lemma) else None
    if not left.strip() or not right.strip():
        return None
    lemma, by = peel(" ".join(burst(left.split(), reg)), reg)
    lemma = _placed(lemma)
    text, a = peel(" ".join(burst(right.split(), reg)), reg)
    if not lemma or is_empty(a) or not text and not a["qualifiers"]:
        return None
    if _odd_lemma(lemma) or _STORY.search(text) or "om." in text or "]" in text:
        return None
    return parsed(lemma, by, [(text, a)])


def gate_bude(text: str, items: list[Item], reg: Registry | None) -> str:
    if _CONTINUES.search(flat(text)):
        return "foreign separator '||' precedes a LINE lemma] boundary (paragraph continuation, not a Budé entry separator)"
    if "||" not in text:
        return "band has no '||' entry separator"
    n, good = len(items), sum(i.parse is not None for i in items)
    if n < 2:
        return f"only {n} '||'-separated chunk(s)"
    if good < 2:
        return f"only {good} '||'-chunk(s) trial-parsed (minimum 2)"
    return f"only {good}/{n} '||'-chunks trial-parsed ({good / n:.1%}; minimum 30%)" if good / n < 0.3 else ""


# Convention: marker.
def _capitals() -> str:
    import unicodedata

    ranges = [(0x41, 0x5A), (0x386, 0x3A9), (0x1F00, 0x1FFC)]
    return "".join(chr(c) for a, z in ranges for c in range(a, z + 1) if unicodedata.category(chr(c)) in ("Lu", "Lt"))


_OPENS = rf"[0-9]{{1,2}}\s+(?=[\[⟨{{<]?[{_capitals()}])"
_WIDE = re.compile(rf"(?:^|(?<=\s\s))({_OPENS})")
_AT_LINE = re.compile(rf" ?({_OPENS})")
_REJOIN = re.compile(r"(?<=\w)-\s+(?=[α-ωø-ÿà-öa-z])")
_FOREIGN_HEAD = re.compile(r"(?:fin|hab|init|om|pr|tr)\s")
_FOREIGN_SIGLUM = re.compile("[0-9]{1,4}-[0-9]{1,4}°?|[0-9]+°")
MARKER_UNCONSUMED = 0.6


def split_marker(text: str) -> list[Item]:
    """Numbers before a capital, after a wide gap or at a line's start, outside parentheses and strictly rising. What
    stands before the first is a head without an anchor."""
    starts = {m.start(1): m for m in _AT_LINE.finditer(text) if m.start() == 0 or text[m.start() - 1] == "\n"}
    starts |= {m.start(1): m for m in _WIDE.finditer(text)}
    depth = last = scanned = 0
    cuts: list[re.Match] = []
    for at in sorted(starts):
        depth += text.count("(", scanned, at) - text.count(")", scanned, at)
        scanned = at
        number = int(starts[at][1].split()[0])
        if depth <= 0 and number > last:
            last = number
            cuts.append(starts[at])
    head = text[: cuts[0].start(1)].strip() if cuts else text.strip()
    items = [Item("", head.replace("\n", " "), head, boundary=False)] if head else []
    for m, z in zip(cuts, [c.start(1) for c in cuts[1:]] + [len(text)]):
        if source := text[m.end(1) : z].strip():
            items.append(Item(m[1].split()[0], source.replace("\n", " "), source))
    return items


def _is_commentary(content: str, reg: Registry) -> bool:
    words = content.split()
    if content.startswith("=") or " : " in content or re.search(r"\d", content):
        return True
    if len(words) > 1 and words[0].rstrip("·:;,.") in CONNECTORS:
        return True
    if any(q in content for q in LONG_QUALIFIERS if not q.startswith("per ")):
        return True
    tokens = [w.strip("·:;,.") for w in words]
    return any(t in SOURCES or t in {"add", "cf", "del", "om"} or t + "." in QUALIFIERS or reg.is_editor(t) or reg.is_editor(t + ".") for t in tokens)


def parse_marker(item: Item, reg: Registry) -> Parse | None:
    notes: list[str] = []

    def paren(m: re.Match) -> str:
        if not _is_commentary(m[0][1:-1].strip(), reg):
            return m[0]
        notes.append(m[0])
        return " "

    text = re.sub("[(][^)]*[)]", paren, _REJOIN.sub("", item.raw))
    if m := re.search("[(][^)]*$", text):
        notes.append(m[0])
        text = text[: m.start()]
    text = re.sub(r"\s+", " ", text).strip()
    if text.count("[") < text.count("]") or _FOREIGN_HEAD.match(text):
        return None
    text = text.replace(" corr. ex ", " : corr. ex ")
    head, *rest = [s.strip() for s in text.split(" : ")]
    if not rest:
        return _action(text, notes, reg)
    lemma, by = peel(head, reg)
    readings = [peel(s, reg) for s in rest]
    if not lemma or any(not t and is_empty(a) for t, a in readings):
        return None
    for a in (by, *(a for _, a in readings)):
        if a["references"] and "cf." not in a["qualifiers"] and not re.search("[a-zA-Z]", "".join(a["references"])):
            return None
    if any(_FOREIGN_SIGLUM.fullmatch(w.strip(":;,.")) for t in (lemma, *(t for t, _ in readings)) for w in t.split()):
        return None
    return parsed(lemma, by, readings, notes)


def _action(text: str, notes: list[str], reg: Registry) -> Parse | None:
    """An entry without a variant: an editorial action on the lemma, or a transposition to a named place."""
    if m := re.search(r"\s(ante|post)\s", text):
        target, a = peel(text[m.end() :], reg)
        lemma, own = peel(text[: m.start()], reg)
        if lemma and not is_empty(a):
            merged = a | {k: own[k] + a[k] for k in ("editors", "witnesses")}
            merged["qualifiers"] = own["qualifiers"] + [f"{m[1]} {target}".strip()] + a["qualifiers"]
            return parsed(lemma, merged, [], notes)
    lemma, a = peel(text, reg)
    return parsed(lemma, a, [], notes) if lemma and not is_empty(a) else None


def gate_marker(text: str, items: list[Item], reg: Registry | None, resolved: int = 0) -> str:
    own = [i for i in items if i.boundary]
    if not own:
        return "numeric-marker entry splitting found no boundary"
    if resolved < 1:
        return "0 numeric markers resolved against the text layer"
    band = " ".join(i.source for i in items)
    if reason := _foreign(band, ("||", "∥")):
        return reason
    if (closers := band.count("]") - band.count("[")) > 0:
        return f"{closers} unmatched ']' lemma separator(s) are not consumed"
    if reg is None:
        return "no registry is available for a trial parse"
    if reason := _left_over(own, MARKER_UNCONSUMED):
        return reason
    good = [i.parse for i in own if i.parse]
    if 2 * len(good) < len(own):
        return f"only {len(good)}/{len(own)} marker entries parsed in trial (minimum 50%)"
    said = [r["attribution"] for p in good for r in p["readings"]]
    if not any(a["witnesses"] or a["editors"] or a["sources"] for a in said):
        return f"no witness, editor or source is named on any of the {len(said)} reading(s) proposed by {len(good)}/{len(own)} trial-parsed entries — a numbered prose band, not a variant apparatus"
    return ""


@dataclass(frozen=True)
class Grammar:
    name: str
    kind: str
    looks: Callable[[str], bool]
    split: Callable[[str], list[Item]]
    parse: Callable[[Item, Registry], Parse | None]
    gate: Callable[..., str]
    needs_registry: bool


#: The order of dispatch; the marker convention takes what none of these claims.
GRAMMARS = (
    Grammar("verse", "verse", looks_verse, split_verse, parse_verse, gate_verse, False),
    Grammar("line", "line", looks_line, split_line, parse_line, gate_line, False),
    Grammar("bude", "line", looks_bude, split_bude, parse_bude, gate_bude, True),
    Grammar("teubner", "line", looks_teubner, split_teubner, parse_teubner, gate_teubner, True),
    Grammar("paragraph", "line", looks_paragraph, split_paragraph, parse_paragraph, gate_paragraph, True),
)
MARKER = Grammar("marker", "marker", lambda text: True, split_marker, parse_marker, gate_marker, False)


def grammar_of(text: str, reg: Registry | None) -> Grammar:
    return next((g for g in GRAMMARS if (reg is not None or not g.needs_registry) and g.looks(text)), MARKER)
