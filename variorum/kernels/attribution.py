"""Attributions: the run of witnesses, editors, qualifiers, cited versions and loci that ends a segment.

The order of the tests is the meaning: the last word is taken by the first rule that knows it, and the first word no
rule knows ends the run. What is left is the reading, untouched.
"""

from __future__ import annotations

import re
from functools import lru_cache

from variorum.kernels.registry import CONNECTORS, DISCOURSE, FIRST_PERSON, QUALIFIERS, SOURCES, Registry

KINDS = ("witnesses", "editors", "qualifiers", "sources", "references")
_STRAY = frozenset(",;:.·")
_WORKS = "Aen Apol Beitr Cic Cor Dial Ex Gal Gen Hirt Hist Is Jer Jn Lc Liv Mc Mt Ps Rom Tac Virg p".split()
_CODES = "BAfr BAlex BC BG BHisp TLL".split()
_YEAR = "[0-9]{4}[a-z]"
_LOCUS = re.compile("|".join([*(re.escape(w + ".") for w in _WORKS), "Beitr[.],", *_CODES, "[LIVX]+", "[0-9]+[.,:]?", _YEAR, f"{_YEAR}?[–-]{_YEAR}?", r"[0-9]+([.][0-9]+)+", r"n[.][0-9]+"]))
_ROMAN = re.compile("[CDILMVX]+")
_NUMERAL = re.compile("[CDILMVX]+|[0-9]+[.,:]?")


def nobody() -> dict[str, list[str]]:
    return {k: [] for k in KINDS}


def is_empty(a: dict[str, list[str]]) -> bool:
    return not any(a.values())


def bare(token: str) -> str:
    return token.rstrip(":;.,")


@lru_cache(1 << 16)
def _forms(token: str) -> tuple[str, ...]:
    """As printed, without a trailing comma, without trailing stops, and with its dot again if longer than a letter."""
    b = bare(token)
    return (token, token.rstrip(","), b, *([b + "."] if len(b) > 1 else []))


@lru_cache(1 << 16)
def _is_locus(token: str) -> bool:
    return _LOCUS.fullmatch(token) is not None


@lru_cache(1 << 16)
def _is_technical(token: str) -> bool:
    """Whether any edition's apparatus means the same by it: glue, a qualifier, a cited version or a locus."""
    b = bare(token)
    return token in _STRAY or b in CONNECTORS or any(f in QUALIFIERS or f in SOURCES for f in (token, b, b + ".")) or _is_locus(token.rstrip(",")) or _is_locus(b)


def _known(token: str, reg: Registry) -> bool:
    b = bare(token)
    return _is_technical(token) or reg.is_witness(b) or reg.is_editor(b) or reg.is_editor(b + ".")


def peel(segment: str, reg: Registry) -> tuple[str, dict[str, list[str]]]:
    """The reading's text and its attribution, lists in printed order."""
    left, found, held = segment.split(), nobody(), []

    def take(kind: str, value: str, words: int = 1) -> None:
        found[kind].insert(0, value)
        del left[-words:]
        held.clear()

    while left:
        last, before = left[-1], left[-2] if len(left) > 1 else None
        if before is not None and last in _STRAY:
            left.pop()
            continue
        if before is not None and (pair := f"{before} {last}".rstrip(",")) in QUALIFIERS:
            take("qualifiers", pair, 2)
            continue
        forms = _forms(last)
        known_before = before is not None and _known(before, reg)
        if q := next((f for f in forms if f in QUALIFIERS), None):
            if q in DISCOURSE and (not known_before or bare(before) in DISCOURSE or bare(before) in CONNECTORS):
                break
            take("editors" if q in FIRST_PERSON else "qualifiers", q)
            continue
        if s := next((f for f in forms if f in SOURCES), None):
            take("sources", s)
            continue
        plain = last.rstrip(",")
        if _is_locus(plain) and not reg.is_witness(plain):
            if _NUMERAL.fullmatch(plain) and not known_before:
                break
            take("references", plain)
        elif w := next((f for f in forms if reg.is_witness(f)), None):
            if before is None and _ROMAN.fullmatch(bare(last)):
                break
            take("witnesses", w.rstrip(";,"))
        elif e := next((f for f in forms if reg.is_editor(f)), None):
            take("editors", e.rstrip(";,"))
        elif plain in CONNECTORS and not is_empty(found):
            held.append(plain)
            left.pop()
        else:
            break
    return " ".join(left + held[::-1]).strip(), found


_SOLID = re.compile("[A-Za-zΑ-Ωα-ωϘ-ϡ*]{2,}")


def burst(words: list[str], reg: Registry) -> list[str]:
    """Glued sigla apart, longest siglum first and greedily, where a whole token dissolves into two or more of them."""
    sigla = reg.longest_first()
    if not sigla:
        return words
    out: list[str] = []
    for word in words:
        core = word.rstrip(".,;:¹²³")
        if len(core) == 1 and reg.is_witness(core):
            out.append(core)
            continue
        parts, rest = [], core if _SOLID.fullmatch(core) else ""
        while rest:
            head = next((s for s in sigla if rest.startswith(s)), None)
            if not head:
                parts = []
                break
            parts.append(head)
            rest = rest[len(head) :]
        if len(parts) < 2:
            out.append(word)
        else:
            parts[-1] += word[len(core) :].lstrip("¹²³")
            out += parts
    return out
