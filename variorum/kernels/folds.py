"""The comparators' folds. Each compares one kind of source with its print and forgives what that pair differs in by
layout alone, so they differ on purpose and aren't to be merged. A fold is a list of steps over the text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

Step = Callable[[str], str]


def _swap(pattern: str, by: str) -> Step:
    rx = re.compile(pattern)
    return lambda s: rx.sub(by, s)


def _bare(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).lower()


def _compatible(s: str) -> str:
    return unicodedata.normalize("NFKC", s)


def _single(s: str) -> str:
    return " ".join(s.split())


_SIGMA = _swap("ς", "σ")
_BROKEN_WORD = _swap(r"(?<=\w)-\s+", "")
_BROKEN = _swap(r"(?<=\S)-\s+", "")
#: Stands for an ellipsis while the compatible form would dissolve it.
_HELD = "\ue000"

FOLDS: dict[str, list[Step]] = {
    # typeset from our own source: quotes and dashes as the typesetter prints them, glyphs that its font lacks as one joker
    "golden": [_BROKEN, _swap("[–—]", " "), _swap("[‘’]", "'"), _swap("[“”]", '"'), _swap("[԰-֏Ⲁ-⳿�]", "�"), _bare, _SIGMA, _single],
    "line": [_compatible, _BROKEN_WORD, _swap(r"[\[\]{}†⟨⟩]", ""), _swap("◊", " "), _bare, _swap(r"[()!',\-.:;?·ʼ–—’…]+", " "), _single],
    "verse": [_compatible, _swap("[⟦⟧⸀-⸏〚〛]", " "), _swap(r"[\[\]]", ""), _swap(r"\+\s*", "+ "), _bare, _SIGMA, _swap(r"[!',\-.:;?·ʼ–—’…]+", " "), _single],
    # elision marks go without a gap: one side has them as letters, the other as combining marks
    "real": [_compatible, _swap("[|∥◊⟦⟧⸀-⸏]", " "), _swap("[\\[\\]{}†⟨⟩〈〉]", ""), _BROKEN, _bare, _SIGMA, _swap("['ʼ’]", ""), _swap(r"[!,.:;?·…]+", " "), _single],
    "scholastic": [_swap("…", _HELD), _swap(r"\.{4}", _HELD + "."), _compatible, _BROKEN_WORD, _swap("[†⟨⟩〈〉]", ""), _bare, _swap(r"[!\"'(),\-.:;?\[\]·ʼ–—‘’“”]+", " "), _swap(_HELD, "…"), _single],
}


def fold(profile: str, s: str) -> str:
    if profile == "golden" and s.isascii() and "-" not in s:
        return _single(s.lower())  # no other of its steps changes such a text
    for step in FOLDS[profile]:
        s = step(s)
    return s


def words(s: str) -> list[str]:
    """The golden fold's words; a sign between letters parts them too."""
    return [w for w in re.split(r"[\s!(),.:;?\[\]«·»]+", fold("golden", s)) if w]
