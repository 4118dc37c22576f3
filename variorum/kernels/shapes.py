"""Pages by shape. What a kernel makes of a short page depends on its words only where a grammar, a qualifier or the registry
knows them; any other word is carried through. A page with those words left out is its shape: the kernel runs on a shape
once, with words that stand for any, and what it returned is filled in for each further page of that shape.

A page is taken by its shape only where that can't change the result; any other goes through the kernel itself:

* a slot is a word of 4 to 24 ASCII letters that is known to nobody (``Shapes.kind``). The shape says which slots are equal, but
  for capitals too, and which words are one half twice;
* a lemma is sought as a substring, so a word of it may stand nowhere else in the page's texts, inside another word neither;
* patterns with a bound on length (120 and 40 characters) must not tell slots of 4 letters from slots of 24, nor may words
  that end in ``in`` differ (``in A`` is a phrase of its own): the kernel is asked three times and must agree;
* a shape may hold no sign outside ``_SIGNS``, no hyphen but between digits, no slot before a full stop, no narrative word;
* every lemma must consist of slots and be found whole; only texts, slices and lemmata may hold slots, numbers only as places
  in a block's text.

A shape is filled in for the first time on its second page, and held against the kernel there.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from variorum.kernels.grammars import EDITIONS
from variorum.kernels.page import page_entries
from variorum.kernels.registry import CONNECTORS, DISCOURSE, QUALIFIERS, SOURCES, Registry

#: Characters of the longest page that is looked at, shapes and words that are remembered.
LONGEST, SHAPES, SEEN, WORDS = 400, 2048, 1 << 15, 1 << 17
_WORD = re.compile(r"(?<!\w)([a-z]{4,24}|[A-Z][a-z]{3,23})(?![^\W\d_])")
_RUN = re.compile(r"[^\W\d_]{4,}")
#: Words by which the grammars tell narrative from readings; a shape that holds one isn't used.
NARRATIVE = frozenset("alias alii alios cuius compendio compendiis infra lacunam mauis nisi quae quam quas quem quibus quod quos relicto secutus sensu sequens sequitur supra teste testibus uoce uocibus".split())
_OPERATORS = "init iterum lectiones plus textu"
_PARTS = re.compile("difficile|euanid|glossema|inscriptio|legitur|littera|marginem|ndum$|prima|primera|seruat|transpos|uerbum")
_SIGNS = re.compile("[A-Za-z0-9 \n#.,;:|\\]•∥◊–\\x1e-]*")
_HYPHEN = re.compile("(?<![0-9])-|-(?![0-9])|[.]{2}")
_READ = ("heading", "text")
_PLACES = ("char_offset", "digit_start", "digit_end")
Key = tuple


class Unshaped(Exception):
    """Why a shape can't be used."""


def _standing(n: int, how: str, twice: bool) -> str:
    """A word that may stand for any, the n-th; ``twice``: one half twice."""
    c = chr(ord("b") + n)
    if twice:
        return 2 * ("y" + c + {"short": "", "long": "kvjwkvjwkv", "in": "in"}[how])
    return "zqx" + c + {"short": "", "long": "kvjwkvjwkvjwkvjwkvjw", "in": "in"}[how]


class Template:
    """A result with slots: ``fmt % words`` is its strings, in order, apart by NUL."""

    __slots__ = ("_each", "_order", "extra", "fmt", "places", "slots", "sought", "strings", "value")

    def __init__(self, value: Any, strings: list[str], slots: list[int], places: list[tuple[int, tuple[int, ...]] | None]) -> None:
        self.value, self.strings, self.slots, self.places = value, len(strings), slots, places
        self.fmt = "\0".join(strings)
        self.sought: list[tuple[int, int]] = []  # slots of lemmata that are sought, and how often each stands in the texts
        self.extra: Any = None
        each = {p: i for i, p in enumerate(dict.fromkeys(places))}
        self._each = [p or (None, ()) for p in each]
        self._order = [each[p] for p in places]

    def texts(self, words: list[str]) -> list[str]:
        return (self.fmt % tuple([words[i] for i in self.slots])).split("\0") if self.strings else []

    def offsets(self, words: list[str]) -> list[int | None]:
        sizes = [len(w) for w in words]
        found = [n if n is None else n + sum([sizes[i] for i in slots]) for n, slots in self._each]
        return [found[i] for i in self._order]


class Shapes:
    """Templates of one kernel. ``run`` gives its result for layers and texts, ``entries`` the page's entries of a result,
    ``variable`` the strings and the places (block and number, or None) that may vary, and ``constant`` what must not."""

    def __init__(self, reg: Registry | None, run: Callable[[tuple, list[str]], Any], variable: Callable[[Any], tuple[list[str], list]], constant: Callable[[Any], Any], entries: Callable[[Any], list[dict]]) -> None:
        self.run, self.variable, self.constant, self.entries = run, variable, constant, entries
        tokens = [*QUALIFIERS, *CONNECTORS, *DISCOURSE, *SOURCES, *EDITIONS, *_OPERATORS.split(), *NARRATIVE]
        if reg is not None:
            tokens += [*reg.witnesses, *reg.editors]
        self.known = {w.lower() for t in tokens for w in _RUN.findall(t)} | {s.lower() for e in EDITIONS for x in ("app", "ed", "marg", "spur", "txt") if _WORD.fullmatch(s := e + x)}
        # a siglum in small letters could end a word that is glued sigla; an editor's name of two words is joined wherever it stands
        self.usable = reg is not None and not any(s[-1:].islower() for s in reg.witnesses) and not any(" " in e for e in reg.editors)
        self.kinds: dict[str, str] = {}
        self.twice: set[str] = set()
        self.seen: set[Key] = set()
        self.templates: dict[Key, Template | None] = {}
        self.table: Any = None

    def kind(self, word: str) -> str:
        """The word in small letters where it may fill a slot, else ''."""
        low = word.lower()
        half = len(low) // 2
        if low[:half] == low[half:]:
            self.twice.add(low)
        free = low not in self.known and _PARTS.search(low) is None
        if len(self.kinds) >= WORDS:
            self.kinds.clear()
            self.twice.clear()
        self.kinds[word] = said = low if free else ""
        return said

    def shape(self, layers: tuple[str, ...], texts: list[str]) -> tuple[Key, list[str]] | None:
        """The page's shape and the words of its slots."""
        page = "\x1e".join(texts)
        if len(page) > LONGEST:
            return None
        parts = _WORD.split(page)
        kinds, forms, at, odd = self.kinds, {}, [], False
        for w in parts[1::2]:
            low = kinds.get(w)
            if low is None:
                low = self.kind(w)
            if low:
                at.append(forms.setdefault(w, len(forms)))
                odd = odd or low != w or low in self.twice
            else:
                at.append(w)
        words, same = list(forms), None
        if len(words) > 20:
            return None
        if odd:
            lows: dict[str, int] = {}
            same = tuple([(lows.setdefault(low, len(lows)), low != w, low in self.twice) for w, low in ((w, w.lower()) for w in words)])
        return (layers, tuple(parts[::2]), tuple(at), same), words

    def template(self, layers: tuple, texts: list[str]) -> tuple[Template, list[str]] | None:
        """The template of the page's shape, with the page's words; None where the kernel must run. What else of a page decides
        follows its layers."""
        if not self.usable or (found := self.shape(layers, texts)) is None:
            return None
        key, words = found
        if key not in self.templates:
            if key not in self.seen:
                if len(self.seen) >= SEEN:
                    self.seen.clear()
                self.seen.add(key)
                return None
            if len(self.templates) >= SHAPES:
                return None
            try:
                made = self._made(key, len(words), len(texts))
                value = self.run(layers, texts)
                strings, places = self.variable(value)
                if made.texts(words) != strings or made.offsets(words) != [p and p[1] for p in places] or self.constant(value) != self.constant(made.value):
                    raise Unshaped("the kernel says otherwise")
            except Unshaped:
                made = None
            self.templates[key] = made
        t = self.templates[key]
        if t is None:
            return None
        if t.sought:
            read = "\x1e".join([x for layer, x in zip(layers, texts) if layer in _READ])
            for i, n in t.sought:
                if read.count(words[i]) != n:
                    return None
        return t, words

    def _made(self, key: Key, n: int, texts: int) -> Template:
        layers, literals, at, same = key
        plain = "".join(literals)
        bare = "".join(p + (a if isinstance(a, str) else "") for p, a in zip(literals, (*at, "")))
        if plain.count("\x1e") != texts - 1 or not _SIGNS.fullmatch(bare) or _HYPHEN.search(plain) or re.search("zqx|y[b-w]", bare) or NARRATIVE & set(map(str.lower, _RUN.findall(bare))):
            raise Unshaped("signs or words")
        if any(isinstance(a, int) and p.startswith(".") for a, p in zip(at, literals[1:])):
            raise Unshaped("a slot before a full stop")
        made = [self._instance(key, n, how) for how in ("short", "long", "in")]
        first = made[0]
        for t in made[1:]:
            if (t.fmt, t.slots, t.places, t.sought) != (first.fmt, first.slots, first.places, first.sought) or self.constant(t.value) != self.constant(first.value):
                raise Unshaped("the words matter")
        return first

    def _instance(self, key: Key, n: int, how: str) -> Template:
        layers, literals, at, same = key
        said = [(i, False, False) for i in range(n)] if same is None else same
        forms = [_standing(i, how, twice).capitalize() if up else _standing(i, how, twice) for i, up, twice in said]
        number = {w: i for i, w in enumerate(forms)}
        page = "".join(p + (forms[a] if isinstance(a, int) else a) for p, a in zip(literals, (*at, "")))
        texts = page.split("\x1e")
        value = self.run(layers, texts)
        sought: set[int] = set()
        for e in self.entries(value):
            if e["parsed"]:
                lemma = e["parsed"]["lemma"].split()
                if any(w not in number for w in lemma):
                    raise Unshaped("a lemma of other words")
                if e["grammar"] != "marker":
                    sought |= {number[w] for w in lemma}
                    if e["anchor"]["block_index"] is None:
                        raise Unshaped("a lemma that isn't there")
        find = re.compile("|".join(map(re.escape, forms)) or "(?!)")
        if any(find.search(s) for s in _strings(self.constant(value))):
            raise Unshaped("a word where none may be")
        strings, places = self.variable(value)
        slots = [number[m] for s in strings for m in find.findall(s)]
        fmt = ["%s".join(p.replace("%", "%%") for p in find.split(s)) for s in strings]
        made = Template(value, fmt, slots, [self._place(p, texts, find, number) for p in places])
        made.sought = [(i, sum(t.count(forms[i]) for layer, t in zip(layers, texts) if layer in _READ)) for i in sorted(sought)]
        return made

    @staticmethod
    def _place(p: tuple[int, int] | None, texts: list[str], find: re.Pattern, number: dict[str, int]) -> tuple[int, tuple[int, ...]] | None:
        """A place as so many characters besides the slots before it."""
        if p is None:
            return None
        block, offset = p
        inside, slots = 0, []
        for m in find.finditer(texts[block]):
            if m.start() < offset < m.end():
                raise Unshaped("a place within a slot")
            if m.end() <= offset:
                slots.append(number[m[0]])
                inside += len(m[0])
        return offset - inside, tuple(slots)


def _strings(v: Any) -> list[str]:
    if isinstance(v, str):
        return [v]
    if isinstance(v, dict):
        v = v.values()
    return [s for x in v for s in _strings(x)] if isinstance(v, (list, tuple)) or hasattr(v, "__iter__") else []


def _places(e: dict[str, Any]) -> list[tuple[int, int] | None]:
    """An entry's places: the anchor's three and the lemma's start."""
    a = e["anchor"]
    b = a["block_index"] if a else None
    return [None if b is None or a[k] is None else (b, a[k]) for k in _PLACES] + [None if e["lemma_start"] is None else (b, e["lemma_start"])]


def _fixed(e: dict[str, Any]) -> dict[str, Any]:
    """An entry without its texts and places."""
    p, a = e["parsed"], e["anchor"]
    rest = {k: v for k, v in e.items() if k not in ("raw", "source_slice", "resolved_lemma", "lemma_start", "parsed", "anchor")}
    rest["anchor"] = a and {k: v for k, v in a.items() if k not in _PLACES}
    rest["parsed"] = p and {"lemma_attribution": p["lemma_attribution"], "readings": [r["attribution"] for r in p["readings"]], "comments": p["comments"]}
    return rest


def _said(es: list[dict[str, Any]]) -> tuple[list[str], list]:
    """The entries' raw texts, slices, lemmata, resolved lemmata and readings, in this order, and four places an entry."""
    lemmata = [e["parsed"]["lemma"] if e["parsed"] else "" for e in es]
    readings = [r["text"] for e in es if e["parsed"] for r in e["parsed"]["readings"]]
    return [e["raw"] for e in es] + [e["source_slice"] for e in es] + lemmata + [e["resolved_lemma"] for e in es] + readings, [p for e in es for p in _places(e)]


_KEPT: dict[tuple, Shapes] = {}


def _kept(kind: str, reg: Registry | None, make: Callable[[], Shapes]) -> Shapes:
    """One for a registry and a process: a worker's tasks share what they have learned."""
    key = (kind, reg and (tuple(reg.witnesses.items()), tuple(reg.editors.items())))
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def entry_shapes(reg: Registry | None) -> Shapes:
    """Shapes of pages to entries."""
    run = lambda layers, texts: page_entries([{"layer": x, "text": t} for x, t in zip(layers, texts)], reg)
    return _kept("entries", reg, lambda: Shapes(reg, run, _said, lambda es: [_fixed(e) for e in es], lambda es: es))


#: Stand for a page's index and printed number in a fragment.
INDEX, FOLIO = "\ue010", "\ue011"


def fragment_shapes(reg: Registry | None, fragment: Callable[[Any, str | None, list[dict[str, Any]], Registry | None], tuple[dict[str, Any], list]]) -> Shapes:
    """Shapes of pages to fragments: dicts of which ``md``, ``tei`` and ``translation`` vary. Whether there is a printed number
    follows the layers."""

    def run(layers: tuple, texts: list[str]) -> tuple[dict[str, Any], list]:
        return fragment(INDEX, FOLIO if layers[-1] else None, [{"layer": x, "text": t} for x, t in zip(layers, texts)], reg)

    names = ("md", "tei", "translation")
    constant = lambda v: ({k: x for k, x in v[0].items() if k not in names}, [_fixed(e) for e in v[1]])
    return _kept("fragments", reg, lambda: Shapes(reg, run, lambda v: ([v[0][k] for k in names], []), constant, lambda v: v[1]))
