"""Pages by shape: the same as the kernel says, and the kernel seldom asked."""

import random

import pytest

from variorum.kernels import shapes
from variorum.kernels.page import page_entries
from variorum.kernels.registry import Registry
from variorum.plans.bands import BANDS, REGISTRY, TEXTS
from variorum.plans.queries import REFUSED
from variorum.sinks.documents import fragment

#: Ordinary words, and such as the grammars or the search for a lemma might see through.
ODD = "thatis that hatt thth onon thousandsofendlesswords begin martin atin quae quam post init loco legitur kalendum corr prop marc otto supra nisi mauis treg alii".split()


def drawn(n, seed=7):
    """Layers, texts and fields of n pages, from few words, so that they are equal or hold one another now and then."""
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abdegilmnorstu", k=rng.randint(4, 9))) for _ in range(300)]
    kinds = [(TEXTS[c], b) for c, b in BANDS.items()] + [(TEXTS[c], REFUSED[c][0]) for c in BANDS]
    kinds += [("{w1} x {w2}", "5 in {w1} A {s} : {w2} || 6 {w2} om. {t}"), ("{w1} {w2}", "1 {w1}. {s} : {w2}om. {t} || 2 {w2} : ({w3} in textu) Otto"), ("{c1}1 {c2} 2", "1 {c1} ({w2} {w3}) {s} : {w4} post {w5} {t}  2 {c2}- {w1} : {w3} A")]
    for _ in range(n):
        words = [rng.choice(plain) if rng.random() < 0.9 else rng.choice(ODD) for _ in range(6)]
        if rng.random() < 0.15:
            words[rng.randrange(6)] = rng.choice([words[0] * 2, words[1] + "in", "x" + words[2], words[3]])
        said = {f"w{i}": w for i, w in enumerate(words, 1)} | {f"c{i}": w.capitalize() for i, w in enumerate(words, 1)} | {"s": rng.choice("AB"), "t": rng.choice("HK")}
        text, band = rng.choice(kinds)
        yield ("text", "apparatus", "notes", "translation"), [text.format(**said), band.format(**said), "# {w1}".format(**said), "{w2} {w6}".format(**said)]


@pytest.fixture
def fresh(monkeypatch):
    monkeypatch.setattr(shapes, "_KEPT", {})


def test_entries_by_shape(fresh, monkeypatch):
    asked, got = 0, 0

    def kernel(blocks, reg):
        nonlocal asked
        asked += 1
        return page_entries(blocks, reg)

    monkeypatch.setattr(shapes, "page_entries", kernel)
    own = shapes.entry_shapes(REGISTRY)
    for layers, texts in drawn(12000):
        found = own.template(layers, texts)
        if found:
            t, words = found
            value = page_entries([{"layer": x, "text": y} for x, y in zip(layers, texts)], REGISTRY)
            strings, places = shapes._said(value)
            assert (t.texts(words), t.offsets(words)) == (strings, [p and p[1] for p in places]), texts
            assert [shapes._fixed(e) for e in value] == [shapes._fixed(e) for e in t.value], texts
            got += 1
    assert got > 6000 and asked < 5000


def test_fragments_by_shape(fresh):
    own, got = shapes.fragment_shapes(REGISTRY, fragment), 0
    for i, (layers, texts) in enumerate(drawn(4000)):
        folio = None if i % 3 == 0 else f"{i}b"
        found = own.template((*layers, folio is not None), texts)
        if found and i % 2:
            said = "\0".join(found[0].texts(found[1])).replace(shapes.INDEX, str(i)).replace(shapes.FOLIO, str(folio)).split("\0")
            assert fragment(i, folio, [{"layer": x, "text": y} for x, y in zip(layers, texts)], REGISTRY)[0] == found[0].value[0] | dict(zip(("md", "tei", "translation"), said)), texts
            got += 1
    assert got > 500


def test_registries_that_see_into_words(fresh):
    assert not shapes.entry_shapes(None).usable
    assert not shapes.entry_shapes(Registry({"A": "", "Aac": ""}, {})).usable
    assert not shapes.entry_shapes(Registry({"A": ""}, {"Du Pontet": ""})).usable
    own = shapes.entry_shapes(Registry({"A": "", "Tolosa": ""}, {"Marc.": ""}))
    assert own.kind("tolosa") == own.kind("Marc") == own.kind("kalendum") == "" != own.kind("lector")
