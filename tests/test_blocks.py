"""Operators that split a hot group in blocks, against a loop."""

import random

import pytest

from variorum.operators import evidence as E
from variorum.operators import sizes


@pytest.fixture(scope="module")
def some():
    rng = random.Random(5)
    return [(g, rng.randint(-40, 60)) for g in ("a", "b", None) for _ in range(60)] + [("c", v) for v in (7, 8, 15, 16, 24, 31, 32)]


def sets(some):
    out = {}
    for g, v in some:
        out.setdefault(g, set()).add(v)
    return out


@pytest.mark.parametrize("block", [1, 8, 1 << 20])
def test_ranges_and_gaps(spark, some, block):
    d = spark.createDataFrame(some, "g string, v bigint")
    runs, filled = set(), set()
    for g, vs in sets(some).items():
        vs = sorted(vs)
        first = vs[0]
        for a, z in zip(vs, [*vs[1:], None]):
            if z != a + 1:
                runs.add((g, first, a))
                first = z
            filled |= {(g, x) for x in range(a, z if z is not None and z - a <= 5 else a + 1)}
    got = [tuple(r) for r in E.ranges(d, "g", "v", block).select("g", "first", "last").collect()]
    assert len(got) == len(set(got)) and set(got) == runs
    got = [tuple(r) for r in E.fill_gaps(d, "g", "v", 5, block).collect()]
    assert len(got) == len(set(got)) and set(got) == filled


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_ordinals(spark, some, block):
    rows = [(g, v, i) for i, (g, v) in enumerate(some)]
    d = sizes.blocked_number(spark.createDataFrame(rows, "g string, v bigint, i int"), ["g"], ["v", "i"], block)
    want = {}
    for g in {r[0] for r in rows}:
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])):
            want[r] = k + 1
    assert {(r.g, r.v, r.i): r.ordinal for r in d.collect()} == want


def test_best_and_phrases_by_both_plans(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "alphabet  soups\nlonger words"), (2, "alphabet words longer longer"), (3, None), (4, ""), (5, "soups alphabet")], "doc int, text string")
    items = spark.createDataFrame([(10, "alphabet soups"), (11, "longer"), (12, ""), (13, "unknown thing")], "item int, text string")
    answers = []
    for limit in (sizes.BROADCAST_BYTES, 0):
        monkeypatch.setattr(sizes, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(E, "BROADCAST_BYTES", limit)
        answers.append(({tuple(r) for r in E.best(docs, items, "doc", "item").collect()}, {tuple(r) for r in E.phrases(docs, items, "doc", "item").collect()}))
    assert answers[0] == answers[1] == ({(10, 1, 18), (11, 1, 16)}, {(1, 10), (1, 11), (2, 11)})


def test_pages_of_a_budget(spark):
    rows = [("d", k, c) for k, c in enumerate((3, 4, 4, 20, 1, 9, 0))]
    got = E.paginate(spark.createDataFrame(rows, "doc string, k int, c int"), "doc", "k", "c", 10).orderBy("k")
    assert [r.page for r in got.collect()] == [0, 0, 1, 2, 3, 3, 3]
