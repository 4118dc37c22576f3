"""Each operator against a plain version of itself, an exact round trip or held-out accuracy."""

import random
import re
import time
import zipfile
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from variorum.llm import bpe, exact, html, langid, licenses, packing, repetition, simhash, urlfilter, warc
from variorum.llm.common import text_buffers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    return pd.read_parquet(f"{SF}/documents.parquet").text.tolist()


# 10 ---------------------------------------------------------------------------------------------------------------
def plain_repetition(text):
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\t-\r ]+", text.replace("\x0b", "\t").replace("\x0c", "\t"))]
    n_chars, out = max(len(text), 1), {}
    for n in range(2, 11):
        grams = [tuple(text[a:b] for a, b in words[i : i + n]) for i in range(len(words) - n + 1)]
        if n <= 4:
            count, size = Counter(grams), {}
            for i, g in enumerate(grams):
                size.setdefault(g, words[i + n - 1][1] - words[i][0])
            best = max(((c, size[g]) for g, c in count.items() if c > 1), default=(0, 0))
            out[f"top_{n}"] = min(1, best[0] * best[1] / n_chars)
        else:
            seen, inside = set(), set()
            for i, g in enumerate(grams):
                if g in seen:
                    inside.update(range(words[i][0], words[i + n - 1][1]))
                seen.add(g)
            out[f"dup_{n}"] = len(inside) / n_chars
    lines = [x for x in text.split("\n") if x.strip("\t\n\r\x0b\x0c ")]
    seen, again = set(), []
    for x in lines:
        if x in seen:
            again.append(x)
        seen.add(x)
    out["dup_line"] = len(again) / max(len(lines), 1)
    out["dup_line_chars"] = sum(map(len, again)) / n_chars
    return out


def check_repetition(some):
    data, offsets, _ = text_buffers(pa.array(some, pa.string()))
    got = repetition.measured(data, offsets)
    for k, t in enumerate(some):
        want = plain_repetition(t)
        assert {m: pytest.approx(want[m], abs=1e-9) for m in want} == {m: got[m][k] for m in want}, t[:80]


def test_repetition_on_documents(texts):
    check_repetition(texts[:60])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "é", "日本", "\n", " ", "  ", "a b c d e f", "x y"]), max_size=60).map("".join), min_size=1, max_size=4))
def test_repetition_on_any_text(some):
    check_repetition(some)


# 7 ----------------------------------------------------------------------------------------------------------------
def test_language_on_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(d.where("doc_id % 2 = 0"))
    out = langid.identify(d.where("doc_id % 2 = 1"), model, keep=("doc_id", "lang")).toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.98 and out.keep.mean() > 0.99


def test_language_scores_like_a_loop():
    model = langid.Model(("a", "b"), np.random.default_rng(1).normal(size=(langid.BUCKETS, 2)).astype(np.float32))
    some = ["abc", "", "é", "the cat sat"]
    points = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32)
    got, count = langid.score(model.logp, points, np.array([len(t) for t in some]))
    for k, t in enumerate(some):
        p = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        want = [model.logp[langid.grams(p[i : i + n], n)[0]] for n in langid.ORDERS for i in range(len(p) - n + 1)]
        assert count[k] == len(want) and np.allclose(got[k], np.sum(want, axis=0) if want else 0, atol=1e-4)


def test_language_rejects_what_is_in_none(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    foreign = [
        "Questa è una frase scritta in lingua italiana, che parla del tempo e della gente di città",
        "To jest zdanie napisane w języku polskim, które opowiada o pogodzie i ludziach w mieście",
        "Это предложение написано на русском языке и рассказывает о погоде",
        "这是一个用中文写的句子，讲述天气和城市里的人们",
        "Tämä lause on kirjoitettu suomeksi ja se kertoo säästä ja kaupungin ihmisistä",
        "xq zvk jjw qqp vbx wzk kkj xzq pqw vvj",
        "!!! ### $$$ a",
    ]
    model = langid.train(d)
    odd = spark.createDataFrame(list(enumerate(foreign)), "doc_id int, text string")
    assert [r.doc_id for r in langid.identify(odd, model).where("keep").collect()] == []
    assert langid.language_filter(odd, model).count() == 0
    short = d.where("doc_id % 10 = 3").selectExpr("doc_id", "substr(text, 1, 120) as text")
    assert langid.identify(short, model).toPandas().keep.mean() > 0.97


# 8 ----------------------------------------------------------------------------------------------------------------
def test_exact_like_a_dictionary(spark, docs):
    rows = docs.union(docs.limit(50))
    best = {}
    for r in rows.collect():
        best.setdefault(r.text, []).append(r.doc_id)
    got = {(r.doc_id, r.n_copies) for r in exact.exact_groups(rows).collect()}
    assert got == {(min(v), len(v)) for v in best.values()}
    kept = exact.exact_dedup(rows).collect()
    assert sorted(r.doc_id for r in kept) == sorted(min(v) for v in best.values())


def test_exact_hot_text(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "if(id % 100 = 7, concat('x', id), 'same') as text")
    assert exact.exact_dedup(rows).count() == 51


# 9 ----------------------------------------------------------------------------------------------------------------
def test_gray_rank_orders_the_gray_code():
    code = np.array([[0, i ^ (i >> 1)] for i in range(64)], np.uint64)
    assert simhash.gray_rank(code)[:, 1].tolist() == list(range(64))


@pytest.mark.parametrize("n,limit", [(1, 24), (2, 24), (300, 24), (700, 50)])
def test_near_pairs_are_all_pairs(n, limit):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, (max(1, n // 4), 2), dtype=np.uint64)
    f = base[rng.integers(0, len(base), n)]
    for _ in range(12):
        f[np.arange(n), rng.integers(0, 2, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    g = simhash.gray_rank(f)
    f = f[np.lexsort((g[:, 1], g[:, 0]))]
    got = {(int(a), int(b)) for x, y in simhash.near_pairs(f, limit) for a, b in zip(x, y)}
    d = np.bitwise_count(f[:, None] ^ f[None]).sum(2)
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if d[i, j] <= limit}


def brute_groups(prints, limit):
    ids = [p[0] for p in prints]
    f = np.array([[p[1], p[2]] for p in prints], np.int64).view(np.uint64)
    d = np.bitwise_count(f[:, None] ^ f[None]).sum(2)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(d <= limit)):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    least = {}
    for k in range(len(ids)):
        least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return {ids[k]: least[find(k)] for k in range(len(ids))}, d


def test_block_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(4)
    sizes = [1, 2, 5, 64, 65, 700, 3]
    block = np.repeat(np.arange(len(sizes)), sizes)
    f = rng.integers(0, 1 << 63, (40, 2), dtype=np.uint64)[rng.integers(0, 40, len(block))]
    sketch = rng.integers(1, 256, (60, simhash.BINS)).astype(np.uint8)[rng.integers(0, 60, len(block))]
    for _ in range(14):
        f[np.arange(len(f)), rng.integers(0, 2, len(f))] ^= np.uint64(1) << rng.integers(0, 64, len(f)).astype(np.uint64)
    near = (np.bitwise_count(f[:, None] ^ f[None]).sum(2) <= simhash.MAX_BITS) & (block[:, None] == block[None])
    agree = ((sketch[:, None] == sketch[None]) & (sketch > 0)[None]).sum(2)
    want = near & (agree >= int(simhash.BINS * simhash.HINT))
    got_i, got_j = simhash.block_forest(block, f, sketch.view(np.uint64))
    assert want[got_i, got_j].all()
    one, two = (joined(len(f), np.column_stack(p)) for p in ((got_i, got_j), np.nonzero(want)))
    assert one == two and len(got_i) == len(f) - len(set(one))


def joined(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_a_dense_block_is_no_square():
    m, rng = 16_000, np.random.default_rng(6)
    f = np.tile(rng.integers(0, 1 << 63, 2, dtype=np.uint64), (m, 1))
    for _ in range(10):
        f[np.arange(m), rng.integers(0, 2, m)] ^= np.uint64(1) << rng.integers(0, 64, m).astype(np.uint64)
    sketch = np.tile(rng.integers(1, 256, simhash.BINS).astype(np.uint8), (m, 1))
    sketch[rng.random(sketch.shape) < 0.3] = 7
    began = time.perf_counter()
    assert len(simhash.block_forest(np.zeros(m, np.int64), f, sketch.view(np.uint64))[0]) == m - 1
    assert time.perf_counter() - began < 5


def test_ids_of_other_types(spark, docs):
    named = docs.select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("name"), "text")
    want = {f"d{r.doc_id:09}": [f"d{x:09}" for x in r.doc_ids] for r in simhash.near_groups(docs).collect()}
    assert {r.name: r.doc_ids for r in simhash.near_groups(named, key="name").collect()} == want
    assert {r.name for r in simhash.near_dedup(named, key="name").collect()} == set(want)
    kept = {r.name for r in exact.exact_groups(named, key="name").collect()}
    assert kept == {f"d{r.doc_id:09}" for r in exact.exact_groups(docs).collect()} == {r.name for r in exact.exact_dedup(named, key="name").collect()}


@pytest.mark.parametrize("bucket,recall", [(16_384, 1.0), (32, 0.9)])
def test_near_roots_against_all_pairs(spark, bucket, recall):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prints = [(r.id, r.f1, r.f2) for r in simhash.with_fingerprints(d).collect()]
    want, dist = brute_groups(prints, simhash.MAX_BITS)
    got = {r.id: r.root for r in simhash.near_roots(d, bucket=bucket).collect()}
    pairs = [(prints[i][0], prints[j][0]) for i, j in zip(*np.nonzero(np.triu(dist <= simhash.MAX_BITS, 1)))]
    same = [got.get(a, a) == got.get(b, b) for a, b in pairs]
    assert pairs and np.mean(same) >= recall
    assert all(want[i] == want[r] for i, r in got.items())


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1002, 1001)], "src bigint, dst bigint")
    got = {r.id: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000, 1002: 1000}


def plain_jaccard(a, b):
    sets = []
    for t in (a, b):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
        sets.append({tuple(w[i : i + simhash.GRAM]) for i in range(max(1, len(w) - simhash.GRAM + 1))} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def test_jaccard_like_sets(texts):
    a = [*texts[:80], "", "a", "a b", "é x y z", "a b c"]
    b = [*(t[len(t) // 3 :] + " more words" for t in texts[:80]), "x", "A", "b a", "É x y z q", ""]
    (da, oa, _), (db, ob, _) = (text_buffers(pa.array([t.lower() for t in x])) for x in (a, b))
    assert np.allclose(simhash.jaccard((da, oa), (db, ob)), [plain_jaccard(*p) for p in zip(a, b)])


def test_unrelated_texts_with_near_fingerprints_stay(spark):
    rng = random.Random(11)
    words = [f"word{i}" for i in range(300)]
    text = lambda: " ".join(rng.sample(words, len(words)))
    base = text()
    rows = [(1, base), (2, text()), (3, base.replace("word7 ", "other ")), (4, text()), (5, base), (6, "a b c d"), (7, "d c b a")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    prints = np.array([[r.f1, r.f2] for r in simhash.with_fingerprints(d).orderBy("id").collect()], np.int64).view(np.uint64)
    assert np.bitwise_count(prints[:5] ^ prints[0]).sum(1).max() <= simhash.MAX_BITS
    assert sorted(r.doc_id for r in simhash.near_dedup(d).collect()) == [1, 2, 4, 6, 7]
    assert {r.doc_id: r.doc_ids for r in simhash.near_groups(d).collect()}[1] == [1, 3, 5]


def test_an_id_with_two_texts_joins_the_groups_of_both(spark):
    one, two, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    d = spark.createDataFrame([(3, two), (5, one), (5, two), (5, two), (7, one), (8, one + " end"), (9, other)], "doc_id bigint, text string")
    assert sorted(r.doc_ids for r in simhash.near_groups(d).collect()) == [[3, 5, 7, 8], [9]]


def test_no_document_goes_as_a_copy_of_an_unrelated_one(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in d.collect()}
    groups = [g.doc_ids for g in simhash.near_groups(d).collect()]
    assert any(len(g) > 1 for g in groups)
    for g in groups:
        for k in g[1:]:
            assert max(plain_jaccard(text[k], text[o]) for o in g if o != k) >= simhash.LEAST


def weak_pairs(n):
    """Pairs of texts of the same words, of whose shingles little more than ``LEAST`` is shared, each pair of other words."""
    rng, rows = random.Random(5), []
    for k in range(n):
        words = [f"w{k}x{i}" for i in range(100)]
        runs = [words[:52], *([w] for w in words[52:])]
        tail = runs[1:]
        rng.shuffle(tail)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(w for r in (runs[0], *tail) for w in r))]
    return rows


def test_lists_have_all_near_pairs_of_different_groups():
    rng, n = np.random.default_rng(8), 400
    f = rng.integers(0, 1 << 64, (30, 2), dtype=np.uint64)[rng.integers(0, 30, n)]
    for _ in range(16):
        f[np.arange(n), rng.integers(0, 2, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    table = np.column_stack([np.arange(n), f.view(np.int64), rng.integers(0, 90, n)])
    lists = [rng.choice(n, m, replace=False) for m in (1, 2, 3, 64, 65, 250, 40, 40)]
    token, doc = np.repeat(np.arange(len(lists)).astype(np.uint64), [len(x) for x in lists]), np.concatenate(lists)
    near = (np.bitwise_count(f[:, None] ^ f[None]).sum(2) <= simhash.MAX_BITS) & (table[:, None, 3] != table[None, :, 3])
    want = {(i, j) for x in lists for i in x.tolist() for j in x.tolist() if i < j and near[i, j]}
    got = simhash.near_in_lists(token, doc, table, simhash.MAX_BITS)
    assert want and len(got) == len(want) and set(map(tuple, got.tolist())) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 25), max_size=30), st.lists(st.integers(0, 25), max_size=30), st.integers(0, 5))
def test_texts_that_share_enough_share_a_first_token(a, b, seed):
    ranks = np.random.default_rng(seed).integers(0, 3, 1 << 20).astype(np.uint8)
    at = simhash.mix64(np.arange(26, dtype=np.uint64))
    h, doc = at[np.array([*a, *b], np.int64)], np.repeat([0, 1], [len(a), len(b)])
    tokens, number = simhash.first_tokens(h, doc, 2, ranks)
    sets = [set(map(bytes, tokens[: number[0]])), set(map(bytes, tokens[number[0] :]))]
    assert [len(x) for x in sets] == number.tolist()
    if len({*a} & {*b}) >= simhash.LEAST * max(1, len({*a} | {*b})):
        assert sets[0] & sets[1]


def test_groups_have_every_link_whatever_the_bucket(spark):
    rows = weak_pairs(150)
    linked = {k for k in range(0, 300, 2) if plain_jaccard(rows[k][1], rows[k + 1][1]) >= simhash.LEAST}
    assert len(linked) == 150 and max(plain_jaccard(rows[k][1], rows[k + 1][1]) for k in linked) < 0.4
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {i: i - i % 2 for i in range(300)}
    for bucket in (simhash.BUCKET, 4):
        assert {r.id: r.root for r in simhash.near_roots(d, bucket=bucket).collect()} == want


# 4 ----------------------------------------------------------------------------------------------------------------
def plain_best_fit(rooms, pieces, capacity):
    """Piece by piece, longest first, into the bin with least room that holds it."""
    rooms = list(rooms)
    for n in sorted(pieces, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(capacity - n)
    return Counter(rooms)


def rounded_up(lengths, groups):
    """Each length, from the longest, as the longest of its group of equal cardinality."""
    lengths = sorted(lengths, reverse=True)
    each = max(1, -(-len(lengths) // groups))
    return [lengths[i - i % each] for i in range(len(lengths))]


@pytest.mark.parametrize("seed,n,capacity,groups,small", [(1, 400, 64, 6, 8), (2, 30, 100, 48, 16), (3, 1000, 256, 12, 16), (4, 3, 10, 4, 2), (5, 900, 32, 3, 4)])
def test_packing_like_one_process(spark, monkeypatch, seed, n, capacity, groups, small):
    monkeypatch.setattr(packing, "SALT_ROWS", 20)  # several salts a length
    rng = random.Random(seed)
    rows = [(i, [i * 7 + k for k in range(max(0, int(rng.lognormvariate(3, 1.2))))]) for i in range(n)] + [(None, None), (7, [1, 2, 3])]
    d = spark.createDataFrame(rows, "id bigint, tokens array<int>")
    out = packing.pack_tokens(d, "doc_id", capacity, groups, small).collect()
    # the pieces, rejoined, are the encodings
    whole, bins = {}, {}
    for r in sorted(out, key=lambda r: r.piece):
        assert r.length == len(r.tokens or []) and (r.bin_id is None) == (r.length == 0)
        if r.doc_id not in (None, 7):
            assert r.start == len(whole.setdefault(r.doc_id, []))
            whole[r.doc_id] += r.tokens
        if r.length:
            bins.setdefault(r.bin_id, []).append(r.length)
    assert whole == {i: t for i, t in rows[:-2] if i != 7}
    assert max(map(sum, bins.values())) <= capacity
    # small pieces lie where a best fit of one process leaves as much room everywhere
    cut = capacity // small
    lengths = [x for b in bins.values() for x in b]
    gaps = [capacity - sum(x for x in b if x > cut) for b in bins.values() if max(b) > cut]
    assert plain_best_fit(gaps, [x for x in lengths if x <= cut], capacity) == Counter(capacity - sum(b) for b in bins.values())
    # large pieces: no fewer bins than their volume, no more than best fit needs for the rounded lengths, and a few
    bound = sum(plain_best_fit([], rounded_up([x for x in lengths if x > cut], groups), capacity).values())
    assert -(-sum(x for x in lengths if x > cut) // capacity) <= len(gaps) <= bound + groups


def test_rounded_pieces_fit_their_slots():
    rng = random.Random(9)
    for _ in range(20):
        lengths = [rng.randint(5, 60) for _ in range(rng.randint(1, 300))]
        each, sizes, demand = packing.linear_groups(Counter(lengths), 7)
        want = rounded_up(lengths, 7)
        assert [x for s, n in zip(sizes, demand) for x in [s] * n] == want
        table, bins = packing.slot_table(each, sizes, demand, 64)
        fill = Counter()
        for rank, size in enumerate(want):
            (a, _, b, per), = [t for t in table if t[0] <= rank < t[1]]
            fill[b + (rank - a) // per] += size
        assert max(fill.values()) <= 64 and max(fill) < bins


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), max_size=6), st.dictionaries(st.integers(1, 12), st.integers(1, 30), max_size=5))
def test_best_fit_on_counts_is_best_fit(rooms, need):
    rows, opened = packing.best_fit(rooms, need, 40)
    left = {(r, k): r for r, n in rooms.items() for k in range(n)} | {(packing.FRESH, k): 40 for k in range(opened)}
    for n, a, z, origin, first, per in rows:
        for rank in range(a, z):
            left[origin, first + (rank - a) // per] -= n
    assert min(left.values(), default=0) >= 0
    assert sorted((n, x) for n, a, z, *_ in rows for x in range(a, z)) == sorted((n, x) for n, c in need.items() for x in range(c))
    assert Counter(left.values()) == plain_best_fit([r for r, n in rooms.items() for _ in range(n)], [x for x, n in need.items() for _ in range(n)], 40)


def test_sequences_of_documents(spark, docs, texts):
    c, out = bpe.codec(bpe.VOCABULARY), packing.pack(docs).collect()
    got = {}
    for r in sorted(out, key=lambda r: r.piece):
        got.setdefault(r.doc_id, []).extend(r.tokens or [])
    assert got == {r.doc_id: c.encode(r.text or "").tolist() for r in docs.collect()}
    fill = Counter()
    for r in out:
        fill[r.bin_id] += r.length
    assert max(n for b, n in fill.items() if b is not None) <= packing.CAPACITY


def test_configurations_meet_the_demand():
    rng = random.Random(5)
    for _ in range(20):
        sizes = rng.sample(range(10, 200), 8)
        demand = [rng.randint(1, 500) for _ in sizes]
        plan = packing.configurations(sizes, demand, 200)
        assert all((np.array(sizes) * c).sum() <= 200 for _, c in plan)
        assert all(sum(n * c[k] for n, c in plan) >= demand[k] for k in range(8))
        room = []
        for size in sorted((s for s, d in zip(sizes, demand) for _ in range(d)), reverse=True):
            k = next((k for k, r in enumerate(room) if r >= size), None)
            if k is None:
                room.append(200)
                k = -1
            room[k] -= size
        assert sum(n for n, _ in plan) <= len(room) + 8


# 3 ----------------------------------------------------------------------------------------------------------------
PIECES = ["abc", "aé", "  ", "\n", " ", "'", "'s", "'ll", "1", "12", "…", "!!", "日本", "x" * 40, "   \n  ", "l", "😀", "-", "' "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=120).map("".join), st.sampled_from([1, 3, 8, 30]))
def test_tree_is_the_whole_encoding(text, part):
    c = bpe.codec(bpe.VOCABULARY)
    assert np.array_equal(c.tree([c.encode(p) for p in bpe.halves(text, part)]), c.encode(text))


def test_encode_in_parts_and_decode(spark, docs, texts):
    long = "no break" + "abcdefgh" * 3000 + "1234567" * 2000
    d = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, long), (-1, long), (-2, " ".join(texts))], "doc_id bigint, text string"))
    c = bpe.codec(bpe.VOCABULARY)
    out = bpe.decode(bpe.encode(d, long_bytes=2000, part=700)).collect()
    assert Counter((r.doc_id, tuple(r.tokens), r.decoded) for r in out) == Counter((r.doc_id, tuple(c.encode(r.text).tolist()), r.text) for r in d.collect())


# 5 ----------------------------------------------------------------------------------------------------------------
def test_scan_is_the_whole_search(texts):
    s, rng = licenses.Scanner(licenses.NOTICES), random.Random(3)
    for k in range(150):
        t = rng.choice(texts)[:600]
        for _ in range(rng.randint(0, 3)):
            _, _, notice, e = rng.choice(licenses.NOTICES)
            n = list(notice.upper() if rng.random() < 0.3 else notice)
            for _ in range(rng.randint(0, e + 1)):
                p = rng.randrange(len(n))
                n[p : p + rng.randint(0, 1)] = rng.choice(["", "x", "é", " "])
            p = rng.randrange(len(t) + 1)
            t = t[:p] + "".join(n) + t[p:]
        assert sorted(s.scan(t)) == sorted(s.whole(t)), t


def test_scan_reports_spans(spark):
    d = spark.createDataFrame([(1, "İ x Relased under teh MIT License. All rights reserved!")], "doc_id bigint, text string")
    got = {(r.notice, r.matched) for r in licenses.scan(d).collect()}
    assert ("reserved", "All rights reserved") in got
    d = spark.createDataFrame([(1, "İ x Relased under the MIT License.")], "doc_id bigint, text string")
    assert [(r.notice, r.substitutions + r.insertions + r.deletions) for r in licenses.scan(d).collect()] == [("mit", 1)]
    d = spark.createDataFrame([(1, "x\n * Licensed  under the Apache\n * License,\tVersion 2.0\n */")], "notice bigint, text string")
    assert [(r.notice, r.notice_, r.deletions + r.insertions + r.substitutions, r.matched) for r in licenses.scan(d, key="notice").collect()] == [(1, "apache-2.0", 0, "Licensed  under the Apache\n * License,\tVersion 2.0")]


# 6 ----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("source,want", [
    ("<p>a<p>b", "a\n\nb"), ("a<div>b</div>c", "a\nb\nc"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"),
    ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<pre>a\n  b\n</pre>", "a\n  b"),
    ("<table><tr><td>a<td>bbb<tr><td>cccc<td align=right>d</table>", "a     bbb\ncccc    d"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>dd ee ff</table>", "a  b\n   c\ndd ee ff"),
    ("x<script>y</script><style>z</style><!-- c --><b hidden>h</b><i style='display: none'>n</i>w", "xw"),
    ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>", "b"),
    ("<details><summary>s</summary>t</details><details open><summary>u</summary>v</details>", "s\nu\nv"),
    ("<head><title>t</title></head><body>b", "b"), ("a &lt;b&gt; &amp;c; 1 < 2", "a <b> &c; 1 < 2"), ("<p>a <b> b </b> c", "a b c"),
    ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "a\n    b\nc\n    d"), ("<a href='x>y'>t</a", "t"), ("<p>a</b></div>b", "ab"),
])
def test_layout(source, want):
    assert html.extract_text(source) == want


TREE = st.recursive(st.text("ab \n", min_size=1, max_size=5).map(lambda t: ("#", t)), lambda inner: st.tuples(st.sampled_from(["div", "p", "b", "ul", "li", "table", "tr", "td", "pre", "script", "blockquote", "span"]), st.lists(inner, max_size=4)), max_leaves=25)


def markup(node):
    if node[0] == "script":
        return f"<script>{''.join(c[1] for c in node[1] if c[0] == '#')}</script>"
    return node[1] if node[0] == "#" else f"<{node[0]}>{''.join(map(markup, node[1]))}</{node[0]}>"


def visible(node):
    return "" if node[0] == "script" else node[1] if node[0] == "#" else "".join(map(visible, node[1]))


@settings(max_examples=200, deadline=None)
@given(TREE)
def test_all_visible_characters_come_out(tree):
    bare = lambda t: Counter(re.sub(r"[\s\-]", "", t))
    assert bare(html.extract_text(markup(tree))) == bare(visible(tree))


def test_deep_nesting():
    assert html.extract_text("<div>" * 50_000 + "x") == "x"
    assert html.extract_text("<div>" * 250 + "<b hidden>secret</b><div style='display:none'>sec2</div>x") == "x"
    assert html.extract_text("<ul><li>" * 300 + "x").endswith("- x")
    assert html.extract_text("<table><tr><td>" * 400 + "x") == "x"


TREES = st.recursive(
    st.text("ab ", min_size=1, max_size=4).map(lambda t: ("#", t)),
    lambda inner: st.tuples(st.sampled_from(["div", "p", "b", "span", "blockquote", "ul", "ol", "section"]), st.lists(inner, max_size=4)),
    max_leaves=20,
)


def plain_layout(node):
    """The same rules written as recursion over (gap, line) pairs, for trees of blocks, lists and inline elements."""
    lines, state = [], {"cur": "", "space": False, "gap": 0}

    def end(gap):
        if state["cur"]:
            lines.append((state["before"], state["cur"]))
            state["gap"] = 0
        state.update(cur="", space=False)
        if lines:
            state["gap"] = max(state["gap"], gap)

    def put(tag, gap, inner):
        end(gap)
        first = True
        for g, line in inner:
            lines.append((state["gap"] if first and lines else g, line))
            state["gap"], first = 0, False
        if inner:
            state["gap"] = gap

    def walk(n, kind):
        if kind == "#":
            for c in n:
                if c == " ":
                    state["space"] = state["space"] or bool(state["cur"])
                else:
                    if not state["cur"]:
                        state["before"], state["gap"] = state["gap"], 0
                    state["cur"] += (" " if state["space"] and state["cur"] else "") + c
                    state["space"] = False
            return
        if kind == "blockquote":
            return put(kind, 2, [(g, "    " + x) for g, x in plain_layout(("div", n))])
        gap = 2 if kind in ("p", "ul", "ol") else 1 if kind in ("div", "section") else 0
        if gap:
            end(gap)
        for i, (k, m) in enumerate(n):
            if kind in ("ul", "ol"):
                mark = "- " if kind == "ul" else f"{i + 1}. "
                inner = plain_layout(("li", [(k, m)]))
                if inner:
                    put("li", 1, [(inner[0][0], mark + inner[0][1])] + [(g, " " * len(mark) + x) for g, x in inner[1:]])
            else:
                walk(m, k)
        if gap:
            end(gap)

    tag, children = node
    for k, m in children:
        if tag == "li" and k in ("ul", "ol"):
            put(k, 1, plain_layout(("div", [(k, m)])))
        else:
            walk(m, k)
    end(0)
    return [(0 if i == 0 else g, x) for i, (g, x) in enumerate(lines)]


def listed(node):
    """Markup in which children of lists are items and paragraphs hold no blocks."""
    tag, inner = node
    if tag == "#":
        return inner
    return f"<{tag}>{''.join(f'<li>{listed(c)}</li>' if tag in ('ul', 'ol') else listed(c) for c in inner)}</{tag}>"


def flat_paragraphs(node):
    tag, inner = node
    if tag == "#":
        return node
    inner = [flat_paragraphs(c) for c in inner]
    return (tag, [c for c in inner if c[0] in ("#", "b", "span") and not holds_block(c)] if tag == "p" else inner)


def holds_block(node):
    return node[0] != "#" and (node[0] not in ("b", "span") or any(map(holds_block, node[1])))


@settings(max_examples=300, deadline=None)
@given(TREES)
def test_layout_like_a_recursion(tree):
    tree = flat_paragraphs(tree)
    want = "".join(("\n" * g if i else "") + x for i, (g, x) in enumerate(plain_layout(("body", [tree]))))
    assert html.extract_text(listed(tree)) == want, listed(tree)


# 2 ----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("big", [False, True])
def test_packages(spark, tmp_path, monkeypatch, big):
    if big:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    rows = [(i, f"http://e.org/{i}", f"<p>{i} é" * i) for i in range(40)]
    data = warc.package(rows)
    paths = []
    for k, before in enumerate((b"", b"junk before")):
        p = tmp_path / f"{k}.wacz"
        p.write_bytes(before + data)
        paths.append((str(p),))
    assert b"PK\6\6" in data or not big
    d = spark.createDataFrame(paths, "path string")
    got = warc.read(d).collect()
    assert Counter((r.record_id, r.target_uri, r.payload.decode()) for r in got) == Counter({(f"<urn:page:{i}>", u, h): 2 for i, u, h in rows})
    assert all(r.status == 200 and r.digest_ok for r in got)
    assert {(r.member, r.kind) for r in warc.members(d).collect()} == {("archive/data.warc.gz", "archive"), ("indexes/index.cdxj", "index"), ("datapackage.json", "other")}


def plain_record(n, body=b"abc"):
    return b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:%d>\r\nContent-Length: %d\r\n\r\n" % (n, len(body)) + body + b"\r\n\r\n"


def zipped(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_", "."), data)
    return str(path)


def test_package_without_index_and_broken(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.wacz", "w") as z:
        z.writestr("archive/x.warc.gz", b"".join(warc.record(i, "http://e.org", "x") for i in range(5)))
        z.writestr("archive/y.warc", b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 2)
        z.writestr("archive/z.warc.gz", b"zz", zipfile.ZIP_DEFLATED)
    d = spark.createDataFrame([(str(tmp_path / "a.wacz"),), (None,)], "path string")
    assert Counter(r.warc_type for r in warc.read(d).collect()) == Counter(response=5, warcinfo=2)
    (tmp_path / "b.wacz").write_bytes(b"no zip")
    with pytest.raises(Exception, match="no end record|expected"):
        warc.read(spark.createDataFrame([(str(tmp_path / "b.wacz"),)], "path string")).collect()


def test_records_that_no_index_names(spark, tmp_path):
    parts = [warc.record(i, "http://e.org", "x" * i) for i in range(6)]
    at = [sum(map(len, parts[:i])) for i in range(6)]
    line = lambda i: f'org,e)/ 2024 {{"filename": "data.warc.gz", "offset": "{at[i]}", "length": "{len(parts[i])}"}}\n'
    for number, named in enumerate(([0], [2], [1, 4], [0, 1, 2, 3, 4, 5], [5], [3, 3])):
        p = zipped(tmp_path / f"{number}.wacz", archive__data_warc_gz=b"".join(parts), indexes__i_cdxj="!meta {}\n" + "".join(map(line, named)))
        got = warc.read(spark.createDataFrame([(p,)], "path string")).collect()
        assert sorted(r.record_id for r in got) == [f"<urn:page:{i}>" for i in range(6)]
    for number, broken in enumerate(('x {"filename": "data.warc.gz", "offset": 1', 'x {"filename": "data.warc.gz", "offset": "0", "length": "99999"}', 'x {"filename": "other.warc.gz", "offset": "0", "length": "9"}', "no place")):
        p = zipped(tmp_path / f"b{number}.wacz", archive__data_warc_gz=b"".join(parts), indexes__i_cdxj=line(0) + broken)
        with pytest.raises(Exception, match="broken line 2|aren't there"):
            warc.read(spark.createDataFrame([(p,)], "path string")).collect()


def test_pieces_of_an_archive_without_index(spark, tmp_path):
    import gzip

    inner = b"".join(plain_record(100 + i) for i in range(3)) + b"".join(gzip.compress(plain_record(200 + i)) for i in range(3))
    stored = lambda b: gzip.compress(b, 0)  # noqa: E731  what lies inside stands there as it is
    some = [plain_record(i, b"y" * (i * 37 % 400)) for i in range(40)] + [plain_record(40, inner * 5), plain_record(41)]
    for name, data in (("a_warc", b"".join(some)), ("b_warc_gz", b"".join(map(stored, some))), ("c_warc_gz", b"".join(gzip.compress(x) for x in some)), ("d_warc", b"\r\n\r\n".join(some))):
        p = zipped(tmp_path / f"{name}.wacz", **{f"archive__{name}": data})
        for piece in (64, 300, 1 << 20):
            got = warc.read(spark.createDataFrame([(p,)], "path string"), piece_bytes=piece).collect()
            assert sorted(int(r.record_id[5:-1]) for r in got) == list(range(42)), (name, piece)
            assert [r.payload for r in got if r.record_id == "<urn:40>"] == [inner * 5]


# 1 ----------------------------------------------------------------------------------------------------------------
def test_urls_like_a_loop(spark):
    rng = random.Random(8)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "a.com/p", "a.com/p/q", "b.org/r"]
    days = [f"2024-01-{i:02d}" for i in range(1, 29)]
    log = [(rng.choice("kl"), rng.choice(hosts), rng.choice(days), rng.choice(["add", "remove"])) for _ in range(60)]
    asked = [(i, f"http://{rng.choice(['a.com', 'x.a.com', 'z.y.x.a.com', 'b.org', 'aa.com'])}{rng.choice(['', '/', '/p', '/p/q/s', '/pp', '/r'])}", rng.choice(days)) for i in range(200)]

    def blocked(url, day):
        host, _, path = url[7:].partition("/")
        out = set()
        for lst in "kl":
            for pattern in hosts:
                state = False
                for d in days[: days.index(day) + 1]:
                    acts = {a for x, p, y, a in log if (x, p, y) == (lst, pattern, d)}
                    state = False if "remove" in acts else state or "add" in acts
                ph, _, pp = pattern.partition("/")
                fits = (host == ph and (path.rstrip("/") + "/").startswith(pp + "/")) if pp else host == ph or host.endswith("." + ph)
                if state and fits:
                    out.add(lst)
        return ",".join(sorted(out)) or None

    got = urlfilter.filter_urls(spark.createDataFrame(asked, "page_id int, url string, day string"), spark.createDataFrame(log, "list string, pattern string, day string, action string"))
    assert {r.page_id: r.lists for r in got.collect()} == {i: blocked(u, d) for i, u, d in asked}


def test_one_sentence_said_twice_in_a_short_text_is_no_junk(spark):
    from variorum.llm import repetition

    filler = " ".join(f"word{i}a other{i}b" for i in range(27))
    said = "the quick brown fox jumps over the lazy dog"
    rows = [(1, f"{said}. {filler} {said}"), (2, " ".join([said] * 8)), (3, filler)]
    got = {r.doc_id: r.keep for r in repetition.repetition(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_repetition_alone_is_junk_at_any_length(spark):
    said = "the quick brown fox jumps over the lazy dog"
    rows = [(1, "SHOU.!! THE.!! " * 5), (2, "a b c d e f " * 3), (3, f"{said}. {said}."), (4, said), (5, "yes no\n" * 4), (6, "one line\nanother line\none line"), (7, "Anha.")]
    got = {r.doc_id: r.keep for r in repetition.repetition(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: False, 6: True, 7: True}
