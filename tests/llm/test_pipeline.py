"""Every stage of the pipeline on what its predecessor kept, against a plain version of it, and the whole run."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from variorum.llm import bpe, langid, packing, repetition, simhash

SF = "/root/testdata/sf0.001"
FOREIGN = "Tämä lause on kirjoitettu suomeksi ja se kertoo säästä ja kaupungin ihmisistä pitkään ja hartaasti"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    said = "the same short sentence again and again "
    extra = [(900_001, said * 9, "en", "x", 1), (900_002, FOREIGN, "en", "x", 1), (900_003, None, "en", "x", 1), (900_004, "", None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).cache()
    out = [("documents", docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        out.append((name, docs.collect()))
    return out


def words(text):
    return [(m.start(), m.end()) for m in re.finditer(r"[^\t-\r ]+", text or "")]


def junk(text):
    """The rules as README states them, n-gram by n-gram."""
    text = text or ""
    w, chars = words(text), max(len(text), 1)
    if not w:
        return True
    more, hit = repetition.SENTENCE / len(w), False
    for n in range(2, 11):
        grams = [tuple(text[a:b] for a, b in w[i : i + n]) for i in range(len(w) - n + 1)]
        if n in repetition.TOP:
            count = Counter(grams)
            best = max(((c, w[grams.index(g) + n - 1][1] - w[grams.index(g)][0]) for g, c in count.items() if c > 1), default=(0, 0))
            hit |= min(1, best[0] * best[1] / chars) > repetition.TOP[n] + 2 * n / len(w)
        else:
            seen, inside = set(), set()
            for i, g in enumerate(grams):
                if g in seen:
                    inside.update(range(w[i][0], w[i + n - 1][1]))
                seen.add(g)
            hit |= len(inside) / chars > min(0.5, repetition.DUP[n] + more)
    lines = [x for x in text.split("\n") if x.strip()]
    again = [x for k, x in enumerate(lines) if x in lines[:k]]
    hit |= len(again) / max(1, len(lines)) > min(0.5, repetition.LINE + 1 / max(1, len(lines)))
    return hit or sum(map(len, again)) / chars > min(0.5, repetition.LINE_CHARS + more)


def test_quality_stage(stages):
    (_, before), (_, after) = stages[0:2]
    assert Counter(after) == Counter(r for r in before if not junk(r.text))
    assert {900_001, 900_003, 900_004} & {r.doc_id for r in after} == set() and 900_002 in {r.doc_id for r in after}


def grams(text):
    """Buckets of the letter n-grams of a text, one by one."""
    text, out = (text or "").lower(), []
    for n in langid.ORDERS:
        out += [int(langid.grams(np.array([ord(c) for c in text[i : i + n]], np.uint32), n)[0]) for i in range(len(text) - n + 1) if all(c.isalpha() for c in text[i : i + n])]
    return out


def test_language_stage(stages):
    """Naive Bayes with dictionaries, trained on all rows (fewer than the bound); each text against its nearest language."""
    (_, before), (_, after) = stages[1:3]
    bags = {id(r): Counter(grams(r.text)) for r in before}
    langs = sorted({r.lang for r in before})
    unique = {(r.lang, r.doc_id, r.text): bags[id(r)] for r in before}
    total = {k: defaultdict(float) for k in langs}
    for (k, *_), bag in unique.items():
        for g, n in bag.items():
            total[k][g] += n
    a = langid.ALPHA
    whole = {k: sum(total[k].values()) + a * langid.BUCKETS for k in langs}
    score = lambda k, bag: sum(n * math.log((total[k][g] + a) / whole[k]) for g, n in bag.items())
    held = defaultdict(list)
    for (k, *_), bag in unique.items():
        if m := sum(bag.values()):
            held[k].append((m, sum(n * math.log((total[k][g] + a - n) / (whole[k] - m)) for g, n in bag.items()) / m))
    level = {}
    for k, rows in held.items():
        w = [1 / (1 / m + 1 / langid.SCALE) for m, _ in rows]
        mean = sum(x * s for x, (_, s) in zip(w, rows)) / sum(w)
        level[k] = mean, math.sqrt(sum(x * (s - mean) ** 2 for x, (_, s) in zip(w, rows)) / len(rows))
    want = []
    for r in before:
        bag = bags[id(r)]
        if m := sum(bag.values()):
            s = {k: score(k, bag) for k in langs}
            k = max(langs, key=lambda x: s[x])
            mean, spread = level[k]
            sure = 1 / sum(math.exp(max(-700, s[x] - s[k])) for x in langs) >= langid.MIN_POSTERIOR
            if sure and s[k] / m >= mean - langid.LIMIT * spread * math.sqrt(1 / m + 1 / langid.SCALE):
                want.append(r)
    assert Counter(after) == Counter(want)
    assert 900_002 in {r.doc_id for r in before} - {r.doc_id for r in after}


def test_exact_stage(stages):
    (_, before), (_, after) = stages[2:4]
    least = {}
    for r in before:
        least[r.text] = min(least.get(r.text, r.doc_id), r.doc_id)
    assert sorted((r.doc_id, r.text) for r in after) == sorted((i, t) for t, i in least.items()) and len(after) < len(before)


def test_near_stage(spark, stages):
    (_, before), (_, after) = stages[3:5]
    prints = {r.id: np.array([r.f1, r.f2], np.int64).view(np.uint64) for r in simhash.with_fingerprints(spark.createDataFrame(before)).collect()}
    sets = {}
    for r in before:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", r.text.lower())
        sets[r.doc_id] = {tuple(w[i : i + simhash.GRAM]) for i in range(max(1, len(w) - simhash.GRAM + 1))}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if np.bitwise_count(prints[i] ^ prints[j]).sum() <= simhash.MAX_BITS and len(sets[i] & sets[j]) >= simhash.LEAST * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert Counter(after) == Counter(r for r in before if find(r.doc_id) == r.doc_id) and len(after) < len(before)


def test_near_stage_leaves_no_weak_link_out(spark):
    rng, rows = random.Random(5), []
    for k in range(150):
        words = [f"w{k}x{i}" for i in range(100)]
        tail = words[52:]
        rng.shuffle(tail)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:52] + tail))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, d, SF).collect()) == list(range(0, 300, 2))


def test_packing_stage_and_run(spark, stages):
    (_, before), (_, after) = stages[4:6]
    codec, got, fill = bpe.codec(bpe.VOCABULARY), defaultdict(list), Counter()
    for r in sorted(after, key=lambda r: r.piece):
        got[r.doc_id] += r.tokens
        fill[r.bin_id] += r.length
    assert got == {r.doc_id: codec.encode(r.text).tolist() for r in before}
    assert max(fill.values()) <= packing.CAPACITY
    run = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in run} == {r.doc_id for r in after if r.doc_id < 900_000}
