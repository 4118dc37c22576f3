"""SimHash near-dedup (9): a Gray-order hierarchical index over 128-bit fingerprints.

Fingerprint: the sign, bit by bit, of the sum over a document's distinct lower-cased words of the word's +-1 hash
bits; words of fewer than ``SHORT`` characters (mostly function words, shared by all documents of a language) count a
fifth. Near copies are documents whose fingerprints differ in at most ``MAX_BITS`` bits and whose whole texts share at
least ``LEAST`` of their ``GRAM``-word shingles (Jaccard; a shorter text is one shingle); groups are the connected
components of that relation and of each group the document with the least id stays.

The groups are whole: two passes find links, and the second leaves none out between groups, whatever the first found.
The first is there for speed only. It joins most copies by a forest, so that the second needn't look at the pairs within
a group, which grow as its square.

First pass. Equal word sequences are collapsed first, so a group of any number of equal texts is one point. One index over
all points can't prune at ``MAX_BITS`` of 128: a node of it shares some log2(points) bits, on which unrelated points
differ in half, far from the limit. So points are first blocked by what every pair that counts has in common: a
shingle. The shingles of a text are split by hash into ``TABLES`` bins and the least hash of each bin is a block's key.
Two texts that share ``LEAST`` of their shingles agree on a key with that probability a bin, so they meet in some
block with probability 1 - (1 - LEAST) ** TABLES = 0.94 at the limit (0.999 at 0.6), whatever the number of documents;
a document goes to at most ``TABLES`` blocks, so rows shuffled grow as the documents do. A block of more than
``BUCKET`` points - a passage that very many documents share, or very many near copies - is split by sampled
fingerprint bits, ever again while its parts are as large (``ROUNDS`` times); the number of samples keeps the
probability of meeting above ``RECALL`` for a pair at the full distance.

Search. In a block the search is exact. Fingerprints sorted by Gray rank form the leaves of a tree: ``LEAF`` of them
under a lowest node, ``FAN`` nodes under a higher one. A node keeps the bits on which all below it agree (mask and
pattern). Pairs of nodes are descended from the top; a pair's difference is the parents' accumulated difference plus
that on the bits newly shared, and a pair whose difference exceeds the limit is pruned with all below it, as is one
whose nodes lie in one and the same component already. A block drops pairs whose sketches (``BINS`` bytes, each of the
least shingle hash of its bin) hardly agree and reports a spanning forest of the rest, n - 1 pairs rather than all, so
thousands of mutual copies cost no more output than a chain. Each reported pair is then held against both whole texts
and is an edge only if they share enough shingles. Components over all blocks come from alternating star rounds over
written tables.

Second pass. Put the distinct shingles of all texts in one order, whichever. Two texts of which at least ``LEAST`` is
shared have one of the first n - ceil(LEAST n) + 1 of each text's n shingles in common, so the lists of texts by those
first shingles hold every pair that counts, without bound on a list. In each list all pairs of different groups of the first
pass within ``MAX_BITS`` are taken, no sketch asked and no forest grown, and held against their texts; those that pass
join groups. The order puts shingles that are frequent in a sample of some ``SAMPLE`` texts last, which keeps the lists
short; a poor sample costs time, never a pair. Cost: some 70 % of the distinct shingles are written and shuffled once, at
``TOKEN`` bytes each; pairs of different groups that are near in bits but not in text are each held against the texts,
and texts of many groups that share one rare passage are compared by fingerprint, pair by pair.

Edge cases. Null texts and texts without words have no fingerprint: such rows stay and have no partners. Rows with
equal ids are one document (any table row of that id goes or stays with it, and whatever is linked to one of its texts is in its group). A null id is kept and never grouped. Ties:
least id. Ids of any type that can be sorted will do: those that aren't integers are numbered in their order first.
Extra columns pass through. Empty in, empty out. Texts are always hashed whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variorum.llm.common import ROW_BYTES, broadcast_if_small, byte_hashes, drop, free, map_arrow, mix64, prefix_hash, release, runs_of, slices, sub_hash, text_buffers, written

MAX_BITS = 24
SHORT, SHORT_WEIGHT = 4, 0.2
TABLES, BUCKET, RECALL, ROUNDS = 8, 16_384, 0.93, 4
LEAF, FAN = 64, 8
LIST = 10_000
GRAM, LEAST = 3, 0.3
BINS, HINT = 32, 0.15
SAMPLE, SEEN, FREQUENT = 10_000, 3, 1 << 16
TOKEN, PARTS, PART_TOKENS = 6, 32, 3_000_000
_SKETCH = [f"s{i}" for i in range(BINS // 8)]
_KEYS = [f"k{i}" for i in range(TABLES)]
_FULL, _LOW = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0x7F7F7F7F7F7F7F7F)

# Word bytes: letters and digits of ASCII, and all of other characters.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_TOP = np.uint64(1 << 63)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes and texts of the words of lower-cased UTF-8 texts."""
    start, end = runs_of(_WORD[data], offsets)
    return start, end, byte_hashes(data, start, end), np.searchsorted(offsets, start, "right") - 1


def fingerprints(data: np.ndarray, offsets: np.ndarray, words: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) uint64 fingerprints of lower-cased UTF-8 texts, and the number of distinct words of each."""
    n = len(offsets) - 1
    out, number = np.zeros((n, 2), np.uint64), np.zeros(n, np.int64)
    start, end, h, doc = words or words_of(data, offsets)
    if not len(start):
        return out, number
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    order = np.lexsort((h, doc))
    h, doc, short = h[order], doc[order], (chars[end] - chars[start])[order] < SHORT
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    h, doc, short = h[new], doc[new], short[new]
    number[:] = np.bincount(doc, minlength=n)
    ends = np.cumsum(number)
    weight = np.where(short, np.float32(SHORT_WEIGHT), np.float32(1))
    both = np.stack([h, mix64(h ^ np.uint64(0xD6E8FEB86659FD93))], axis=1)
    for i in np.flatnonzero(number):
        a, b = ends[i] - number[i], ends[i]
        total = np.zeros(128, np.float32)
        for k in range(a, b, 8192):
            part = slice(k, min(k + 8192, b))
            total += weight[part] @ np.unpackbits(both[part].view(np.uint8).reshape(-1, 16), axis=1).astype(np.float32)
        # an exact half counts as 0; rounding keeps the sum of fifths from deciding it
        bits = np.round(2 * total - weight[a:b].sum(dtype=np.float32), 2) > 0
        out[i] = np.packbits(bits).view(np.uint64)
    return out, number


def shingles(data: np.ndarray, offsets: np.ndarray, words: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the word shingles of lower-cased texts, in place and with repeats, the text of each, and a hash of
    each text's whole word sequence."""
    n = len(offsets) - 1
    _, _, hashes, doc = words or words_of(data, offsets)
    number = np.bincount(doc, minlength=n)
    ends = np.cumsum(number)
    prefix = prefix_hash(hashes)
    first = np.flatnonzero((np.arange(len(doc)) + GRAM <= ends[doc]) | (np.arange(len(doc)) == (ends - number)[doc]))
    h = mix64(sub_hash(prefix, first, np.minimum(first + GRAM, ends[doc[first]])))
    return h, doc[first], mix64(sub_hash(prefix, ends - number, ends) ^ number.astype(np.uint64))


def least_hashes(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """(n, BINS): the least shingle hash of each bin of a text, all bits set where the bin is empty."""
    least = np.full(n * BINS, _FULL)
    np.minimum.at(least, doc * BINS + (h % np.uint64(BINS)).astype(np.int64), h)
    return least.reshape(n, BINS)


def sketches(least: np.ndarray) -> np.ndarray:
    """(n, BINS) bytes: a byte of each least hash, 0 where the bin is empty."""
    return np.where(least == _FULL, 0, mix64(least) % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def block_keys(least: np.ndarray) -> np.ndarray:
    """(n, TABLES): the key of each table's block, from the least hash of the bins that are one modulo TABLES; 0 where
    there is none."""
    m = least.reshape(len(least), BINS // TABLES, TABLES).min(axis=1)
    return np.where(m == _FULL, np.uint64(0), mix64(m ^ mix64(np.arange(TABLES, dtype=np.uint64))) | np.uint64(1))


def _zero_bytes(x: np.ndarray) -> np.ndarray:
    """How many bytes of each uint64 are 0."""
    return np.bitwise_count(~(((x & _LOW) + _LOW) | x | _LOW))


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether so many bins of two rows of sketches (as uint64) agree that the texts may share ``LEAST`` of their shingles."""
    same, unused = np.zeros(len(a), np.uint8), np.zeros(len(a), np.uint8)
    for k in range(a.shape[1]):
        x, y = a[:, k], b[:, k]
        same += _zero_bytes(x ^ y)
        unused += _zero_bytes(x | y)
    return same - unused >= np.maximum(1, ((BINS - unused) * HINT).astype(np.uint8))


def compared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Share of distinct shingles that the texts of two batches (bytes, offsets) have in common, row by row, and the
    hashes of both word sequences."""
    n = len(a[1]) - 1
    keys, rows, seqs = [], [], []
    for data, offsets in (a, b):
        h, doc, seq = shingles(data, offsets)
        u, at = np.unique(h ^ mix64(doc.astype(np.uint64)), return_index=True)
        keys.append(u)
        rows.append(doc[at])
        seqs.append(seq)
    u, at, times = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
    row = np.concatenate(rows)[at]
    return np.bincount(row[times > 1], minlength=n) / np.maximum(np.bincount(row, minlength=n), 1), *seqs


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Share of distinct shingles that the texts of two batches (bytes, offsets) have in common, row by row."""
    return compared(a, b)[0]


def verified(found: DataFrame, points: DataFrame, docs: DataFrame, text: str, key: str) -> DataFrame:
    """Of pairs of points (by ``seq``: src, dst) those whose whole texts share at least ``LEAST`` of their shingles, as ids."""
    named = [points.select(F.col("seq").alias(f"{c}_seq"), F.col("id").alias(c)) for c in ("src", "dst")]
    pairs = found.select(F.col("src").alias("src_seq"), F.col("dst").alias("dst_seq")).join(named[0], "src_seq").join(named[1], "dst_seq").where("src <> dst")
    pairs = written(pairs, "named")
    ids = written(pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "asked")
    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("t")).where("t is not null")
    texts = texts.join(broadcast_if_small(ids, ids.count(), ROW_BYTES), "id", "left_semi")
    both = pairs.join(texts.select(F.col("id").alias("src"), F.col("t").alias("a")), "src").join(texts.select(F.col("id").alias("dst"), F.col("t").alias("b")), "dst").select("src", "dst", "a", "b", "src_seq", "dst_seq")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        (da, oa, _), (db, ob, _) = (text_buffers(pc.utf8_lower(b.column(i))) for i in (2, 3))
        parts = [compared((da[oa[x] : oa[y]], oa[x : y + 1] - oa[x]), (db[ob[x] : ob[y]], ob[x : y + 1] - ob[x])) for x, y in slices(oa + ob)]
        share, src, dst = (np.concatenate(c) for c in zip(*parts))
        # an id may have other texts beside the pair's own
        own = (src.view(np.int64) == b.column(4).to_numpy()) & (dst.view(np.int64) == b.column(5).to_numpy())
        return b.select(["src", "dst"]).filter(pa.array(own & (share >= LEAST)))

    return map_arrow(both, run, "src bigint, dst bigint").distinct()


def frequency(docs: DataFrame, text: str) -> np.ndarray:
    """How frequent shingles are in a sample: a rank for each value of their hash's upper bits, the greatest of those it stands for."""
    ranks = np.zeros(1 << 20, np.uint8)
    if not (n := docs.count()):
        return ranks
    some = docs.select(F.col(f"`{text}`").alias("t")).where("t is not null").sample(min(1.0, SAMPLE / n), seed=7)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets, _ = text_buffers(pc.utf8_lower(b.column(0)))
        found = [np.zeros(0, np.uint64)]
        for x, y in slices(offsets):
            h, doc, _ = shingles(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
            end = np.searchsorted(doc, np.arange(y - x + 1))
            found += [np.unique(h[i:j]) for i, j in zip(end[:-1], end[1:])]
        u, times = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(times)], names=["h", "n"])

    often = map_arrow(some, run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN).orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    h = np.array([r.h for r in often], np.int64).view(np.uint64)
    np.maximum.at(ranks, (h >> np.uint64(44)).astype(np.int64), np.ceil(16 * np.log2([r.n for r in often] or [1])).clip(1, 255).astype(np.uint8)[: len(h)])
    return ranks


def first_tokens(h: np.ndarray, doc: np.ndarray, n: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's shingles, rarest first, those of which any text that shares ``LEAST`` has one among its own: their
    tokens (``TOKEN`` bytes each) and their number by text."""
    order = ranks[h >> np.uint64(44)].astype(np.uint64) << np.uint64(56) | h & np.uint64((1 << 56) - 1)
    ends = np.searchsorted(doc, np.arange(n + 1))
    for i, j in zip(ends[:-1], ends[1:]):
        order[i:j].sort()
    new = np.concatenate([[True], (order[1:] != order[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, bool)
    order, doc = order[new], doc[new]
    size = np.bincount(doc, minlength=n)
    # a tenth of a thousandth keeps a product's rounding from taking a token too few
    number = size - np.ceil(LEAST * size - 1e-4).astype(np.int64) + (size > 0)
    first = np.arange(len(doc)) - (np.cumsum(size) - size)[doc] < number[doc]
    return order[first, None].view(np.uint8)[:, :TOKEN], number


def with_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", ranks: np.ndarray | None = None) -> DataFrame:
    """``id``, ``f1``, ``f2`` (signed halves), the word sequence's hash ``seq``, the sketch and the block keys of each row
    that has an id and a word, and, where ranks are given, its first tokens and their number. No shuffle."""
    body = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("t")).where("id is not null and t is not null")
    names = ["id", "f1", "f2", "seq", *_SKETCH, *_KEYS]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets, _ = text_buffers(pc.utf8_lower(b.column(1)))
        parts, tokens = [], []
        for x, y in slices(offsets):
            d, o = data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]
            words = words_of(d, o)
            f, number = fingerprints(d, o, words)
            h, doc, seq = shingles(d, o, words)
            least = least_hashes(h, doc, y - x)
            parts.append(np.column_stack([f, seq, sketches(least).view(np.uint64), block_keys(least)])[number > 0])
            parts.append(np.flatnonzero(number > 0) + x)
            if ranks is not None:
                t, size = first_tokens(h, doc, y - x, ranks)
                tokens.append((t.reshape(-1), size[number > 0]))
        numbers, has = np.concatenate(parts[::2]).view(np.int64), np.concatenate(parts[1::2])
        cols = [b.column(0).take(pa.array(has)), *(pa.array(c) for c in numbers.T.copy())]
        if ranks is None:
            return pa.RecordBatch.from_arrays(cols, names=names)
        held, size = (np.concatenate(c) for c in zip(*tokens))
        at = np.concatenate([[0], np.cumsum(size * TOKEN)])
        blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(held)])
        return pa.RecordBatch.from_arrays([*cols, pa.array(size), blob.cast(pa.binary())], names=[*names, "n_tokens", "tokens"])

    return map_arrow(body, run, ", ".join(f"{c} bigint" for c in names) + ("" if ranks is None else ", n_tokens bigint, tokens binary"))


def plan(points: int, max_bits: int = MAX_BITS, bucket: int = BUCKET, recall: float = RECALL) -> tuple[int, int]:
    """Sampled bits K and samples T that split so many points into parts of a quarter bucket on average."""
    k = max(1, min(64, math.ceil(math.log2(max(points, 1) / max(1, bucket // 4)))))
    meet = math.prod((128 - max_bits - j) / (128 - j) for j in range(k))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def sampled(tables: int, k: int, seed: int) -> np.ndarray:
    """The bits of each sample: successive slices of shuffles of all 128, so that samples overlap little."""
    rng, pool = np.random.default_rng(97 + seed), []
    while len(pool) < tables * k:
        pool += rng.permutation(128).tolist()
    return np.array(pool[: tables * k]).reshape(tables, k)


def gray_rank(f: np.ndarray) -> np.ndarray:
    """Rank of each 128-bit word in the reflected Gray code: the prefix XOR from the highest bit, as (n, 2)."""
    hi, lo = f[:, 0].copy(), f[:, 1].copy()
    for s in (1, 2, 4, 8, 16, 32):
        hi ^= hi >> np.uint64(s)
        lo ^= lo >> np.uint64(s)
    lo ^= np.where(hi & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    return np.stack([hi, lo], axis=1)


def levels(f: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """From the lowest nodes up: shared pattern and mask of each. A lowest node has ``LEAF`` fingerprints, all of whose
    bits are known."""
    pattern, mask, step, out = f, np.full_like(f, _FULL), LEAF, []
    while True:
        at = np.arange(0, len(pattern), step)
        ones = np.bitwise_and.reduceat(pattern & mask, at)
        zeros = np.bitwise_and.reduceat(~pattern & mask, at)
        out.append((ones, ones | zeros))
        if len(at) == 1:
            return out
        (pattern, mask), step = out[-1], FAN


class Forest:
    """A spanning forest of points, grown by pairs."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.i, self.j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while len(i):
            a, b = root[i], root[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            if not len(i):
                return
            high, at = np.unique(np.maximum(a, b), return_index=True)
            self.i.append(i[at])
            self.j.append(j[at])
            root[high] = np.minimum(a, b)[at]
            while (root[root] != root).any():
                root[:] = root[root]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(self.i), np.concatenate(self.j)


def near_pairs(f: np.ndarray, max_bits: int = MAX_BITS, forest: Forest | None = None, chunk: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of the Gray-sorted fingerprints within ``max_bits``, by descent of pairs of nodes: all, or, where the
    caller grows a forest of them, those that aren't in one tree of it yet."""
    n = len(f)
    if n < 2:
        return
    tree = levels(f)
    halves = [np.concatenate([f[:, k], np.zeros(-n % LEAF, np.uint64)]).reshape(-1, LEAF) for k in (0, 1)]
    at = np.arange(0, n, LEAF)
    place = np.arange(LEAF)
    zero = np.zeros(1, np.int64)
    stack = [(len(tree) - 1, zero, zero, zero)]
    while stack:
        level, a, b, acc = stack.pop()
        if level:
            (pp, pm), (cp, cm) = tree[level], tree[level - 1]
            for x in range(0, len(a), 4 * chunk):
                y = slice(x, x + 4 * chunk)
                i = (a[y, None, None] * FAN + np.arange(FAN)[None, :, None]).repeat(FAN, 2).ravel()
                j = (b[y, None, None] * FAN + np.arange(FAN)[None, None, :]).repeat(FAN, 1).ravel()
                up = np.repeat(np.arange(len(a))[y], FAN * FAN)
                fits = (i < len(cp)) & (j < len(cp)) & (i <= j)
                i, j, up = i[fits], j[fits], up[fits]
                fresh = cm[i] & cm[j] & ~(pm[a[up]] & pm[b[up]])
                d = acc[up] + np.bitwise_count((cp[i] ^ cp[j]) & fresh).sum(axis=1, dtype=np.int64)
                ok = d <= max_bits
                stack.append((level - 1, i[ok], j[ok], d[ok]))
            continue
        for x in range(0, len(a), chunk):
            p, q = a[x : x + chunk], b[x : x + chunk]
            if forest is not None:
                low, high = np.minimum.reduceat(forest.root, at), np.maximum.reduceat(forest.root, at)
                apart = (low[p] != high[p]) | (low[q] != high[q]) | (low[p] != low[q])
                p, q = p[apart], q[apart]
            d = np.bitwise_count(halves[0][p][:, :, None] ^ halves[0][q][:, None, :])
            d += np.bitwise_count(halves[1][p][:, :, None] ^ halves[1][q][:, None, :])
            if forest is None:
                near = d <= max_bits
            else:
                root = np.concatenate([forest.root, np.full(-n % LEAF, -1)]).reshape(-1, LEAF)
                near = (d <= max_bits) & (root[p][:, :, None] != root[q][:, None, :])
            k, u, v = np.nonzero(near)
            i, j = p[k] * LEAF + place[u], q[k] * LEAF + place[v]
            ok = (i < j) & (j < n)
            if ok.any():
                yield i[ok], j[ok]


def block_forest(block: np.ndarray, f: np.ndarray, sketch: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of rows that share a block, are near and look alike. Rows are sorted by block."""
    n = len(block)
    start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(start, n))
    left = np.repeat(start + size, size) - np.arange(n) - 1  # rows of the block that follow a row
    forest = Forest(n)
    h, l = f[:, 0].copy(), f[:, 1].copy()
    # a block that fits into one lowest node has all its pairs there
    i, step = np.flatnonzero(np.repeat(size <= LEAF, size)), 0
    while len(i := i[left[i] > step]):
        step += 1
        near = i[np.bitwise_count(h[i] ^ h[i + step]) + np.bitwise_count(l[i] ^ l[i + step]) <= max_bits]
        near = near[alike(sketch[near], sketch[near + step])]
        forest.add(near, near + step)
    for a, m in zip(start[size > LEAF], size[size > LEAF]):
        rank = gray_rank(f[a : a + m])
        order = np.lexsort((rank[:, 1], rank[:, 0]))
        g, s, own = f[a : a + m][order], sketch[a : a + m][order], Forest(m)
        for step in (1, 2, 3, 5, 8):  # neighbours in Gray order are often near: what they join is skipped below
            i = np.arange(m - step)
            i = i[np.bitwise_count(g[i] ^ g[i + step]).sum(axis=1) <= max_bits]
            i = i[alike(s[i], s[i + step])]
            own.add(i, i + step)
        for i, j in near_pairs(g, max_bits, own):
            ok = alike(s[i], s[j])
            own.add(i[ok], j[ok])
        i, j = own.pairs()
        forest.add(a + order[i], a + order[j])
    return forest.pairs()


def parted(rows: DataFrame, large: DataFrame, count: int, max_bits: int, bucket: int, recall: float, seed: int) -> DataFrame:
    """The rows with those of the large blocks (``b``, ``n``) sent to parts of their block by samples of their bits."""
    small = broadcast_if_small(large, count, ROW_BYTES)

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, b = batch.column(batch.num_columns - 1).to_numpy(), batch.column(0).to_numpy().view(np.uint64)
        f = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()], 1)
        each = np.unpackbits(f.view(np.uint8).reshape(len(n), 16), axis=1)
        at, keys = [], []
        plans = np.array([plan(int(x), max_bits, bucket, recall) for x in n])
        for k, tables in np.unique(plans, axis=0):
            rows = np.flatnonzero((plans[:, 0] == k) & (plans[:, 1] == tables))
            for t, bits in enumerate(sampled(tables, k, seed)):
                value = np.zeros(len(rows), np.uint64)
                for bit in bits:
                    value = value * np.uint64(2) + each[rows, bit]
                at.append(rows)
                keys.append(mix64(mix64(b[rows] ^ np.uint64(t + 1)) ^ value))
        take = pa.array(np.concatenate(at))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(batch.column(i).take(take) for i in range(1, batch.num_columns - 1))], names=batch.schema.names[:-1])

    return rows.join(small, "b", "left_anti").unionByName(map_arrow(rows.join(small, "b").select(*rows.columns, "n"), split, rows.schema))


def block_edges(points: DataFrame, max_bits: int, bucket: int, recall: float, rounds: int = ROUNDS) -> DataFrame:
    """Pairs (src > dst) of points, by ``seq``, that share a block, are near and look alike by their sketches: a forest for
    the first pass, which may lack links and needn't be whole."""
    rows = points.select(F.explode(F.array(*_KEYS)).alias("b"), "seq", "f1", "f2", *_SKETCH).where("b <> 0")
    for seed in range(rounds):
        keys = points.select(F.explode(F.array(*_KEYS)).alias("b")).where("b <> 0") if seed == 0 else rows.select("b")
        large = written(keys.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > bucket), "large")
        if (count := large.count()) == 0:
            break
        rows = written(parted(rows, large, count, max_bits, bucket, recall, seed), "parted")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            cols = [np.concatenate(c) for c in zip(*parts)]
            same = cols[0][1:] == cols[0][:-1]
            met = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            cols = [c[met] for c in cols]
            seqs = cols[1]
            i, j = block_forest(cols[0], np.stack(cols[2:4], 1).view(np.uint64), np.stack(cols[4:], 1).view(np.uint64), max_bits)
            src, dst = np.maximum(seqs[i], seqs[j]), np.minimum(seqs[i], seqs[j])
            out = src != dst
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(src[out]), pa.array(dst[out])], names=["src", "dst"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # the block of the batch's last row may go on in the next batch
            if last or held and held[-1][0][-1] != cols[0][0]:
                yield from edges([*held, [c[:last] for c in cols]])
                held = []
            held.append([c[last:] for c in cols])
        if held:
            yield from edges(held)
        batch = cols = held = None
        release()

    ordered = rows.repartition("b").sortWithinPartitions("b")
    return ordered.mapInArrow(search, "src bigint, dst bigint").distinct()


def _wide(tokens: np.ndarray) -> np.ndarray:
    """Tokens of ``TOKEN`` bytes as uint64."""
    out = np.zeros((len(tokens) // TOKEN, 8), np.uint8)
    out[:, :TOKEN] = tokens.reshape(-1, TOKEN)
    return out.view(np.uint64)[:, 0]


def near_in_lists(token: np.ndarray, doc: np.ndarray, table: np.ndarray, max_bits: int) -> np.ndarray:
    """Pairs of rows of ``table`` (seq, two fingerprint halves, group) that share a token, differ in group and are near, as (n, 2),
    each once. ``token`` and ``doc`` are sorted by token."""
    def lists(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        t, d = token[keep], doc[keep]
        start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
        return t, d, start, np.diff(np.append(start, len(t)))

    shared = np.concatenate([[False], token[1:] == token[:-1]])[: len(token)]
    token, doc, start, size = lists(shared | np.append(shared[1:], False))
    if not len(token):
        return np.zeros((0, 2), np.int64)
    group = table[doc, 3]
    several = np.minimum.reduceat(group, start) != np.maximum.reduceat(group, start)
    token, doc, start, size = lists(np.repeat(several, size))
    group, h, l = table[doc, 3], table[doc, 1].view(np.uint64), table[doc, 2].view(np.uint64)
    left = np.repeat(start + size, size) - np.arange(len(doc)) - 1
    n, out = len(table), [np.zeros(0, np.int64)]

    def add(i: np.ndarray, j: np.ndarray) -> None:
        out.append(np.unique(np.minimum(doc[i], doc[j]) * n + np.maximum(doc[i], doc[j])))
        if sum(map(len, out[1:])) > max(1 << 20, len(out[0])):
            out[:] = [np.unique(np.concatenate(out))]

    i, step = np.flatnonzero(np.repeat(size <= LEAF, size)), 0
    while len(i := i[left[i] > step]):
        step += 1
        near = i[group[i] != group[i + step]]
        near = near[np.bitwise_count(h[near] ^ h[near + step]) + np.bitwise_count(l[near] ^ l[near + step]) <= max_bits]
        add(near, near + step)
    for a, m in zip(start[size > LEAF], size[size > LEAF]):
        f = np.stack([h[a : a + m], l[a : a + m]], 1)
        rank = gray_rank(f)
        at = np.lexsort((rank[:, 1], rank[:, 0]))
        groups = Forest(m)  # isn't grown: no pair here is proven
        groups.root = np.unique(group[a : a + m][at], return_inverse=True)[1]
        for i, j in near_pairs(f[at], max_bits, groups):
            add(a + at[i], a + at[j])
    code = np.unique(np.concatenate(out))
    return np.stack([code // n, code % n], 1)


def missed_edges(rows: DataFrame, tokens: int, max_bits: int) -> DataFrame:
    """All pairs of points, by ``seq``, of different groups (``root``) that are within ``max_bits`` and share a first token."""
    parts = max(PARTS, math.ceil(tokens / PART_TOKENS))

    def spread(b: pa.RecordBatch) -> pa.RecordBatch:
        table = np.stack([b.column(i).to_numpy() for i in range(4)], 1)
        held, offsets, _ = text_buffers(b.column(4).cast(pa.binary()))
        part = (_wide(held) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        doc, held = np.repeat(np.arange(len(table)), np.diff(offsets) // TOKEN)[order], held.reshape(-1, TOKEN)[order]
        out = []
        for p, (x, y) in enumerate(zip(ends[:-1], ends[1:])):
            if x < y:
                u, times = np.unique(doc[x:y], return_counts=True)
                out.append((p, table[u].tobytes(), times.astype(np.uint32).tobytes(), held[x:y].tobytes()))
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["part", "points", "times", "tokens"])

    def search(t: pa.Table) -> pa.Table:
        table, times, held = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t.column(c)]) for c, kind in (("points", np.int64), ("times", np.uint32), ("tokens", np.uint8)))
        table = table.reshape(-1, 4)
        # rows that repeat an id and its text are one point
        _, first, point = np.unique(table[:, 0], return_index=True, return_inverse=True)
        token = _wide(held)
        del t, held
        order = np.argsort(token)
        token = token[order]
        shared = np.concatenate([[False], token[1:] == token[:-1]])
        shared |= np.append(shared[1:], False)
        token, order = token[shared], order[shared]
        doc = np.repeat(point.astype(np.int32), times)[order].astype(np.int64)
        del order, shared
        if len(first) < len(table):
            order = np.lexsort((doc, token))
            token, doc = token[order], doc[order]
            once = np.concatenate([[True], (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])])[: len(doc)]
            token, doc = token[once], doc[once]
        pairs = np.sort(table[first, 0][near_in_lists(token, doc, table[first], max_bits)], axis=1)
        del table, token, doc, first, point, times
        release()
        return pa.table({"src": pairs[:, 1].copy(), "dst": pairs[:, 0].copy()})

    lists = map_arrow(rows.select("seq", "f1", "f2", "root", "tokens"), spread, "part bigint, points binary, times binary, tokens binary")
    return lists.groupBy("part").applyInArrow(search, "src bigint, dst bigint").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``id``, ``root`` (the least id of its component) for every id of the edges, root included: alternating
    large-star and small-star rounds, which end after about log of the diameter. Each round is a written table, so a
    lost executor costs one round at most. More rounds than ``rounds`` raise."""
    edges = written(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        old, edges = edges, written(linked.where("u <> v").distinct(), "edges")
        drop(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def with_number(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with its id as a bigint ``__id``, and, where the ids aren't integers, the table (``key``, ``__id``) that
    numbers them in their order."""
    if isinstance(docs.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return docs.withColumn("__id", F.col(f"`{key}`").cast("bigint")), None
    ids = docs.select(F.col(f"`{key}`").alias("k")).where("k is not null").distinct().sort("k")
    numbers = written(ids.select("k", F.monotonically_increasing_id().alias("__id")), "numbers")
    return docs.join(numbers, F.col(f"`{key}`") == F.col("k"), "left").drop("k"), numbers


def near_roots(docs: DataFrame, text: str = "text", key: str = "doc_id", max_bits: int = MAX_BITS, bucket: int = BUCKET, recall: float = RECALL) -> DataFrame:
    """``id``, ``root`` of every document that isn't alone; the root is the group's least id. ``key`` holds integers."""
    prints = written(with_fingerprints(docs, text, key, frequency(docs, text)), "prints")
    points = written(prints.groupBy("f1", "f2", "seq").agg(F.min("id").alias("id"), F.max("id").alias("last"), *(F.min(c).alias(c) for c in [*_SKETCH, *_KEYS])), "points")
    pairs = written(block_edges(points, max_bits, bucket, recall), "pairs")
    roots = written(components(verified(pairs, points, docs, text, key)), "roots")
    # each point once, by its least id, and the group it is in so far
    copied = written(points.where("last > id").select("f1", "f2", "seq", F.col("id").alias("point")), "copied")
    few, grouped = broadcast_if_small(copied, copied.count(), ROW_BYTES), broadcast_if_small(roots, roots.count(), ROW_BYTES)
    rows = prints.select("id", "f1", "f2", "seq", "tokens").join(few, ["f1", "f2", "seq"], "left").where("point is null or point = id").join(grouped, "id", "left").withColumn("root", F.coalesce("root", "id"))
    missed = written(missed_edges(rows, prints.agg(F.sum("n_tokens")).first()[0] or 0, max_bits), "missed")
    more = written(verified(missed, points, docs, text, key), "more")
    if not more.isEmpty():
        roots = written(components(roots.select(F.col("id").alias("src"), F.col("root").alias("dst")).where("src <> dst").union(more)), "roots")
    # a point's own documents hang on its least id; that one on the component's root
    same = prints.join(few, ["f1", "f2", "seq"]).select("id", "point").distinct()
    direct = roots.select("id", F.col("id").alias("point")).union(same).distinct()
    found = direct.join(roots.withColumnRenamed("id", "point"), "point", "left").select("id", F.coalesce("root", "point").alias("root"))
    found = written(found.distinct(), "found")
    # two prints of one id (rows that repeat an id with other texts) may name two roots: their groups are one
    twice = written(found.groupBy("id").agg(F.min("root").alias("dst"), F.max("root").alias("last")).where("dst < last").select("id", "dst"), "twice")
    if twice.isEmpty():
        return found
    merged = components(found.join(twice, "id").select(F.col("root").alias("src"), "dst"))
    return found.join(merged.select(F.col("id").alias("root"), F.col("root").alias("whole")), "root", "left").select("id", F.coalesce("whole", "root").alias("root")).distinct()


def near_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, unchanged, without those that are near copies of one with a lesser id."""
    rows, _ = with_number(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t")), "key")
    gone = written(near_roots(rows, "t", "__id", max_bits).where("id <> root").select(F.col("id").alias("__id")), "gone")
    return rows.join(broadcast_if_small(gone, gone.count(), ROW_BYTES), "__id", "left_anti").select("r.*")


def near_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per kept document: its id (as ``key``) and ``doc_ids``, the sorted ids of its group, its own included. A
    group of over ``LIST`` documents has several rows (``list_part``), so that no row grows without bound. A column whose
    name the id has gets an underscore."""
    rows, numbers = with_number(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t")), "key")
    roots = written(near_roots(rows, "t", "__id", max_bits), "groups")
    alone = rows.select(F.col("__id").alias("id"), "key").distinct().join(roots, "id", "left_anti")
    size = roots.groupBy("root").agg(F.ceil(F.count("*") / LIST).alias("parts"))
    if numbers is None:
        named = roots.select("id", "root", F.col("id").alias("member"), F.col("root").alias("first"))
    else:
        named = roots.join(numbers.select(F.col("__id").alias("id"), F.col("k").alias("member")), "id").join(numbers.select(F.col("__id").alias("root"), F.col("k").alias("first")), "root")
    kind = docs.schema[key].dataType
    lists = named.join(size, "root").groupBy("root", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("list_part")).agg(F.min("first").cast(kind).alias("first"), F.sort_array(F.collect_list("member")).cast(T.ArrayType(kind)).alias("doc_ids"))
    part, ids = free(["list_part", "doc_ids"], [key])
    out = lists.select("first", "list_part", "doc_ids").union(alone.select("key", F.lit(0), F.array("key")))
    return out.select(F.col("first").alias(key), F.col("list_part").alias(part), F.col("doc_ids").alias(ids))
