"""BPE encoding and decoding (3): tree concatenation.

Short texts are encoded where they are. A long text is cut, by halves, into parts of at most ``part`` characters, which
are encoded in parallel by any tasks; then neighbours are joined, level by level, as in a tree. At a join a window of
tokens on either side is decoded and encoded anew; it grows until the new tokens agree with the old ones of both sides
in a way that proves the rest unchanged, and the tokens between are replaced. The result is that of encoding the whole text at
once, exactly. What proves it:

* A *break* - a non-space character followed by a space - ends a pre-token whatever surrounds it, under the pattern
  used here. If the window holds a break on either side of the join, all beyond is independent of the cut.
* Inside one long pre-token there is no break. There a token sequence is the BPE encoding of its bytes if each pair of
  neighbours is; so where the window lies inside one run of characters of a class, with more of the run on either
  side, agreement in its first and its last token suffices.
* Otherwise the window grows to the ends of both halves, which is the whole encoding again.

Edge cases. A null text has null tokens; an empty one, none. Special tokens' strings are ordinary text. Characters that
can't be encoded (lone surrogates) can't occur in Spark's strings. Repeated rows and null ids give as many rows as they
are; rows of one id with other texts are kept apart by the text's hash. Empty in, empty out. ``encode`` reads id and text
alone; an id named ``tokens`` gives ``tokens_``. ``decode`` passes columns through; one named like its output is replaced.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variorum.llm.common import besides, free, map_arrow

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PART, LONG_BYTES = 16_384, 32_768
WINDOW = 8
_CLASSES = [regex.compile(c) for c in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")]
_BREAK = regex.compile(r"\S(?=\s)")
_LAST_BREAK = regex.compile(r"(?s)(.*\S)(?=\s)")


class Codec:
    """The tiktoken encoding of a rank file, with the tree join."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding(path.rpartition("/")[2], pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for b, i in ranks.items():
            self.size[i] = len(b)

    def encode(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def decode(self, tokens: np.ndarray) -> str:
        return self.bpe.decode_bytes(tokens.tolist()).decode("utf-8", "replace")

    def tail(self, tokens: np.ndarray, k: int) -> tuple[int, bytes]:
        """At least k last tokens, more where the k-th begins inside a character: how many, and their bytes."""
        while True:
            k = min(k, len(tokens))
            data = self.bpe.decode_bytes(tokens[len(tokens) - k :].tolist())
            if k == len(tokens) or (data[0] & 0xC0) != 0x80:
                return k, data
            k += 1

    def head(self, tokens: np.ndarray, k: int) -> tuple[int, bytes]:
        while True:
            k = min(k, len(tokens))
            data = self.bpe.decode_bytes(tokens[:k].tolist())
            if k == len(tokens) or (self.bpe.decode_single_token_bytes(int(tokens[k]))[0] & 0xC0) != 0x80:
                return k, data
            k += 1

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of both halves' text from those of each."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        k = WINDOW
        while True:
            a, lb = self.tail(left, k)
            b, rb = self.head(right, k)
            lt, rt = lb.decode(), rb.decode()
            new = self.encode(lt + rt)
            cut_l = self._left(left, a, lt, rt, new)
            cut_r = self._right(right, b, lt, rt, new)
            if cut_l and cut_r:
                return np.concatenate([left[: len(left) - a + cut_l[0]], new[cut_l[1] : cut_r[1]], right[cut_r[0] :]])
            k *= 4

    def _at(self, tokens: np.ndarray, cut: int) -> int:
        """How many tokens make up the first ``cut`` bytes; a token border stands there."""
        i = int(np.searchsorted(np.cumsum(self.size[tokens]), cut)) + 1
        assert self.size[tokens[:i]].sum() == cut
        return i

    def _left(self, left: np.ndarray, a: int, lt: str, rt: str, new: np.ndarray) -> tuple[int, int] | None:
        """Up to which of the window's old tokens the left is settled, and from which of the new on those hold."""
        if m := _LAST_BREAK.match(lt):
            cut = len(lt[: m.end(1)].encode())
            return self._at(left[len(left) - a :], cut), self._at(new, cut)
        if a == len(left):
            return 0, 0
        if new[0] == left[len(left) - a]:
            before = self.tail(left[: len(left) - a], 4)[1].decode()[-3:]
            first = self.bpe.decode_single_token_bytes(int(new[0])).decode("utf-8", "replace")
            if self._one_class(before + (lt + rt)[: len(first) + 3], len(first) + 6):
                return 0, 0
        return None

    def _right(self, right: np.ndarray, b: int, lt: str, rt: str, new: np.ndarray) -> tuple[int, int] | None:
        if m := _BREAK.search(rt):
            cut = len(rt[: m.end()].encode())
            return self._at(right[:b], cut), self._at(new, len(lt.encode()) + cut)
        if b == len(right):
            return b, len(new)
        if new[-1] == right[b - 1]:
            after = self.head(right[b:], 4)[1].decode()[:3]
            last = self.bpe.decode_single_token_bytes(int(new[-1])).decode("utf-8", "replace")
            if self._one_class((lt + rt)[-len(last) - 3 :] + after, len(last) + 6):
                return b, len(new)
        return None

    @staticmethod
    def _one_class(text: str, least: int) -> bool:
        return len(text) >= least and any(c.fullmatch(text) for c in _CLASSES)

    def tree(self, parts: list[np.ndarray]) -> np.ndarray:
        """Neighbours joined level by level."""
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else np.zeros(0, np.int32)


def halves(text: str, part: int) -> list[str]:
    """The text cut by halves until no part is longer than ``part``."""
    parts = [text]
    while len(parts[0]) > part:
        parts = [x for p in parts for x in (p[: (len(p) + 1) // 2], p[(len(p) + 1) // 2 :])]
    return [p for p in parts if p]


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _lists(parts: list[np.ndarray | None]) -> pa.ListArray:
    sizes = np.array([0 if p is None else len(p) for p in parts], np.int64)
    flat = np.concatenate([p for p in parts if p is not None] or [np.zeros(0, np.int32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat), mask=pa.array([p is None for p in parts]))


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY, long_bytes: int = LONG_BYTES, part: int = PART) -> DataFrame:
    """Id (as ``key``) and ``tokens`` (array of int): one row per row of ``docs``. Only texts of more than ``long_bytes``
    are shuffled; rows equal in id and text are encoded once and given as often as they occur."""
    body = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("t"))
    kind = body.schema.fields[0].dataType.simpleString()
    long = F.coalesce(F.octet_length("t"), F.lit(0)) > long_bytes

    def short(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(vocabulary)
        return pa.RecordBatch.from_arrays([b.column(0), _lists([None if t is None else c.encode(t) for t in b.column(1).to_pylist()])], names=["id", "tokens"])

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(k, i, p) for k, t in enumerate(b.column(4).to_pylist()) for i, p in enumerate(halves(t, part))]
        at = pa.array([r[0] for r in rows])
        return pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(4)), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows])], names=["id", "h1", "h2", "n", "i", "p"])

    def encoded(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(vocabulary)
        return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), _lists([c.encode(t) for t in b.column(5).to_pylist()])], names=["id", "h1", "h2", "n", "i", "tokens"])

    def joined(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        col = t.column("tokens").combine_chunks()
        ends, flat = col.offsets.to_numpy(), col.values.to_numpy()
        tokens = codec(vocabulary).tree([flat[x:y] for x, y in zip(ends, ends[1:])])
        n = t.column("n")[0].as_py()
        return pa.table({"id": t.column("id").slice(0, 1).take(pa.array([0] * n)), "tokens": _lists([tokens] * n)})

    few = map_arrow(body.where(~long), short, f"id {kind}, tokens array<int>")
    unique = body.where(long).groupBy("id", "t").agg(F.count("*").alias("n")).select("id", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(7), "t").alias("h2"), "n", "t")
    spread = map_arrow(unique, cut, f"id {kind}, h1 bigint, h2 bigint, n bigint, i int, p string").repartition("h1", "i")
    tokens = map_arrow(spread, encoded, f"id {kind}, h1 bigint, h2 bigint, n bigint, i int, tokens array<int>")
    many = tokens.groupBy("id", "h1", "h2").applyInArrow(joined, f"id {kind}, tokens array<int>")
    return few.unionByName(many).select(F.col("id").alias(key), F.col("tokens").alias(*free(["tokens"], [key])))


def decode(rows: DataFrame, tokens: str = "tokens", out: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows with ``out``, their tokens' text; null for null. No shuffle."""
    names = besides(rows, [out])
    if tokens not in names:
        names.append(tokens)  # the output is named like its source and takes its place
    rows, at, given = rows.select(*[F.col(f"`{c}`") for c in names]), names.index(tokens), [c for c in names if c.lower() != out.lower()]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe, col = codec(vocabulary).bpe, b.column(at)
        ends, flat, valid = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False), col.is_valid().to_pylist()
        texts = [bpe.decode_bytes(flat[x:y].tolist()).decode("utf-8", "replace") if ok else None for x, y, ok in zip(ends, ends[1:], valid)]
        return pa.RecordBatch.from_arrays([*(b.column(i) for i, c in enumerate(names) if c in given), pa.array(texts, pa.string())], names=[*given, out])

    return map_arrow(rows, run, T.StructType([*(rows.schema[c] for c in given), T.StructField(out, T.StringType(), True)]))
