"""Quality rules (10): repetition coverage.

Rolling hashes of word n-grams of several lengths, in numpy, give the share of a document's characters that lie
inside repeated n-grams and repeated lines.

Definitions. Words are runs of bytes that aren't ASCII white space; n-grams are compared by their words alone. A
repeated n-gram's second and later occurrences are *duplicated*; an occurrence's span runs from its first word's
first to its last word's last character. ``dup_n`` (n = 5 .. 10) is the share of the document's characters in the
union of those spans. ``top_n`` (n = 2 .. 4) is count x length of the most frequent n-gram (of those, the longest)
over the characters, 1 at most, and 0 where no n-gram occurs twice. ``dup_line`` is the share of non-blank lines that
equal an earlier one, ``dup_line_chars`` those lines' characters over all characters. ``lines`` counts non-blank lines.

Edge cases. A null or empty text, and one of white space only, has 0 everywhere, no words, and is rejected
(``reason`` = 'empty'). No length is exempt from a rule. One sentence said twice is no junk, but a larger share of a
short text; so each limit allows for it: ``SENTENCE`` words over the text's words more for ``dup_n`` and ``dup_line_chars``,
one line over its lines for ``dup_line``, an n-gram said twice for ``top_n``. The limits of ``dup_n`` and of the line rules go
no higher than ``HALF``: a passage said twice reaches half at most, so where more is covered something is said at least
three times. Any length is scanned
whole. Rows are judged one by one, so repeated rows get equal rows and an empty table gives an empty one. ``repetition``
returns the columns ``keep`` and its own, which get an underscore where a column kept has their name; other columns are
ignored. ``quality_filter`` returns rows as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.llm.common import byte_hashes, free, map_arrow, mix64, prefix_hash, runs_of, slices, sub_hash, text_buffers

TOP = {2: 0.20, 3: 0.18, 4: 0.16}
DUP = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE, LINE_CHARS = 0.30, 0.20
SENTENCE = 16
HALF = 0.5
METRICS = [*(f"top_{n}" for n in TOP), *(f"dup_{n}" for n in DUP), "dup_line", "dup_line_chars"]

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _later(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by key, whether each sorted element repeats the one before it, and the runs' starts."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.concatenate([[False], k[1:] == k[:-1]]) if len(k) else np.zeros(0, bool)
    return order, same, np.flatnonzero(~same)


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The metrics of each text of one slice, with ``words`` and ``chars``."""
    n_docs = len(offsets) - 1
    chars_at = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars_at[1:])
    chars = np.diff(chars_at[offsets])
    out = {m: np.zeros(n_docs) for m in METRICS}
    safe = np.maximum(chars, 1)

    start, end = runs_of(~_SPACE[data], offsets)
    doc = np.searchsorted(offsets, start, "right") - 1
    words = np.bincount(doc, minlength=n_docs).astype(np.int64)
    out |= {"words": words, "chars": chars, "lines": np.zeros(n_docs, np.int64)}
    n_words = len(start)
    if n_words:
        prefix = prefix_hash(byte_hashes(data, start, end))
        cs, ce = chars_at[start], chars_at[end]
        salt = mix64(doc.astype(np.uint64))
        word_len = ce - cs
        gap_len = np.concatenate([cs[1:] - ce[:-1], [0]])
        repeated = np.ones(n_words, bool)  # whether the (n - 1)-gram at a word occurs more than once
        for n in range(2, 11):
            # an n-gram can only repeat where both (n - 1)-grams in it do
            at = np.flatnonzero(repeated[:-1] & repeated[1:]) if n > 2 else np.arange(n_words)
            at = at[at + n <= n_words]
            at = at[doc[at] == doc[at + n - 1]]
            key = mix64(sub_hash(prefix, at, at + n)) ^ salt[at]
            order, same, run = _later(key)
            repeated = np.zeros(n_words, bool)
            if not same.any():
                break
            sizes = np.diff(np.append(run, len(order)))
            many = np.repeat(sizes > 1, sizes)
            repeated[at[order[many]]] = True
            if n in TOP:
                first = at[order[run[sizes > 1]]]
                score = sizes[sizes > 1].astype(np.float64) * 2.0**32 + (ce[first + n - 1] - cs[first])
                best = np.zeros(n_docs)
                np.maximum.at(best, doc[first], score)
                count = np.floor(best / 2.0**32)
                out[f"top_{n}"] = np.minimum(1.0, count * (best - count * 2.0**32) / safe)
            elif n in DUP:
                again = at[order[same]]
                for part, length in ((n, word_len), (n - 1, gap_len)):
                    edge = np.zeros(n_words + 1, np.int64)
                    np.add.at(edge, again, 1)
                    np.add.at(edge, again + part, -1)
                    out[f"dup_{n}"] += np.bincount(doc, (np.cumsum(edge[:-1]) > 0) * length, n_docs)
                out[f"dup_{n}"] /= safe

    start, end = runs_of(data != 10, offsets)
    if len(start):
        blank = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_SPACE[data], out=blank[1:])
        full = blank[end] - blank[start] < end - start
        start, end = start[full], end[full]
    if len(start):
        doc = np.searchsorted(offsets, start, "right") - 1
        order, same, _ = _later(byte_hashes(data, start, end) ^ mix64(doc.astype(np.uint64)))
        again = order[same]
        out["lines"] = np.bincount(doc, minlength=n_docs).astype(np.int64)
        out["dup_line"] = np.bincount(doc[again], minlength=n_docs) / np.maximum(out["lines"], 1)
        out["dup_line_chars"] = np.bincount(doc[again], (chars_at[end] - chars_at[start])[again], n_docs) / safe
    return out


def measured(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    parts = [measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def broken(m: dict[str, np.ndarray]) -> list[tuple[str, np.ndarray]]:
    """The rules in the order in which they give the reason, with the texts that break them."""
    words, lines = np.maximum(m["words"], 1), np.maximum(m["lines"], 1)
    limits = [("dup_line", np.minimum(HALF, LINE + 1 / lines)), ("dup_line_chars", np.minimum(HALF, LINE_CHARS + SENTENCE / words))]
    limits += [(f"top_{n}", most + 2 * n / words) for n, most in TOP.items()] + [(f"dup_{n}", np.minimum(HALF, most + SENTENCE / words)) for n, most in DUP.items()]
    return [("empty", m["words"] == 0)] + [(name, m[name] > most) for name, most in limits]


def repetition(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, counts, metrics, ``keep`` and ``reason`` (null where kept; else the first rule broken)."""
    body = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    names = free(["words", "lines", *METRICS, "keep", "reason"], list(keep))
    kinds = ["bigint", "bigint", *["double"] * len(METRICS), "boolean", "string"]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in body.schema.fields[:-1]), *(f"`{n}` {k}" for n, k in zip(names, kinds))])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets, _ = text_buffers(b.column(len(keep)))
        m = measured(data, offsets)
        reason = np.full(b.num_rows, None, object)
        for name, hit in reversed(broken(m)):
            reason[hit] = name
        columns = [b.column(i) for i in range(len(keep))] + [pa.array(m["words"]), pa.array(m["lines"])] + [pa.array(np.round(m[x], 9)) for x in METRICS]
        columns += [pa.array([r is None for r in reason], pa.bool_()), pa.array(reason, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    return map_arrow(body, run, fields)


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged and with all their columns, that break no rule. No shuffle: the verdict is made where the row is."""
    at = docs.columns.index(text)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets, _ = text_buffers(b.column(at))
        bad = np.logical_or.reduce([hit for _, hit in broken(measured(data, offsets))])
        return b.filter(pa.array(~bad))

    return map_arrow(docs, run, docs.schema)
