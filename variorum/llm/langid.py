"""Language ID (7): multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams (1 to 3 characters, of lower-cased text, hashed to ``BUCKETS``) of labelled texts, at most
``max_train`` of them per language - the one documented bound, on training alone - chosen by a hash of id and text,
whole texts. Rows equal in both are one. The counts are summed by Spark; what comes to the driver is bounded by buckets x languages. The smoothed
log-probability matrix is broadcast and every document is scored over its whole text in numpy: its n-grams' rows are
gathered and summed. Only n-grams of letters count: digits, signs and spaces tell no language.

Rejection. The posterior says only which of the known languages is nearest, so the mean log-likelihood per n-gram is
judged beside it. Each training row is scored without itself (its own counts are taken off), which gives each
language a mean and a spread; the variance of a text of n n-grams goes with 1 / n + 1 / ``SCALE``. A text more than
``LIMIT`` standard deviations below the mean of its nearest language is in none that the corpus declares. At most one
training row in LIMIT**2 can lie there, whatever the distribution. With hardly any training rows the spread is wide
and little is rejected. To the driver come two numbers a training row for it.

Edge cases. A null or empty text and one without any letter has no language: ``lang_pred`` is null, ``score`` 0 and
``keep`` false. Equal scores go to the language first in alphabetical order. Labels that are null are not learned from.
With no labelled row at all there is no model, and training raises ``ValueError`` - except over an empty table, which
gives an empty result. Rows are scored one by one, so repeated rows get equal rows. Null ids are ids like others. ``identify``
returns the columns ``keep`` and its own, which get an underscore where a column kept has their name;
``language_filter`` returns rows as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from variorum.llm.common import free, map_arrow, written

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
MAX_TRAIN = 1500
ALPHA = 0.5
MIN_POSTERIOR = 0.4
LIMIT, SCALE = 10, 128
SLICE_CHARS = 1 << 18
_M1, _M2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    logp: np.ndarray  # BUCKETS x languages, float32
    mean: np.ndarray | None = None  # per language, log-likelihood per n-gram of training rows; None rejects by posterior alone
    spread: np.ndarray | None = None

    def fits(self, best: np.ndarray, mean: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Whether texts of so many n-grams are as likely in their nearest language as its training rows are."""
        if self.mean is None:
            return np.ones(len(best), bool)
        return mean >= self.mean[best] - LIMIT * self.spread[best] * np.sqrt(1 / np.maximum(count, 1) + 1 / SCALE)


def grams(points: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram at each place where one begins (the last order - 1 places have none)."""
    n = len(points) - order + 1
    h = np.full(max(n, 0), 0x9747B28C * order % (1 << 32), np.uint32)
    for k in range(order):
        h = (h ^ (points[k : k + n] * _M1)) * _M2
        h ^= h >> np.uint32(15)
    return h & np.uint32(BUCKETS - 1)


@lru_cache(1)
def _alphabet() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def lettered(letters: np.ndarray, order: int) -> np.ndarray:
    """Whether the n-gram at each place where one begins has letters only."""
    n = max(len(letters) - order + 1, 0)
    out = np.ones(n, bool)
    for k in range(order):
        out &= letters[k : k + n]
    return out


def chunks(texts: list[str]):
    """Code points of several texts one after another, their lengths, and the row at which they begin."""
    first, size, part = 0, 0, []
    for i, t in enumerate(texts):
        part.append(t)
        size += len(t)
        if size >= SLICE_CHARS or i + 1 == len(texts):
            yield np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(x) for x in part]), first
            first, size, part = i + 1, 0, []


def texts_of(col: pa.Array) -> list[str]:
    return [(t or "").lower() for t in col.to_pylist()]


def has_letter(t: str) -> bool:
    return any(c.isalpha() for c in t)


def score(model_logp: np.ndarray, points: np.ndarray, lengths: np.ndarray, letters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each text in each language, and its number of n-grams; of ``letters`` only where given."""
    ends = np.cumsum(lengths)
    out, count = np.zeros((len(lengths), model_logp.shape[1])), np.zeros(len(lengths), np.int64)
    for order in ORDERS:
        g = grams(points, order)
        taken = np.ones(len(g), bool) if letters is None else lettered(letters, order)
        rows = model_logp[g[taken]]
        before = np.concatenate([[0], np.cumsum(taken)])
        sums = np.zeros((len(rows) + 1, rows.shape[1]))
        np.cumsum(rows, axis=0, dtype=np.float64, out=sums[1:])
        a = np.minimum(ends - lengths, len(g))
        z = np.minimum(a + np.maximum(lengths - order + 1, 0), len(g))
        out += sums[before[z]] - sums[before[a]]
        count += before[z] - before[a]
    return out, count


def train(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", max_train: int = MAX_TRAIN) -> Model | None:
    """The model, or None over an empty table. ``max_train`` bounds the labelled rows of each language."""
    rows = docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{label}`").cast("string").alias("l"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("h")).where("l is not null and t is not null")
    # A hash threshold per language leaves about max_train rows without a sort; what is over goes by rank among these few.
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        if docs.isEmpty():
            return None
        raise ValueError(f"no row has a label in {label}")
    langs = tuple(sorted(sizes))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, max_train / n)))])
    some = rows.where(F.pmod("h", F.lit(1 << 40)) < F.element_at(share, F.col("l")) * (1 << 40)).groupBy("l", "h").agg(F.first("t").alias("t"))
    least = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    taken = written(some.withColumn("n", least).where(F.col("n") <= max_train).select("t", "l"), "training")
    index = {k: i for i, k in enumerate(langs)}

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        total = np.zeros(BUCKETS * len(langs), np.int64)
        labels = np.array([index[x] for x in b.column(1).to_pylist()])
        for points, lengths, first in chunks(texts_of(b.column(0))):
            at = np.repeat(labels[first : first + len(lengths)], lengths)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            letters = _alphabet()[points]
            for order in ORDERS:
                g = grams(points, order).astype(np.int64)
                inside = (doc[: len(g)] == doc[order - 1 :]) & lettered(letters, order)
                total += np.bincount((g * len(langs) + at[: len(g)])[inside], minlength=len(total))
        cell = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    sums = map_arrow(taken, count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(BUCKETS * len(langs))
    total[sums["cell"].to_numpy(np.int64)] = sums["n"].to_numpy(np.float64)
    total = total.reshape(BUCKETS, len(langs)) + ALPHA
    mean, spread = likeness(taken, langs, total)
    return Model(langs, np.log(total / total.sum(axis=0)).astype(np.float32), mean, spread)


def likeness(taken: DataFrame, langs: tuple[str, ...], total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per language, mean and spread (at one n-gram) of the log-likelihood per n-gram of training rows, each scored by
    the counts without its own."""
    index = {k: i for i, k in enumerate(langs)}
    shared = taken.sparkSession.sparkContext.broadcast((total, total.sum(axis=0)))

    def held_out(b: pa.RecordBatch) -> pa.RecordBatch:
        total, whole = shared.value
        out = []
        for t, lang in zip(texts_of(b.column(0)), b.column(1).to_pylist()):
            points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            letters, k = _alphabet()[points], index[lang]
            own, n = np.unique(np.concatenate([grams(points, o)[lettered(letters, o)] for o in ORDERS]), return_counts=True)
            if len(own):
                out.append((k, int(n.sum()), float((n * np.log((total[own, k] - n) / (whole[k] - n.sum()))).sum() / n.sum())))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.float64()))], names=["l", "n", "m"])

    rows = map_arrow(taken, held_out, "l int, n bigint, m double").toPandas().sort_values(["l", "n", "m"])
    mean, spread = np.full(len(langs), -np.inf), np.zeros(len(langs))
    for k, r in rows.groupby("l"):
        w, m = 1 / (1 / r["n"].to_numpy() + 1 / SCALE), r["m"].to_numpy()
        mean[k] = (w * m).sum() / w.sum()
        spread[k] = np.sqrt((w * (m - mean[k]) ** 2).mean())
    return mean, spread


def verdicts(model: Model, col: pa.Array, allowed: tuple[str, ...] | None, min_posterior: float):
    """Predicted language, posterior and verdict of each text of a batch."""
    texts = texts_of(col)
    best, post, like = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), bool)
    for points, lengths, first in chunks(texts):
        s, count = score(model.logp, points, lengths, _alphabet()[points])
        p = np.exp(s - s.max(axis=1, keepdims=True))
        near = s.argmax(axis=1)
        best[first : first + len(lengths)] = near
        like[first : first + len(lengths)] = model.fits(near, s.max(axis=1) / np.maximum(count, 1), count)
        post[first : first + len(lengths)] = (p / p.sum(axis=1, keepdims=True)).max(axis=1)
    letters = np.array([has_letter(t) for t in texts], bool)
    pred = [model.langs[k] if ok else None for k, ok in zip(best, letters)]
    good = letters & like & (post >= min_posterior)
    if allowed is not None:
        good &= np.array([p in allowed for p in pred], bool)
    return pred, np.where(letters, np.round(post, 6), 0.0), good


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), allowed: tuple[str, ...] | None = None, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` (posterior of that language) and ``keep``."""
    body = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    names = free(["lang_pred", "score", "keep"], list(keep))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in body.schema.fields[:-1]), *(f"`{n}` {k}" for n, k in zip(names, ("string", "double", "boolean")))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        pred, post, good = verdicts(shared.value, b.column(len(keep)), allowed, min_posterior)
        return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(pred, pa.string()), pa.array(post), pa.array(good)], names=[*keep, *names])

    return map_arrow(body, run, fields)


def language_filter(docs: DataFrame, model: Model | None, text: str = "text", allowed: tuple[str, ...] | None = None, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """The rows of ``docs``, unchanged, whose language is known and allowed. No shuffle."""
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_arrow(docs, lambda b: b.filter(pa.array(verdicts(shared.value, b.column(at), allowed, min_posterior)[2])), docs.schema)
