"""Exact dedup (8): skew-safe combining.

Three stages, each comparing full content, not only digests: equal texts are combined inside each task; the tasks'
winners are merged by (digest, salt, text), the salt following from the task, so that a text with any number of copies
is spread over ``salts`` reducers; the salts' winners, at most ``salts`` rows a text, are combined by (digest, text).
The winner is the row with the least id.

A digest that occurs once in the table can't have a copy. Digests alone (16 bytes a row, combined map-side) are
counted first, one left join marks the rows whose digest occurs again, and only their texts go on to the three stages;
a wrong digest match only means one more text to compare. While the counted size of the repeated digests allows, they
are broadcast and the other rows' texts never move. Beyond, the join shuffles every row once, its text once in it, and
the marked rows are written, so that both branches read them and nothing is shuffled again for the second.

Edge cases. A null text is no copy of anything: such rows all stay, and take no part in join or shuffle. Empty texts are
equal to each other. Rows that repeat both id and text are copies too, and one stays: of those, the one least by hash of
its columns. A null id sorts last; ids may be of any type that can be sorted, and any number of rows may share one.
Columns beyond id and text pass through; names used inside can't clash with them. ``exact_groups`` calls its count
``n_copies_`` where the id itself is named ``n_copies``. Empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variorum.llm import common
from variorum.llm.common import free, written

SALTS = 16


def digest(c: Column) -> list[Column]:
    return [F.xxhash64(c).alias("d1"), F.xxhash64(F.lit(7), c).alias("d2")]


def split(docs: DataFrame, text: str, key: str, salts: int, keep: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of ``o`` (the columns ``keep`` in a struct), ``t`` (the text) and ``n``: those without a text, those whose
    text is alone, and the winners with their copies."""
    t = F.col(f"`{text}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("o"), F.struct(F.col(f"`{key}`").isNull().alias("last"), F.col(f"`{key}`").alias("id")).alias("i"), t.alias("t"))
    full = rows.where("t is not null").select("o", "i", "t", *digest(F.col("t")))
    marks = docs.where(t.isNotNull()).select(*digest(t))
    again = written(marks.groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1").select("d1", "d2", F.lit(True).alias("many")), "digests")
    small = again.count() * common.ROW_BYTES <= common.BROADCAST_BYTES
    marked = full.join(F.broadcast(again) if small else again.hint("merge"), ["d1", "d2"], "left")
    if not small:
        marked = written(marked, "marked")
    may = marked.where("many").select("d1", "d2", "t", F.struct("o", F.struct("i", F.xxhash64("o").alias("h")).alias("by")).alias("w"), (F.spark_partition_id() % salts).alias("salt"))
    salted = may.groupBy("d1", "d2", "t", "salt").agg(F.min_by("w", "w.by").alias("w"), F.count("*").alias("n"))
    best = salted.groupBy("d1", "d2", "t").agg(F.min_by("w", "w.by").alias("w"), F.sum("n").alias("n"))
    one = F.lit(1).cast("bigint").alias("n")
    return rows.where("t is null").select("o", "t", one), marked.where("many is null").select("o", "t", one), best.select("w.o", "t", "n")


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """One row per kept document: its id (as ``key``) and ``n_copies``, the rows with its text, itself included."""
    none, alone, best = split(docs, text, key, salts, [key])
    return none.unionByName(alone).unionByName(best).select(F.col(f"o.`{key}`").alias(key), F.col("n").alias(*free(["n_copies"], [key])))


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """The kept rows of ``docs`` with all their columns, unchanged."""
    none, alone, best = split(docs, text, key, salts, [c for c in docs.columns if c != text])
    return none.unionByName(alone).unionByName(best).select(*[F.col("t").alias(c) if c == text else F.col(f"o.`{c}`").alias(c) for c in docs.columns])
