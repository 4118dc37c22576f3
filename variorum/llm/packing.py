"""Best-fit packing (4): linear grouping, few-size configurations, actual documents, then best fit.

Documents, encoded by operator 3, become sequences of at most ``capacity`` tokens; a longer one is cut into full pieces
and a rest. Pieces of more than ``capacity / small`` tokens are *large*. Large pieces, ranked by length from the
longest, are split into ``groups`` groups of equal cardinality and each length is rounded up to its group's largest.
For those few sizes the cutting-stock linear programme is solved by column generation (dense simplex and an
unbounded-knapsack dynamic programme, both of a size that depends on ``groups`` and ``capacity`` only); its solution is
rounded down and the rest packed best-fit decreasing. The configurations number the bins' slots; a piece's rank in its
group is its slot, so the actual, smaller documents take the places by a range join with that small table. Last, small
pieces go, longest first, to the fullest bin that holds them.

That best fit is exact and global, whatever the number of pieces: it depends only on how many bins have which room and
how many pieces which length. Of the fullest bins that hold a length each takes as many pieces in a row as it can, for
after the first it is the fullest still. So the driver runs it on counts per room and length, whole runs of bins at a
time, and gets a table of which ranks of pieces go to which ranks of bins, whose size depends on ``capacity`` and
``groups`` only; the pieces take their places by join.

The pieces are written with their tokens under a number of their own; ranks, slots and bins are found on (number,
length) rows. What reaches the driver is one count per length and per room (at most ``capacity`` rows each). A rank
comes from counts per (length, salt) and a row number inside, so neither a hot length nor the whole table is sorted in
one task. At the end the pieces' tokens are joined to their bins by number: the bins are broadcast while their counted
size allows, and beyond that the tokens are shuffled once.

Edge cases. A null or empty text has length 0: it gets one row with a null ``bin_id``, ``length`` 0 and null or no
``tokens``. Rows that repeat an id are packed as often as they occur. Ties of length are broken by the pieces' numbers,
which of equal pieces goes where isn't defined. A null id is packed like any other. Extra columns are ignored; an output
column whose name the id has gets an underscore. Empty in, empty out.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from variorum.llm import bpe
from variorum.llm.common import ROW_BYTES, broadcast_if_small, free, written

CAPACITY, GROUPS, SMALL = 2048, 48, 16
SALT_ROWS = 200_000
#: Origin of the bins that small pieces open.
FRESH = -1


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most value of whole multiples of the sizes within the capacity, and the multiples."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    usable = np.flatnonzero(values > 1e-12)
    for c in range(1, capacity + 1):
        fit = usable[sizes[usable] <= c]
        best[c] = best[c - 1]
        if len(fit):
            v = best[c - sizes[fit]] + values[fit]
            k = int(v.argmax())
            if v[k] > best[c] + 1e-12:
                best[c], last[c] = v[k], fit[k]
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int, patience: int = 1000) -> list[tuple[int, np.ndarray]]:
    """(bins, pieces of each size in such a bin) that hold the demand. Sizes are distinct and within the capacity. Column
    generation goes on until no configuration improves the solution; should it stand still for ``patience`` rounds (the
    programme is degenerate), it warns and takes the solution it has, which holds the demand too."""
    s, d = np.array(sizes, np.int64), np.array(demand, np.float64)
    m = len(s)
    if not m:
        return []
    basis = np.diag(capacity // s).astype(np.float64)
    least, idle = np.inf, 0
    while idle < patience:
        x = np.linalg.solve(basis, d)
        least, idle = (x.sum(), 0) if x.sum() < least - 1e-9 else (least, idle + 1)
        duals = np.linalg.solve(basis.T, np.ones(m))
        value, column = knapsack(s, duals, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column.astype(np.float64))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        if not np.isfinite(ratio).any():
            break
        basis[:, int(ratio.argmin())] = column
    else:
        warnings.warn(f"column generation ended after {patience} rounds without progress; its last configurations are used", stacklevel=2)
    x = np.linalg.solve(basis, d)
    out, left = [], d.astype(np.int64)
    for n, column in zip(np.floor(x + 1e-9).astype(np.int64), basis.T.round().astype(np.int64)):
        if n > 0:
            out.append((int(n), column))
            left = left - n * column
    left = np.maximum(left, 0)
    # what the rounding left over: fewer pieces than m bins hold, best-fit decreasing
    room: list[int] = []
    held: dict[int, np.ndarray] = {}
    for k in np.argsort(-s, kind="stable"):
        for _ in range(int(left[k])):
            fits = [b for b, r in enumerate(room) if r >= s[k]]
            b = min(fits, key=lambda q: room[q]) if fits else len(room)
            if not fits:
                room.append(capacity)
                held[b] = np.zeros(m, np.int64)
            room[b] -= int(s[k])
            held[b][k] += 1
    return out + [(1, held[b]) for b in range(len(room))]


def linear_groups(counts: dict[int, int], groups: int) -> tuple[int, list[int], list[int]]:
    """Pieces a group, and each group's rounded size and demand, from the counts per length."""
    total = sum(counts.values())
    each = max(1, -(-total // groups))
    sizes, demand, seen, lengths = [], [], 0, sorted(counts, reverse=True)
    ends = np.cumsum([counts[x] for x in lengths])
    while seen < total:
        sizes.append(lengths[int(np.searchsorted(ends, seen, "right"))])
        demand.append(min(each, total - seen))
        seen += each
    return each, sizes, demand


def slot_table(each: int, sizes: list[int], demand: list[int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Rows (first rank, end of ranks, first bin, pieces a bin) over the global ranks, and the number of bins."""
    distinct = sorted(set(sizes), reverse=True)
    need = [sum(n for s, n in zip(sizes, demand) if s == x) for x in distinct]
    # groups of one size are neighbours in rank and form one class, whose ranks begin where its first group's do
    begin = [sizes.index(x) * each for x in distinct]
    used, rows, bins = [0] * len(distinct), [], 0
    for n, column in configurations(distinct, need, capacity):
        for k in np.flatnonzero(column):
            a = int(column[k])
            take = min(n * a, need[k] - used[k])
            if take > 0:
                rows.append((begin[k] + used[k], begin[k] + used[k] + take, bins, a))
                used[k] += take
        bins += n
    assert used == need
    return rows, bins


def best_fit(rooms: dict[int, int], need: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing of ``need`` (pieces per length) into bins counted by room. Rows (length, first rank, end of
    ranks, room the bins had at first, first of those bins, pieces each), and the number of bins opened."""
    by = {r: [(r, 0, n)] for r, n in rooms.items()}
    rows, opened = [], 0
    for n in sorted(need, reverse=True):
        at, end = 0, need[n]
        for room in sorted(r for r in by if r >= n):
            runs = by.pop(room)
            while runs and at < end:
                origin, a, z = runs.pop()
                each = room // n
                full = min(z - a, (end - at) // each)
                for bins, per in ((full, each), (1, (end - at) - full * each)):
                    if bins and per and a < z and at < end:
                        rows.append((n, at, at + bins * per, origin, a, per))
                        by.setdefault(room - per * n, []).append((origin, a, a + bins))
                        at, a = at + bins * per, a + bins
                if a < z:
                    runs.append((origin, a, z))
            if runs:
                by[room] = [*runs, *by.get(room, [])]
            if at == end:
                break
        each = capacity // n
        for bins, per in (((end - at) // each, each), (1, (end - at) % each)):
            if bins and per:
                rows.append((n, at, at + bins * per, FRESH, opened, per))
                by.setdefault(capacity - per * n, []).append((FRESH, opened, opened + bins))
                at, opened = at + bins * per, opened + bins
    return rows, opened


def ranked(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """``rank``, from 0, among the rows of equal ``by``, of which none has more than ``most``: from counts per salt."""
    salts = max(1, most // SALT_ROWS)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(order), F.lit(salts)).cast("int"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(by).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy(by, "salt").agg(F.count("*").alias("m")).select(by, "salt", before.alias("first"))
    own = F.row_number().over(Window.partitionBy(by, "salt").orderBy(order)) - 1
    return rows.withColumn("k", own).join(starts, [by, "salt"]).withColumn("rank", F.col("first") + F.col("k")).drop("salt", "first", "k")


def place(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """``pid``, ``bin_id`` of the pieces (``pid``, a number of their own, and ``len``) that aren't empty."""
    spark = pieces.sparkSession
    counts = {r["len"]: r["n"] for r in pieces.where("len > 0").groupBy("len").agg(F.count("*").alias("n")).collect()}
    cut = capacity // small
    large = {x: n for x, n in counts.items() if x > cut}
    each, sizes, demand = linear_groups(large, groups)
    rows, bins = slot_table(each, sizes, demand, capacity)
    ranks = written(ranked(pieces.where("len > 0").select("pid", "len"), "len", "pid", max(counts.values(), default=0)), "ranks")

    # per length, the slots that its ranks take: at most lengths + slots rows, whatever the input
    where, seen = [], 0
    for x in sorted(large, reverse=True):
        where += [(x, max(a, seen) - seen, min(z, seen + large[x]) - seen, seen - a, bin0, per) for a, z, bin0, per in rows if a < seen + large[x] and z > seen]
        seen += large[x]
    slots = spark.createDataFrame(where, "len int, a bigint, z bigint, off bigint, bin0 bigint, per bigint")
    here = (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("z"))
    big = ranks.where(F.col("len") > cut).join(broadcast_if_small(slots, len(where), ROW_BYTES), "len").where(here)
    big = written(big.select("pid", "len", (F.col("bin0") + F.floor((F.col("rank") + F.col("off")) / F.col("per"))).cast("bigint").alias("bin_id")), "large")

    gaps = big.groupBy("bin_id").agg((F.lit(capacity) - F.sum("len")).cast("int").alias("room")).where("room > 0")
    gaps = written(gaps, "gaps")
    rooms = {r["room"]: r["n"] for r in gaps.groupBy("room").agg(F.count("*").alias("n")).collect()}
    fits, _ = best_fit(rooms, {x: n for x, n in counts.items() if x <= cut}, capacity)
    plan = spark.createDataFrame(fits, "len int, a bigint, z bigint, room int, bin0 bigint, per bigint")
    little = ranks.where(F.col("len") <= cut).join(broadcast_if_small(plan, len(fits), ROW_BYTES), "len").where(here)
    little = little.select("pid", "room", (F.col("bin0") + F.floor((F.col("rank") - F.col("a")) / F.col("per"))).cast("bigint").alias("rank"))
    numbered = ranked(gaps, "room", "bin_id", max(rooms.values(), default=0))
    filled = little.where(F.col("room") != FRESH).join(numbered, ["room", "rank"]).select("pid", "bin_id")
    opened = little.where(F.col("room") == FRESH).select("pid", (F.col("rank") + bins).alias("bin_id"))
    return big.select("pid", "bin_id").unionByName(filled).unionByName(opened)


def pieces_of(tokens: DataFrame, capacity: int) -> DataFrame:
    """``id``, ``piece`` (0 ..), ``start``, ``len`` and ``tokens`` of each piece of the rows of ``id`` and ``tokens``."""
    n = F.greatest(F.coalesce(F.size("tokens"), F.lit(0)), F.lit(0))
    last = F.greatest(F.ceil(n / capacity) - 1, F.lit(0)).cast("int")
    cut = tokens.select("id", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return cut.select("id", "piece", (F.col("piece").cast("bigint") * capacity).alias("start"), F.least(F.lit(capacity), n - F.col("piece") * capacity).alias("len"), F.slice("tokens", F.col("piece") * capacity + 1, F.lit(capacity)).alias("tokens"))


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = bpe.VOCABULARY, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """``bin_id``, id (as ``key``), ``piece`` (0 ..), ``start`` and ``length`` in tokens, ``tokens``: one row per piece. The
    pieces of a bin are one training sequence."""
    body = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return pack_tokens(bpe.encode(body, "text", "id", vocabulary), key, capacity, groups, small)


def pack_tokens(encoded: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """The same from rows of ``id`` and ``tokens``."""
    pieces = written(pieces_of(encoded, capacity).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    placed = written(place(pieces, capacity, groups, small), "placed")
    whole = pieces.join(broadcast_if_small(placed, placed.count(), ROW_BYTES), "pid", "left")
    names = free(["bin_id", "piece", "start", "length", "tokens"], [key])
    columns: list[Column] = [F.col(c).alias(n) for c, n in zip(["bin_id", "piece", "start", "len", "tokens"], names)]
    return whole.select(columns[0], F.col("id").alias(key), *columns[1:])
