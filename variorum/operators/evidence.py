"""The evidence layer: correlations, ledgers, samples and scores over entries and pages, as joins and aggregations.

A side is broadcast only under a counted size or where Spark's own estimate allows it; what grows with the corpus is
shuffled on its key, and a hot key is split in blocks.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from variorum.functions import text as X
from variorum.operators.sizes import BLOCK, BROADCAST_BYTES, block_of, blocked_number, small


def dangling(refs: DataFrame, declared: DataFrame, ref: str, target: str) -> DataFrame:
    """References to what isn't declared. A null reference points nowhere and isn't one."""
    d = declared.select(F.col(target).alias("__t")).distinct()
    return refs.where(F.col(ref).isNotNull()).join(d, F.col(ref) == F.col("__t"), "left_anti")


def duplicate_tokens(df: DataFrame, tokens: str) -> DataFrame:
    return df.where(F.size(tokens) != F.size(F.array_distinct(tokens)))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has oftener, with ``only_in`` and ``n``; one aggregation of signed counts by the whole row."""
    cols = a.columns
    both = a.withColumn("__w", F.lit(1)).unionByName(b.withColumn("__w", F.lit(-1)))
    d = both.groupBy(*cols).agg(F.sum("__w").alias("__d")).where("__d <> 0")
    return d.select(*cols, F.when(F.col("__d") > 0, "first").otherwise("second").alias("only_in"), F.abs("__d").alias("n"))


def carry_forward(df: DataFrame, value: str, partition: str, order: str) -> DataFrame:
    """``carried``: the last value that isn't null, up to and with the row."""
    return df.withColumn("carried", F.last(value, ignorenulls=True).over(Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def ranges(df: DataFrame, group: str, value: str, block: int = BLOCK) -> DataFrame:
    """Runs of consecutive numbers of each group, as rows (``first``, ``last``). Runs are found in blocks of values; only
    those that touch a block's border, two a block at most, are then joined over the group."""
    d = df.select(group, value).distinct().withColumn("__b", block_of(F.col(value), block))
    island = F.col(value) - F.row_number().over(Window.partitionBy(group, "__b").orderBy(value))
    runs = d.withColumn("__i", island).groupBy(group, "__b", "__i").agg(F.min(value).alias("first"), F.max(value).alias("last"))
    at_border = (F.col("first") == F.col("__b") * block) | (F.col("last") == (F.col("__b") + 1) * block - 1)
    w = Window.partitionBy(group).orderBy("first")
    fresh = F.coalesce(F.col("first") != F.lag("last").over(w) + 1, F.lit(True)).cast("int")
    border = runs.where(at_border).select(group, "first", "last", fresh.alias("__n"))
    border = border.withColumn("__g", F.sum("__n").over(w)).groupBy(group, "__g").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.where(~F.coalesce(at_border, F.lit(False))).select(group, "first", "last").unionByName(border.select(group, "first", "last"))


def range_text(df: DataFrame, group: str) -> DataFrame:
    """``pages``: the runs as in ``1-3,7``."""
    item = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    s = F.array_sort(F.collect_list(F.struct("first", item.alias("s"))))
    return df.groupBy(group).agg(F.array_join(F.transform(s, lambda x: x["s"]), ",").alias("pages"))


def fill_gaps(df: DataFrame, group: str, value: str, most: int, block: int = BLOCK) -> DataFrame:
    """The hits and all numbers between two hits at most ``most`` apart. A hit's successor is sought in its block of
    values; the last hit of a block has the least of the next block that holds any."""
    d = df.select(group, value).distinct().withColumn("__b", block_of(F.col(value), block))
    least = d.groupBy(group, "__b").agg(F.min(value).alias("__f"))
    after = least.select(F.col(group).alias("__g"), F.col("__b").alias("__c"), F.lead("__f").over(Window.partitionBy(group).orderBy("__b")).alias("__f"))
    d = d.withColumn("__n", F.lead(value).over(Window.partitionBy(group, "__b").orderBy(value)))
    d = d.join(after, F.col(group).eqNullSafe(F.col("__g")) & F.col("__b").eqNullSafe(F.col("__c")), "left").withColumn("__n", F.coalesce("__n", "__f"))
    end = F.when(F.col("__n") - F.col(value) <= most, F.col("__n") - 1).otherwise(F.col(value))
    return d.select(group, F.explode(F.sequence(F.col(value), end)).alias(value))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, start: str, value: str) -> DataFrame:
    """Each left row with the ``value`` of the greatest right ``start`` at or before ``at``: one sort of the union per
    key instead of a range join, so a key's rows meet once however many there are. Of equal starts the greatest value."""
    names = left.columns
    lefts = left.select(key, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.struct(*names).alias("__row"))
    rights = right.groupBy(key, F.col(start).alias("__at")).agg(F.max(value).alias("__v")).select(key, "__at", F.lit(0).alias("__side"), "__v", F.lit(None).cast(lefts.schema["__row"].dataType).alias("__row"))
    w = Window.partitionBy(key).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return rights.unionByName(lefts).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").select("__row.*", F.col("__v").alias(value))


def phrases(docs: DataFrame, items: DataFrame, doc: str, item: str, text: str = "text", n: int = 3) -> DataFrame:
    """(doc, item) pairs where the document holds the item's words in a row. Candidates come from an equi-join on the
    item's first words (``n`` or all it has), hashed; each is verified over the whole text. Items of no word match
    nothing. No text is shuffled while the counted items, and the candidates that they find, fit into memory: both are
    broadcast to the documents where they are."""
    words = lambda c: F.filter(F.split(X.normalise(c), " "), lambda w: w != "")
    it = items.select(item, words(F.col(text)).alias("w")).where(F.size("w") > 0)
    it = it.select(item, F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("phrase"), F.xxhash64(F.slice("w", 1, n)).alias("h"), F.least(F.size("w"), F.lit(n)).alias("m"))
    known = it.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("phrase")), F.lit(0)).alias("chars"), F.array_sort(F.collect_set("m")).alias("m")).first()
    d = docs.select(doc, F.explode(F.array(words(F.col(text)))).alias("w"))  # a generator: the words are made once

    def grams(m: int) -> Column:
        ends = F.sequence(F.lit(1), F.size("w") - (m - 1))
        return F.when(F.size("w") >= m, F.transform(ends, lambda i: F.xxhash64(F.slice("w", i, m)))).otherwise(F.array().cast("array<bigint>"))

    each = F.array_distinct(F.concat(*map(grams, known.m))) if known.m else F.array().cast("array<bigint>")
    found = d.select(doc, F.explode(each).alias("h")).join(small(it.select(item, "h"), known.n, 64), "h").select(doc, item)
    found = found.join(small(it.select(item, "phrase"), known.n, 64 + 4 * known.chars // max(1, known.n)), item).distinct()
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("phrase")), F.lit(0)).alias("chars")).first()
    near = small(found, size.n, 64 + 4 * size.chars // max(1, size.n))
    whole = docs.select(doc, F.concat(F.lit(" "), X.normalise(F.col(text)), F.lit(" ")).alias("whole"))
    return whole.join(near, doc).where(F.contains("whole", "phrase")).select(doc, item).distinct()


def floor_of(source: Column) -> Column:
    """The least examined number that proves anything: a tenth, rounded up, and one at least."""
    return F.greatest(F.lit(1), F.ceil(source * F.lit(0.1))).cast("bigint")


def best(docs: DataFrame, items: DataFrame, doc: str, item: str, text: str = "text", least: int = 6) -> DataFrame:
    """For each item the document that shares most of its words of ``least`` or more letters (10 + length, 120 at most,
    points each); of equals the least id. While the items' counted words fit into memory each batch of documents is
    scored against all of them where it is, and only its best document of each item is shuffled; beyond, words are
    joined by shuffle."""
    terms = lambda c: F.array_distinct(F.filter(F.split(F.lower(X.normalise(c)), "[^a-z]+"), lambda w: F.length(w) >= least))
    i = items.select(F.col(item).alias("item"), F.explode(terms(F.col(text))).alias("w"))
    d = docs.select(F.col(doc).alias("doc"), terms(F.col(text)).alias("ws")).where("doc is not null")
    if i.count() * 64 <= BROADCAST_BYTES:
        rows = i.groupBy("w").agg(F.collect_list("item").alias("items")).collect()
        known, number = [r.w for r in rows], sorted({x for r in rows for x in r["items"]})
        place = {x: k for k, x in enumerate(number)}
        start = np.cumsum([0, *(len(r["items"]) for r in rows)])
        owner = np.array([place[x] for r in rows for x in r["items"]], np.int64)
        points = np.array([min(120, len(w) + 10) for w in known], np.int64)
        arrow = to_arrow_type(items.schema[item].dataType)
        kind = {"item": items.schema[item].dataType.simpleString(), "doc": docs.schema[doc].dataType.simpleString()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values, names = pa.array(known, pa.string()), pa.array(number, arrow)
            for b in batches:
                ws = b.column("ws")
                flat, ends = ws.flatten(), ws.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(b.num_rows), ends)
                t = pc.index_in(flat, values)
                hit = t.is_valid().to_numpy(zero_copy_only=False)
                t, row = t.drop_null().to_numpy().astype(np.int64), row[hit]
                size = start[t + 1] - start[t]
                at = np.repeat(start[t] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(t) else np.zeros(0, np.int64)
                pair, back = np.unique(np.repeat(row, size) * len(number) + owner[at], return_inverse=True)
                if len(pair):
                    score = np.bincount(back, np.repeat(points[t], size)).astype(np.int64)
                    doc_id = b.column("doc").to_numpy(zero_copy_only=False)[pair // len(number)]
                    order = np.lexsort((doc_id, -score, pair % len(number)))
                    top = order[np.concatenate([[True], np.diff((pair % len(number))[order]) > 0])]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(pair[top] % len(number))), b.column("doc").take(pa.array(pair[top] // len(number))), pa.array(score[top])], names=["item", "doc", "score"])

        s = d.mapInArrow(run, f"item {kind['item']}, doc {kind['doc']}, score bigint")
    else:
        s = i.join(d.select("doc", F.explode("ws").alias("w")), "w").groupBy("item", "doc").agg(F.sum(F.least(F.lit(120), F.length("w") + 10)).alias("score"))
    return s.groupBy("item").agg(F.max(F.struct("score", (-F.col("doc")).alias("d"))).alias("b")).select(F.col("item").alias(item), (-F.col("b.d")).alias(doc), "b.score")


def numbered(df: DataFrame, order: list[str], *partition: str) -> DataFrame:
    """``ordinal`` in each partition, for a positional zip; a hot partition is sorted in blocks of its first order column."""
    return blocked_number(df, list(partition), order)


def zip_sides(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """Full outer join by key and ordinal with ``finding``: MATCH, DIFFER, LOST (only in the first), PHANTOM."""
    j = a.select(*on, F.col(value).alias("golden")).join(b.select(*on, F.col(value).alias("emitted")), on, "full")
    f = F.when(F.col("emitted").isNull(), "LOST").when(F.col("golden").isNull(), "PHANTOM").when(F.col("golden") == F.col("emitted"), "MATCH").otherwise("DIFFER")
    return j.withColumn("finding", f)


def adjudicated(findings: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings with ``known`` by (key, kind), and the stale records that no finding fired."""
    r = records.select("key", "kind", F.lit(True).alias("known"))
    return findings.join(r, ["key", "kind"], "left").withColumn("known", F.coalesce("known", F.lit(False))), records.join(findings, ["key", "kind"], "left_anti")


def unique_match(rows: DataFrame, targets: DataFrame, on: str, target: str) -> DataFrame:
    """Rows with the one target of their key; ``why`` says where there is none or more than one."""
    t = targets.groupBy(on).agg(F.count("*").alias("__n"), F.min(target).alias(target))
    why = F.when(F.col("__n").isNull(), "no page has that folio").when(F.col("__n") > 1, "folio is not unique")
    return rows.join(t, on, "left").withColumn("why", why).withColumn(target, F.when(F.col("why").isNull(), F.col(target))).drop("__n")


def ledger(df: DataFrame, group: str, state: str) -> DataFrame:
    """Buckets of each group and, with a null group, of all."""
    return df.groupingSets([[F.col(group), F.col(state)], [F.col(state)]], F.col(group), F.col(state)).agg(F.count("*").alias("n"))


def identity_failures(buckets: DataFrame, manifest: DataFrame, group: str) -> DataFrame:
    """Groups, and as null the corpus, whose buckets don't sum to the manifest (``source``)."""
    got = buckets.groupBy(group).agg(F.sum("n").alias("got"))
    want = manifest.groupingSets([[F.col(group)], []], F.col(group)).agg(F.sum("source").alias("source"))
    j = want.join(got.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g")), "left").drop("__g")
    return j.withColumn("got", F.coalesce("got", F.lit(0))).where("got <> source")


def missing_extra(df: DataFrame, group: str, token: str, wanted: Column, got: Column) -> DataFrame:
    """``missing`` and ``extra`` of each group: the distinct tokens of rows that are wanted and weren't got, and the reverse."""
    sets = df.groupBy(group).agg(F.collect_set(F.when(wanted, F.col(token))).alias("__w"), F.collect_set(F.when(got, F.col(token))).alias("__g"))
    less = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return sets.select(group, less("__w", "__g").alias("missing"), less("__g", "__w").alias("extra"))


def rate(hit: Column, of: Column | None = None) -> Column:
    """Share of true among ``of`` (all rows if None); 0 where there are none."""
    base = F.count("*") if of is None else F.count_if(of)
    return F.count_if(hit if of is None else hit & of) / F.greatest(base, F.lit(1))


def stratified(df: DataFrame, stratum: str, key: str, total: int, strata: list[str], seed: str) -> DataFrame:
    """``total`` rows in equal parts by stratum (the first ones get what's over), the least by hash of seed and key. A
    sample must not depend on the partitioning, so no random numbers."""
    base, extra = divmod(total, len(strata))
    quota = F.create_map(*[x for i, s in enumerate(strata) for x in (F.lit(s), F.lit(base + (i < extra)))])
    h = F.sha2(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string")), 256)
    d = df.withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy(h, key)))
    # the literal limit first: with it each task passes on no more than so many rows of a stratum
    return d.where(F.col("__r") <= base + (extra > 0)).where(F.col("__r") <= quota[F.col(stratum)]).drop("__r")


def evenly(count: int, most: int) -> list[int]:
    """Indices of a cheap sample: the first eight, the last four, and even steps between."""
    if count <= most:
        return list(range(max(count, 0)))
    head, tail = min(8, count), min(4, count - min(8, count))
    ends = {*range(head), *range(count - tail, count)}
    room = most - len(ends)
    if room <= 0 or count - tail <= head:
        return sorted(ends)[:most]
    step = (count - tail - head) / (room + 1)
    return sorted(ends | {int(head + i * step) for i in range(1, room + 1)})


def page_spec(spec: str) -> list[int]:
    """'1,5-7' as sorted distinct numbers from 0, for a pushed ``isin``. Anything else raises ValueError."""
    out = set()
    for part in map(str.strip, spec.split(",")):
        a, dash, z = part.partition("-")
        first, last = int(a), int(z) if dash else int(a)
        if first < 1 or last < first:
            raise ValueError(f"not a page range: {part!r}")
        out |= set(range(first - 1, last))
    return sorted(out)


def bootstrap(values: list[int], iterations: int, seed: int) -> tuple[float, float]:
    """The 2.5 and 97.5 % order statistics of resampled means."""
    if not values:
        return float("nan"), float("nan")
    if len(set(values)) == 1:
        return float(values[0]), float(values[0])
    rng, n = random.Random(seed), len(values)
    means = sorted(sum(rng.choices(values, k=n)) / n for _ in range(iterations))
    return means[int(0.025 * (iterations - 1))], means[int(0.975 * (iterations - 1))]


def scores(df: DataFrame, iterations: int = 200, seed: int = 7) -> DataFrame:
    """Accuracy and interval of ``correct`` by condition and type, and by condition alone (type 'overall'). What a group
    needs for its interval is its counts of right and wrong, so only these reach Python."""
    g = df.groupingSets([[F.col("condition"), F.col("type")], [F.col("condition")]], F.col("condition"), F.col("type")).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("int")).alias("correct"))
    g = g.withColumn("type", F.coalesce("type", F.lit("overall")))

    @F.pandas_udf("struct<low:double,high:double>")
    def interval(name: pd.Series, n: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = []
        for k, total, good in zip(name, n, right):
            if good in (0, total):
                rows.append((float(good > 0), float(good > 0)))
                continue
            means = np.sort(np.random.default_rng(seed + sum(map(ord, k))).binomial(total, good / total, iterations) / total)
            rows.append((means[int(0.025 * (iterations - 1))], means[int(0.975 * (iterations - 1))]))
        return pd.DataFrame(rows, columns=["low", "high"])

    return g.withColumn("ci", interval(F.concat("condition", "type"), "n", "correct")).select("condition", "type", "n", "correct", (F.col("correct") / F.col("n")).alias("accuracy"), "ci.low", "ci.high")


def paginate(df: DataFrame, doc: str, order: str, cost: str, budget: int) -> DataFrame:
    """``page``: a new one where the running cost would pass the budget; a row over the budget has a page of its own. A
    sum with a reset is no window, so one pass over each document's ordered costs."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (doc, order)}

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        page = used = 0
        pages = []
        for c in t.column(cost).to_pylist():
            if used and used + (c or 0) > budget:
                page, used = page + 1, 0
            used += c or 0
            pages.append(page)
        return t.select([doc, order]).append_column("page", pa.array(pages, pa.int32()))

    return df.select(doc, order, cost).groupBy(doc).applyInArrow(run, f"`{doc}` {kinds[doc]}, `{order}` {kinds[order]}, page int")


def probe(blocks: DataFrame, most: int = 24, doc: str = "doc_id") -> DataFrame:
    """What a sample of each document's pages suggests: ``pages`` (those that look like an edition, counted from 1, with small
    gaps filled), ``text_lang`` and the ``command`` that would build them; null where no sampled page has both a body and
    an apparatus or notes. The sample is that of ``evenly``; a gap is filled up to twice the sample's largest step, and
    eight at least. Pages between two hits aren't read: the fill is a suggestion."""
    pages = blocks.groupBy(doc, "page_index").agg(
        F.bool_or(F.col("layer").isin("text", "translation")).alias("body"), F.bool_or(F.col("layer").isin("apparatus", "notes")).alias("notes"),
        F.bool_or((F.col("layer") == "text") & X.is_greek(F.col("text"))).alias("greek"), F.bool_or((F.col("layer") == "translation") | (F.col("layer") == "text") & ~X.is_greek(F.col("text"))).alias("latin"),
    )
    count = pages.groupBy(doc).agg((F.max("page_index") + 1).cast("bigint").alias("n"))
    sample = F.udf(lambda n: evenly(n, most), "array<int>", useArrow=True)
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size("s") - 1, F.lit(1))), lambda i: F.coalesce(F.get("s", i) - F.get("s", i - 1), F.lit(0)))
    count = count.withColumn("s", sample("n")).withColumn("gap", F.greatest(F.lit(8), 2 * F.array_max(steps)))
    seen = pages.join(count, doc).where(F.array_contains("s", F.col("page_index").cast("int")))
    lang = seen.groupBy(doc).agg(F.when(F.count_if(F.col("latin") & ~F.col("greek")) > F.count_if("greek"), "la").otherwise("grc").alias("text_lang"))
    hits = seen.where("body and notes").select(doc, "page_index", "gap")
    after = F.lead("page_index").over(Window.partitionBy(doc).orderBy("page_index"))
    end = F.when(F.col("after") - F.col("page_index") <= F.col("gap"), F.col("after") - 1).otherwise(F.col("page_index"))
    filled = hits.withColumn("after", after).select(doc, F.explode(F.sequence("page_index", end)).alias("page_index"))
    spec = range_text(ranges(filled.select(doc, (F.col("page_index") + 1).alias("page_index")), doc, "page_index"), doc)
    command = F.concat(F.lit("variorum build "), F.col(doc).cast("string"), F.lit(" --pages "), F.col("pages"), F.lit(" --text-lang "), F.col("text_lang"))
    return lang.join(spec, doc, "left").select(doc, "pages", "text_lang", command.alias("command"))


def questions(sides: DataFrame, *keys: str) -> DataFrame:
    """(type, question subject, gold) candidates from readings (``text``, ``side``, ``attribution``): which witnesses
    read what, what a witness reads (only where that is one reading), lemma or variant, editors, and the count."""
    shown = F.when(F.trim("text") == "", "om.").otherwise(F.col("text"))
    s = sides.withColumn("shown", shown).withColumn("norm", F.lower(X.normalise(shown)))
    by = s.groupBy(*keys, "norm").agg(F.min_by("shown", "side").alias("shown"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("attribution.witnesses")))).alias("wits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("attribution.editors")))).alias("eds"), F.min("side").alias("first"), F.count_if(F.col("side") > 0).alias("later"))
    d = by.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "norm", "shown", "wits", "eds", "later"))).alias("b"))
    row = lambda t, subject, gold: F.struct(F.lit(t).alias("type"), subject.alias("subject"), gold.alias("gold"))
    reads = lambda w: F.filter("b", lambda x: F.array_contains(x["wits"], w))
    later = F.aggregate("b", F.lit(0).cast("bigint"), lambda n, x: n + x["later"])
    out = F.concat(
        F.transform(F.filter("b", lambda x: F.size(x["wits"]) > 0), lambda x: row("witness_of_reading", x["shown"], F.array_join(x["wits"], ","))),
        F.transform(F.filter(F.array_distinct(F.flatten(F.transform("b", lambda x: x["wits"]))), lambda w: F.size(reads(w)) == 1), lambda w: row("reading_of_witness", w, F.element_at(reads(w), 1)["shown"])),
        F.transform("b", lambda x: row("lemma_vs_variant", x["shown"], F.when(x["first"] == 0, "constituted text").otherwise("rejected variant"))),
        F.transform(F.filter("b", lambda x: F.size(x["eds"]) > 0), lambda x: row("editor_attribution", x["shown"], F.array_join(x["eds"], ","))),
        F.array(row("count", F.element_at("b", 1)["shown"], later.cast("string"))),
    )
    return d.select(*keys, F.explode(out).alias("c")).select(*keys, "c.*")


def same_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """Verdict per path of two builds (``path``, ``content``), compared by digest."""
    x, y = (d.select("path", F.sha2("content", 256).alias(n)) for d, n in ((a, "one"), (b, "two")))
    v = F.when(F.col("one").isNull(), "only in build 2").when(F.col("two").isNull(), "only in build 1").when(F.col("one") == F.col("two"), "match").otherwise("differ")
    return x.join(y, "path", "full").select("path", v.alias("verdict"))
