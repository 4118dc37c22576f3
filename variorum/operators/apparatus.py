"""Pages to entries, and what is counted over entries.

``pages`` has one row per page: its keys and ``blocks``, an array of structs that have ``layer`` and ``text``. Anchoring
moves a cursor along a page, so the page is the unit: one ``mapInArrow`` pass without a shuffle parses each band once
and gives all of a page's entries; pages of a shape that was parsed before are filled in by it. Everything after it is relational.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from variorum.functions import text as X
from variorum.kernels.attribution import KINDS
from variorum.kernels.page import page_entries
from variorum.kernels.registry import Registry
from variorum.kernels.shapes import Shapes, entry_shapes

ATTRIBUTION = "struct<" + ",".join(f"{k}:array<string>" for k in KINDS) + ">"
PARSED = f"struct<lemma:string,lemma_attribution:{ATTRIBUTION},readings:array<struct<text:string,attribution:{ATTRIBUTION}>>,comments:array<string>>"
ANCHOR = "struct<kind:string,value:string,block_index:int,char_offset:int,digit_start:int,digit_end:int>"
ENTRY = f"block int, k int, grammar string, raw string, source_slice string, anchor {ANCHOR}, parsed {PARSED}, resolved_lemma string, refusal_evidence string, ambiguous boolean, lemma_start int"
HUMAN = "human review forced the entry verbatim"

_attr = pa.struct([(k, pa.list_(pa.string())) for k in KINDS])
_parsed = pa.struct([("lemma", pa.string()), ("lemma_attribution", _attr), ("readings", pa.list_(pa.struct([("text", pa.string()), ("attribution", _attr)]))), ("comments", pa.list_(pa.string()))])
_anchor = pa.struct([("kind", pa.string()), ("value", pa.string()), *((n, pa.int32()) for n in ("block_index", "char_offset", "digit_start", "digit_end"))])
_ENTRY = [("block", pa.int32()), ("k", pa.int32()), ("grammar", pa.string()), ("raw", pa.string()), ("source_slice", pa.string()), ("anchor", _anchor), ("parsed", _parsed), ("resolved_lemma", pa.string()), ("refusal_evidence", pa.string()), ("ambiguous", pa.bool_()), ("lemma_start", pa.int32())]


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is too small to fill a split for each: Python stages must not run in the one task of a
    small file. What is moved is bounded by cores times split size; larger inputs have tasks enough and aren't moved."""
    spark = df.sparkSession
    n = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(n) if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < n * split else df


def pages_of(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_index")) -> DataFrame:
    """One row per page from one row per block (``block``, ``layer``, ``text``), blocks in order. One shuffle, by page."""
    struct = F.struct("block", "layer", "text")
    return blocks.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(struct)), lambda b: F.struct(b["layer"].alias("layer"), b["text"].alias("text"))).alias("blocks"))


def texts_of(blocks: pa.Array) -> Iterator[tuple[int, tuple[str, ...], list[str]]]:
    """Number, layers and texts of each page."""
    flat, at = blocks.flatten(), 0
    layers, texts = flat.field(0).to_pylist(), flat.field(1).to_pylist()
    for i, n in enumerate(pc.list_value_length(blocks).to_pylist()):
        z = at + (n or 0)
        yield i, tuple(layers[at:z]), texts[at:z]
        at = z


class _Shaped:
    """Entries of a batch's pages that are filled in by their shape, as columns: what all pages of a shape share is taken from
    one row of its template."""

    def __init__(self, shapes: Shapes) -> None:
        self.shapes, self.pages, self.rows, self.places = shapes, [], [], []
        self.said: list[list[str]] = [[] for _ in range(5)]

    def add(self, page: int, layers: tuple[str, ...], texts: list[str]) -> bool:
        """Whether the page's shape is known."""
        found = None if None in texts else self.shapes.template(layers, texts)
        if found is None:
            return False
        t, words = found
        n = len(t.value)
        if t.extra is None:
            kept = self.shapes.table
            t.extra = range(kept.num_rows, kept.num_rows + n) if kept else range(n)
            own = pa.Table.from_pylist(t.value, schema=pa.schema(_ENTRY))
            self.shapes.table = pa.concat_tables([kept, own]).combine_chunks() if kept else own
        if n:
            self.pages += [page] * n
            self.rows += t.extra
            said = t.texts(words)
            for k in range(4):
                self.said[k] += said[k * n : k * n + n]
            self.said[4] += said[4 * n :]
            self.places += t.offsets(words)
        return True

    def batch(self, b: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        own = self.shapes.table.take(pa.array(self.rows, pa.int32())).combine_chunks().to_batches()[0]
        raw, source, lemma, resolved, reading = (pa.array(x, pa.string()) for x in self.said)
        at = [pa.array(self.places[k::4], pa.int32()) for k in range(4)]
        anchor, parsed = own.column("anchor"), own.column("parsed")
        anchor = pa.StructArray.from_arrays([*(anchor.field(k) for k in range(3)), *at[:3]], fields=list(_anchor), mask=anchor.is_null())
        readings = parsed.field(2)
        sides = pa.StructArray.from_arrays([reading, readings.values.field(1)], fields=list(_parsed.field(2).type.value_type))
        readings = pa.ListArray.from_arrays(readings.offsets, sides, type=_parsed.field(2).type)
        parsed = pa.StructArray.from_arrays([lemma, parsed.field(1), readings, parsed.field(3)], fields=list(_parsed), mask=parsed.is_null())
        new = {"raw": raw, "source_slice": source, "anchor": anchor, "parsed": parsed, "resolved_lemma": resolved, "lemma_start": at[3]}
        pages, n = pa.array(self.pages, pa.int32()), len(schema) - len(_ENTRY)
        return pa.RecordBatch.from_arrays([*(b.column(i).take(pages) for i in range(n)), *(new.get(name, own.column(name)) for name, _ in _ENTRY)], schema=schema)


def entries(pages: DataFrame, registry: Registry | None = None, keys: tuple[str, ...] = ("doc_id", "page_index")) -> DataFrame:
    """One row per entry: the keys, and the columns of ``ENTRY``. Where pages carry ``witnesses`` and ``editors`` (maps),
    each page is read with its own registry; else all with ``registry``. A null text has no entries."""
    own = {"editors", "witnesses"} <= set(pages.columns)
    body = pages.select(*keys, F.transform("blocks", lambda b: F.struct(b["layer"].alias("layer"), b["text"].alias("text"))).alias("blocks"), *(["witnesses", "editors"] if own else []))
    fields = ", ".join([*(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys), ENTRY])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = entry_shapes(None if own else registry)
        for b in batches:
            schema = pa.schema([*(b.schema.field(i) for i in range(len(keys))), *_ENTRY])
            shaped = _Shaped(shapes)
            rest = range(b.num_rows) if own else [i for i, layers, texts in texts_of(b.column(len(keys))) if not shaped.add(i, layers, texts)]
            rows = []
            for page in (b.take(pa.array(rest, pa.int32())) if len(rest) < b.num_rows else b).to_pylist() if len(rest) else ():
                reg = Registry(dict(page["witnesses"] or ()), dict(page["editors"] or ())) if own else registry
                head = {k: page[k] for k in keys}
                rows += [head | e for e in page_entries(page["blocks"] or [], reg)]
            if shaped.pages:
                yield shaped.batch(b, schema)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return body.mapInArrow(run, fields)


def is_anchored() -> Column:
    return F.col("anchor.char_offset").isNotNull()


def flags(df: DataFrame) -> DataFrame:
    """``structure`` (parsed, refused or unparsed), ``attachment`` (attached, end_only or unanchored) and ``reason``."""
    reviewed = F.col("override_action") if "override_action" in df.columns else F.lit(None).cast("string")
    reason = F.when(F.coalesce(reviewed == "verbatim", F.lit(False)), F.lit(HUMAN)).when(F.col("parsed").isNull() & (F.col("refusal_evidence") != ""), X.refusal_key(F.col("refusal_evidence")))
    structure = F.when(F.col("parsed").isNotNull(), "parsed").when(F.col("reason").isNotNull(), "refused").otherwise("unparsed")
    attachment = F.when(~F.coalesce(is_anchored(), F.lit(False)), "unanchored").when(F.col("lemma_start").isNotNull(), "attached").otherwise("end_only")
    return df.withColumn("reason", reason).withColumn("structure", structure).withColumn("attachment", attachment)


def coverage(df: DataFrame, doc: str = "doc_id", page: str = "page_index") -> DataFrame:
    """Counts per page and, with a null page, per document: both levels in one aggregation."""
    f = flags(df)
    n = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    return f.groupingSets([[F.col(doc), F.col(page)], [F.col(doc)]], F.col(doc), F.col(page)).agg(F.count("*").alias("entries"), *(n("structure", v) for v in ("parsed", "refused", "unparsed")), *(n("attachment", v) for v in ("attached", "end_only", "unanchored")))


def report(c: DataFrame) -> DataFrame:
    """The one sentence of a coverage row, in ``report``."""
    say = F.format_string("%d entries — %d parsed, %d refused, %d unparsed; %d anchored (%d attached, %d end-only), %d unanchored", "entries", "parsed", "refused", "unparsed", F.col("attached") + F.col("end_only"), "attached", "end_only", "unanchored")
    return c.withColumn("report", say)


def refusal_tally(df: DataFrame, *keys: str) -> DataFrame:
    return flags(df).where("structure = 'refused'").groupBy(*keys, "reason").agg(F.count("*").alias("n"))


def tally_line(tally: DataFrame, *keys: str) -> DataFrame:
    """``refusals``: the tally as one string, most frequent first, equals by reason."""
    items = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "reason")))
    return tally.groupBy(*keys).agg(F.array_join(F.transform(items, lambda i: F.concat((-i["m"]).cast("string"), F.lit("× "), i["reason"])), "; ").alias("refusals"))


def readings(df: DataFrame, *keys: str) -> DataFrame:
    """One row per side of each parsed entry: ``side`` 0 is the lemma."""
    lemma = F.struct(F.col("parsed.lemma").alias("text"), F.col("parsed.lemma_attribution").alias("attribution"))
    return df.where("parsed is not null").select(*keys, "k", F.posexplode(F.concat(F.array(lemma), F.col("parsed.readings"))).alias("side", "r")).select(*keys, "k", "side", "r.text", "r.attribution")


def used(df: DataFrame, kind: str, *keys: str) -> DataFrame:
    """Distinct tokens of one kind of attribution (``token``)."""
    return readings(df, *keys).select(*keys, F.explode(f"attribution.{kind}").alias("token")).distinct()


def support(df: DataFrame) -> DataFrame:
    """Readings (lemmata not counted) that each witness supports."""
    return readings(df).where("side > 0").select(F.explode("attribution.witnesses").alias("witness")).groupBy("witness").agg(F.count("*").alias("n"))


def witness_table(sigla: DataFrame, declared: DataFrame, *keys: str) -> DataFrame:
    """Used ``siglum`` rows with base, hand and description, from ``declared`` (``token``, ``description``). A hand state
    is taken apart only where its base is declared; an undeclared siglum stays, with an empty description."""
    own = declared.select(*keys, F.col("token").alias("siglum"), F.col("description").alias("own"))
    base = declared.select(*keys, F.col("token").alias("maybe"), F.col("description").alias("of_base"))
    h = X.hand(F.col("siglum"))
    d = sigla.select(*keys, "siglum").distinct().withColumn("maybe", F.when(h != "", F.substring("siglum", 1, 1)))
    d = d.join(own, [*keys, "siglum"], "left").join(base, [*keys, "maybe"], "left")
    found = F.col("of_base").isNotNull()
    return d.select(*keys, "siglum", F.when(found, F.col("maybe")).otherwise(F.col("siglum")).alias("base"), F.when(found, h).otherwise("").alias("hand"), F.when(found, X.hand_label(h)).otherwise("").alias("hand_label"), F.coalesce("own", "of_base", F.lit("")).alias("description"))


def anchor_counters(df: DataFrame, *keys: str) -> DataFrame:
    on = F.coalesce(is_anchored(), F.lit(False))
    return df.groupBy(*keys).agg(F.count("*").alias("entries"), F.count_if(on).alias("anchored"), F.count_if(~on).alias("unanchored"), F.count_if("ambiguous").alias("ambiguous"))


def duplicate_markers(pages: DataFrame, *keys: str) -> DataFrame:
    """``duplicate_markers``: numbers that stand in several places of a page, summed over the pages of each key."""
    texts = F.transform(F.filter("blocks", lambda b: b["layer"].isin("text", "heading")), lambda b: b["text"])
    return pages.select(*keys, X.repeated_markers(texts).alias("__n")).groupBy(*keys).agg(F.sum("__n").cast("bigint").alias("duplicate_markers"))


def layer_census(blocks: DataFrame, *keys: str) -> DataFrame:
    """Blocks, distinct pages and characters of each layer."""
    return blocks.groupBy(*keys, "layer").agg(F.count("*").alias("blocks"), F.countDistinct("doc_id", "page_index").alias("pages"), F.sum(F.length("text")).alias("chars"))


def degeneracies(blocks: DataFrame, df: DataFrame) -> DataFrame:
    """Documents without a text, and those with apparatus bands of which no entry came."""
    b = blocks.groupBy("doc_id").agg(F.bool_or(F.col("layer").isin("text", "heading")).alias("has_text"), F.bool_or(F.col("layer") == "apparatus").alias("has_bands"))
    n = df.groupBy("doc_id").agg(F.count("*").alias("n"))
    j = b.join(n, "doc_id", "left")
    why = F.when(~F.col("has_text"), "no constituted text").when(F.col("has_bands") & F.col("n").isNull(), "apparatus bands without an entry")
    return j.select("doc_id", why.alias("degeneracy")).where("degeneracy is not null")


def entry_keys(df: DataFrame) -> DataFrame:
    """``entry_key`` (page and page-wide ordinal) and ``source_sha``, the digest that binds a review to its entry."""
    return df.withColumn("entry_key", F.concat(F.lit("p"), F.col("page_index"), F.lit("-e"), F.col("k"))).withColumn("source_sha", X.source_digest(F.col("source_slice")))


def drifted(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides whose entry is there with another digest: nothing may be replayed while a row is left."""
    o = overrides.select("doc_id", "entry_key", F.col("source_sha").alias("wanted"))
    return entry_keys(df).join(o, ["doc_id", "entry_key"]).where(~F.col("source_sha").eqNullSafe(F.col("wanted"))).select("doc_id", "entry_key", "wanted", F.col("source_sha").alias("found"), X.source_excerpt(F.col("source_slice")).alias("now"))


def unmatched(df: DataFrame, overrides: DataFrame) -> DataFrame:
    return overrides.join(entry_keys(df), ["doc_id", "entry_key"], "left_anti").select("doc_id", "entry_key")


def apply_overrides(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """Entries with reviews replayed: ``action`` 'verbatim' takes the parse away, 'parse' puts the reviewer's ``reviewed``
    in its place. All or nothing: a single drifted digest fails the job in the same pass that replays."""
    o = overrides.select("doc_id", "entry_key", F.col("action").alias("override_action"), F.col("source_sha").alias("wanted"), F.col("reviewed").cast(PARSED).alias("reviewed"))
    j = entry_keys(df).join(o, ["doc_id", "entry_key"], "left")
    bad = F.col("override_action").isNotNull() & ~F.col("wanted").eqNullSafe(F.col("source_sha"))
    action = F.when(bad, F.raise_error(F.concat(F.lit("override no longer matches its entry: "), F.col("entry_key")))).otherwise(F.col("override_action"))
    parsed = F.when(action == "verbatim", F.lit(None).cast(PARSED)).when(action == "parse", F.col("reviewed")).otherwise(F.col("parsed"))
    return j.withColumn("parsed", parsed).withColumn("override_action", action).drop("wanted", "reviewed")


def rank_first(df: DataFrame, by: list[Column], *keys: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("__r = 1").drop("__r")
