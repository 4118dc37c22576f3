"""Documents out: md-ce and TEI. Pages become fragments where they are, in the pass that reads their bands; a document
is then one aggregation of its fragments in page order. Validation and the round trip read the results back."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variorum.functions import rows
from variorum.kernels import emit, mdce
from variorum.kernels.page import page_entries
from variorum.kernels.registry import Registry
from variorum.kernels.shapes import FOLIO, INDEX, fragment_shapes
from variorum.operators.apparatus import texts_of

COUNTS = ("entries", "parsed", "refused", "unparsed", "attached", "end_only", "unanchored")
TOOL = "variorum 0.1"
_FRAGMENT = pa.schema([("page_index", pa.int32()), ("md", pa.string()), ("tei", pa.string()), ("translation", pa.string()), *((c, pa.int32()) for c in COUNTS), ("reasons", pa.list_(pa.string())), ("editors", pa.list_(pa.string())), ("editions", pa.list_(pa.string())), ("generative", pa.int32()), ("escaped", pa.int32())])


def fragment(index: int | str, folio: str | None, blocks: list[dict[str, Any]], registry: Registry | None) -> tuple[dict[str, Any], list[dict[str, Any]]]:
    """One page's row, without its document and index, and its entries."""
    es = page_entries(blocks, registry)
    md, escaped = emit.markdown(index, folio, blocks, es)
    tei, translation = emit.tei(index, folio, blocks, es)
    sides = [a for e in es if e["parsed"] for a in (e["parsed"]["lemma_attribution"], *(x["attribution"] for x in e["parsed"]["readings"]))]
    verse = [a for e in es if e["parsed"] and e["grammar"] == "verse" for a in (e["parsed"]["lemma_attribution"], *(x["attribution"] for x in e["parsed"]["readings"]))]
    row = {"md": md, "tei": tei, "translation": translation, **emit.counts(es), "reasons": [emit.reason_of(e) for e in es if not e["parsed"] and e["refusal_evidence"]], "editors": sorted({x for a in sides for x in a["editors"]}), "editions": sorted({x for a in verse for x in a["witnesses"]}), "generative": sum(bool(x.get("generative")) and x["layer"] not in emit.FURNITURE for x in blocks), "escaped": escaped}
    return row, es


def fragments(pages: DataFrame, registry: Registry | None) -> DataFrame:
    """One row per page (``doc_id``, ``page_index``, ``blocks``; ``printed_page`` if there is one). A text with marker
    brackets stops the job with AmbiguousDelimiter."""
    p = pages if "printed_page" in pages.columns else pages.withColumn("printed_page", F.lit(None).cast("string"))
    kind = pages.schema["doc_id"].dataType.simpleString()

    alone = {f.name for f in p.schema["blocks"].dataType.elementType.fields} == {"layer", "text"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = fragment_shapes(registry, fragment)
        for b in batches:
            rest, made = range(b.num_rows), []
            if alone:
                index, folio = b.column(1).to_pylist(), b.column(2).to_pylist()
                rest = []
                for i, layers, texts in texts_of(b.column(3)):
                    f = folio[i]
                    plain = None not in texts and (f is None or f.isascii() and f.isalnum())
                    found = shapes.template((*layers, f is not None), texts) if plain else None
                    if found is None:
                        rest.append(i)
                        continue
                    said = "\0".join(found[0].texts(found[1])).replace(INDEX, str(index[i]))
                    md, tei, translation = (said if f is None else said.replace(FOLIO, f)).split("\0")
                    made.append((i, found[0].value[0] | {"md": md, "tei": tei, "translation": translation}))
            for i, r in zip(rest, (b.take(pa.array(rest, pa.int32())) if len(rest) < b.num_rows else b).to_pylist() if len(rest) else ()):
                made.append((i, fragment(r["page_index"], r["printed_page"], [x | {"text": x["text"] or ""} for x in r["blocks"] or []], registry)[0]))
            if made:
                at = pa.array([i for i, _ in made], pa.int32())
                said = [pa.array([r[f.name] for _, r in made], f.type) for f in _FRAGMENT if f.name != "page_index"]
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *said], schema=pa.schema([b.schema.field("doc_id"), *_FRAGMENT]))

    fields = f"doc_id {kind}, page_index int, md string, tei string, translation string, " + ", ".join(f"{c} int" for c in COUNTS) + ", reasons array<string>, editors array<string>, editions array<string>, generative int, escaped int"
    blocks = F.transform("blocks", lambda b: F.struct(b["layer"].alias("layer"), b["text"].alias("text"))) if alone else F.col("blocks")
    return p.select("doc_id", "page_index", "printed_page", blocks.alias("blocks")).mapInArrow(run, fields)


def documents(pages: DataFrame, registry: Registry | None = None, ingest: str = "layered") -> DataFrame:
    """``doc_id``, ``md``, ``tei``: each document's two files."""
    parts = F.array_sort(F.collect_list(F.struct("page_index", "md", "tei", "translation")))
    d = fragments(pages, registry).groupBy("doc_id").agg(parts.alias("p"), *(F.sum(c).alias(c) for c in (*COUNTS, "generative", "escaped")), F.flatten(F.collect_list("reasons")).alias("reasons"), *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("editors", "editions")))
    tally = F.transform(F.array_distinct("reasons"), lambda r: F.struct((-F.size(F.filter("reasons", lambda x: x == r))).alias("m"), r.alias("r")))
    line = F.array_join(F.transform(F.array_sort(tally), lambda t: F.concat((-t["m"]).cast("string"), F.lit("× "), t["r"])), "; ")
    say = F.format_string("%d entries — %d parsed, %d refused, %d unparsed; %d anchored (%d attached, %d end-only), %d unanchored", "entries", "parsed", "refused", "unparsed", F.col("attached") + F.col("end_only"), "attached", "end_only", "unanchored")
    name, pages_ = F.col("doc_id").cast("string"), F.concat_ws("-", F.element_at("p", 1)["page_index"], F.element_at("p", -1)["page_index"])
    meta = F.concat(F.lit(f"<!-- md-ce/{mdce.VERSION} · {TOOL} · ingest: {ingest} · pages: "), pages_, F.lit(" · coverage: "), say, F.lit(" · refusals: "), F.when(F.size("reasons") == 0, "none").otherwise(line), F.lit(" · generative-blocks: "), F.col("generative"), F.lit(" · escaped-lines: "), F.col("escaped"), F.lit(" · tei: "), name, F.lit(".xml -->"))
    md = F.concat(F.regexp_replace(F.concat(F.lit("# "), name, F.lit("\n\n"), meta, F.lit("\n"), F.array_join(F.transform("p", lambda x: x["md"]), "\n")), "\\s+$", ""), F.lit("\n"))

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import unicodedata

        for b in batches:
            md_ = [unicodedata.normalize("NFC", x) for x in b.column("md").to_pylist()]
            tei_ = [emit.tei_document(str(i), e, t, registry, eds, n > 0, printed) for i, e, t, eds, n, printed in zip(*(b.column(c).to_pylist() for c in ("doc_id", "edition", "translation", "editors", "parsed", "editions")))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(md_, pa.string()), pa.array(tei_, pa.string())], names=["doc_id", "md", "tei"])

    join = lambda c: F.array_join(F.filter(F.transform("p", lambda x: x[c]), lambda x: x != ""), "\n")
    body = d.select("doc_id", md.alias("md"), join("tei").alias("edition"), join("translation").alias("translation"), "editors", "parsed", "editions")
    return body.mapInArrow(wrap, f"doc_id {pages.schema['doc_id'].dataType.simpleString()}, md string, tei string")


def violations(docs: DataFrame, text: str = "md") -> DataFrame:
    """``doc_id``, ``invariant``, ``line``, ``message`` of every violation of an md-ce text; null texts have none."""
    return rows.read(docs, text, mdce.validate, T.StructType([T.StructField("invariant", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("message", T.StringType())]))


def contents(docs: DataFrame, column: str) -> DataFrame:
    """``doc_id``, ``page_index``, ``layer``, ``content``: what the round trip compares, of ``md`` or ``tei``."""
    reader = mdce.rows_of_markdown if column == "md" else mdce.rows_of_tei
    return rows.read(docs, column, reader, T.StructType([T.StructField("page_index", T.IntegerType()), T.StructField("layer", T.StringType()), T.StructField("content", T.StringType())]))
