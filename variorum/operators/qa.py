"""Questions about apparatus entries: sets, contexts, prompts, scores; and how sources are matched with pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.functions import text as X
from variorum.kernels import reading
from variorum.operators import evidence as E

CONDITIONS = {"flat": "FLAT PRINTED-PAGE TRANSCRIPTION", "structured-tei": "STRUCTURED TEI APPARATUS", "structured-md": "STRUCTURED MD-CE PAGE SECTION"}
INSTRUCTION = "Answer from the context alone. Give the answer only; give several as a list with commas."


def load(spark: SparkSession, path: str) -> DataFrame:
    """Items from JSON arrays: ``question``, ``gold_answer`` (always an array), ``app_ref``, ``type``."""
    d = spark.read.schema("question string, gold_answer string, app_ref string, type string").json(path, multiLine=True)
    many = F.from_json("gold_answer", "array<string>")
    return d.withColumn("gold_answer", F.when(F.col("gold_answer").startswith("["), many).otherwise(F.array("gold_answer")))


def write(items: DataFrame, path: str) -> None:
    """A folder of JSON lines; what is there already isn't overwritten."""
    items.select("question", "gold_answer", "app_ref", "type").write.mode("errorifexists").json(path)


def invalid(items: DataFrame, types: list[str], size: int) -> DataFrame:
    """``app_ref``, ``fault`` of items that can't be asked, and of a set (``app_ref`` null) that isn't of its size or not
    evenly of its types: the first ``size % len(types)`` types have one more."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    gold = F.col("gold_answer")
    none = F.coalesce((F.size(gold) < 1) | F.exists(gold, lambda g: g.isNull() | (g == "")), F.lit(True))
    fault = F.when(blank(F.col("question")) | blank(F.col("app_ref")) | blank(F.col("type")), "an empty field").when(~F.col("type").isin(types), "a type that this edition hasn't").when(none, "no gold answer")
    base, extra = divmod(size, len(types))
    want = items.sparkSession.createDataFrame([(t, base + (i < extra)) for i, t in enumerate(types)], "type string, wanted int")
    counts = items.groupBy("type").agg(F.count("*").alias("n")).join(want, "type", "full").where(~F.col("n").eqNullSafe(F.col("wanted").cast("bigint")) & ~(F.col("n").isNull() & (F.col("wanted") == 0)))
    uneven = counts.select(F.lit(None).cast("string").alias("app_ref"), F.format_string("%d items of type %s, not %d", F.coalesce("n", F.lit(0)), "type", F.coalesce("wanted", F.lit(0))).alias("fault"))
    return items.select("app_ref", fault.alias("fault")).where("fault is not null").unionByName(uneven)


def scored(answers: DataFrame) -> DataFrame:
    """``correct`` of rows of ``response``, ``gold`` (array) and ``is_set``: as sets, or word for word."""
    d = answers.withColumn("__set", X.answer_set("response")).withColumn("__one", X.normalise_answer("response")).withColumn("__gold", X.gold_set("gold")).withColumn("__text", X.normalise_answer(F.element_at("gold", 1)))
    return d.withColumn("correct", F.when(F.col("is_set"), F.col("__set") == F.col("__gold")).otherwise(F.col("__one") == F.col("__text"))).drop("__set", "__one", "__gold", "__text")


def apparatus_line(sides: Column) -> Column:
    """An entry in one line, from its sides (``text``, ``witnesses``, ``editors``): lemma ] reading; reading."""
    one = lambda s: F.array_join(F.concat(F.array(F.when(s["text"] == "", "om.").otherwise(s["text"])), s["witnesses"], s["editors"]), " ")
    rest = F.transform(F.slice(sides, 2, F.greatest(F.size(sides) - 1, F.lit(0))), one)
    return F.concat(one(F.element_at(sides, 1)), F.when(F.size(rest) > 0, F.concat(F.lit(" ] "), F.array_join(rest, "; "))).otherwise(""))


def marked(context: Column, lemma: Column) -> Column:
    """The context with the entry's marker behind the first place of the lemma, or at the end where it doesn't stand there."""
    end = F.instr(context, lemma) + F.length(lemma) - 1
    return F.when(F.instr(context, lemma) > 0, F.concat(F.substring(context, F.lit(1), end), F.lit("⟦eval:1⟧"), F.substring(context, end + 1, F.length(context)))).otherwise(F.concat(context, F.lit(" ⟦eval:1⟧")))


def prompt(condition: Column, context: Column, question: Column, app_ref: Column) -> Column:
    """A prompt; one without a context, or of another condition, fails the job."""
    labels = F.create_map(*[F.lit(x) for kv in CONDITIONS.items() for x in kv])
    label = F.coalesce(labels[condition], F.raise_error(F.concat(F.lit("unknown condition: "), condition)))
    said = F.when(F.trim(context) != "", context).otherwise(F.raise_error(F.concat(app_ref, F.lit(": empty context"))))
    return F.concat(F.lit(INSTRUCTION + "\n\nCondition: "), label, F.lit("\nApp reference: "), app_ref, F.lit("\n\nCONTEXT\n"), said, F.lit("\n\nQUESTION\n"), question, F.lit("\n\nANSWER\n"))


def segments(pieces: DataFrame, doc: str, order: str, text: str = "text") -> DataFrame:
    """``doc``, ``n``, ``sentence``: the sentences of each document's pieces put together in order."""
    whole = pieces.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda p: p[text]), "").alias("__t"))
    cut = F.filter(F.transform(F.split("__t", "(?<=[!.;?·])(?=\\s)"), X.normalise), lambda s: s != "")
    return whole.select(doc, F.posexplode(cut).alias("n", "sentence"))


def aligned(bands: DataFrame, entries: DataFrame, doc: str, reach: int = 8000) -> DataFrame:
    """``doc``, ``n``, ``at``: where each entry (``n``, ``lemma``, ``reading``) begins in its document's ``band``, in order."""
    e = entries.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("n", "lemma", "reading"))).alias("es"))
    kind = bands.schema[doc].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for d, band, es in zip(*(b.column(i).to_pylist() for i in range(3))):
                found = reading.aligned(band or "", [reading.keys(x["lemma"], x["reading"]) for x in es], reach)
                rows += [(d, x["n"], at) for x, at in zip(es, found)]
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=[doc, "n", "at"])

    return bands.select(doc, "band").join(e.select(doc, F.transform("es", lambda x: F.struct(x["n"].cast("bigint").alias("n"), x["lemma"].alias("lemma"), x["reading"].alias("reading"))).alias("es")), doc).mapInArrow(run, f"`{doc}` {kind}, n bigint, at bigint")


def located(apps: DataFrame, pages: DataFrame, app: str, page: str, profile: str = "real") -> DataFrame:
    """``app``, ``page``, ``why``: the one page whose folded text holds the entry's whole folded lemma. An entry found on no
    page or on several has no page: choosing a convenient one would prove nothing."""
    fold = X.fold_with(profile)
    a = apps.select(app, fold("lemma").alias("text")).where("text <> ''")
    hits = E.phrases(pages.select(page, fold("text").alias("text")), a, page, app)
    n = hits.groupBy(app).agg(F.count("*").alias("n"), F.min(page).alias(page))
    why = F.when(F.col("n").isNull(), "lemma absent from selected page text").when(F.col("n") > 1, "lemma occurs on multiple selected pages")
    return apps.select(app).join(n, app, "left").select(app, F.when(F.col("n") == 1, F.col(page)).alias(page), why.alias("why"))


def unproven(limits: DataFrame) -> DataFrame:
    """Limits (``name``, ``examined``, ``source_apps``) that were examined on too little to prove anything."""
    return limits.withColumn("floor", E.floor_of(F.col("source_apps"))).where("examined < floor")


def length_histogram(readings: DataFrame, text: str = "text") -> DataFrame:
    """Readings by their number of words."""
    words = F.size(F.filter(F.split(X.normalise(F.col(text)), " "), lambda w: w != ""))
    return readings.groupBy(words.alias("words")).agg(F.count("*").alias("n"))


def text_lines(text: Column, per_line: int = 10) -> Column:
    """Printed lines of a sentence."""
    return F.greatest(F.lit(1), F.ceil(F.size(F.split(X.normalise(text), " ")) / per_line)).cast("int")


def band_lines(entry: Column, chars: int = 58) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(entry) / chars)).cast("int")


def chunks(text: Column, words: int) -> Column:
    """A text that no page holds, cut at word borders into parts of so many words."""
    ws = F.split(X.normalise(text), " ")
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(ws) / words).cast("int") - 1), lambda i: F.array_join(F.slice(ws, i * words + 1, words), " "))


def uncovered(coverage: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that a coverage report doesn't describe, and reported pages that the document hasn't: a report with a row here
    couldn't be recomputed from the document."""
    key = ["doc_id", "page_index"]
    of = lambda d, side: d.select(*key, F.lit(side).alias("side"))
    both = of(coverage.where("page_index is not null"), "report").unionByName(of(pages, "document"))  # each is read once
    sides = both.groupBy(*key).agg(F.min("side").alias("only_in"), F.max("side").alias("__other"))
    return sides.where(F.col("only_in") == F.col("__other")).drop("__other")
