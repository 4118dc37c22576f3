"""Generated bands: printed apparatus made from words of documents, with an independent SQL form of what went in.

All eligible words of a document, six by six, become pages: the page's index is the group's number, and it has one band
of a convention. What the parser returns must be the words that went in; the generator builds strings and knows nothing
of the grammars. Words left over (five at most) and documents of fewer words have no page; ``bands_left_over`` counts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.kernels.registry import QUALIFIERS, Registry
from variorum.operators.apparatus import spread

#: Words that the grammars give a meaning; they can't stand for text.
TAKEN = sorted({w.strip(".") for q in QUALIFIERS for w in q.split() if w.strip(".").isascii() and w.strip(".").isalpha() and len(w.strip(".")) > 3 and w.islower()} | set("apud ante post cuius quae quam quas quem quibus quod quos lacunam nisi mauis alias alios alii infra supra sequens sequitur relicto sensu compendio compendiis uoce uocibus transposuit inter iterum plus lectiones sine loco init init".split()))
STORY = "difficile|euanid|inscriptio|legitur|littera|prima|primera|uerbum|ndum|transpos|compend|seruat"
FIRST, SECOND = "ABEFG", "HKNPQ"
REGISTRY = Registry({c: f"Codex {c}" for c in FIRST + SECOND}, {"Otto": "Otto", "Marc.": "Marcovich"})
SPLIT = "[ \\n\\t]+"

WORDS_SQL = f"""words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda w: regexp_full_match(w, '[a-z]{{4,}}')
        AND NOT regexp_matches(w, '{STORY}') AND NOT list_contains([{", ".join(f"'{w}'" for w in TAKEN)}], w)) AS w FROM documents),
grouped AS (SELECT doc_id, w, CAST(unnest(range(len(w) // 6)) AS INT) AS page_index FROM words),
six AS (SELECT doc_id, page_index, {", ".join(f"w[page_index * 6 + {i}] AS w{i}" for i in range(1, 7))},
    substr('{FIRST}', CAST((doc_id + page_index) % 5 + 1 AS INT), 1) AS s, substr('{SECOND}', CAST((doc_id + page_index) % 5 + 1 AS INT), 1) AS t FROM grouped)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` and its eligible words ``w``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fine = F.filter(F.split("text", SPLIT), lambda w: w.rlike("^[a-z]{4,}$") & ~w.rlike(STORY) & ~w.isin(TAKEN))
    # a generator, so that the filter isn't copied into each of the columns made of it
    return spread(docs).select("doc_id", F.explode(F.array(fine)).alias("w"))


def six(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``page_index``, ``w1`` .. ``w6`` and two witnesses: a row per group of six words."""
    at = ((F.col("doc_id") + F.col("page_index")) % 5 + 1).cast("int")
    pick = lambda letters: F.substring(F.lit(letters), at, F.lit(1))
    groups = F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / 6).cast("int") - 1), lambda i: F.slice("w", i * 6 + 1, 6))
    d = words(spark, sf_dir).where(F.size("w") >= 6).select("doc_id", F.posexplode(groups).alias("page_index", "w"))
    return d.select("doc_id", "page_index", *[F.element_at("w", i).alias(f"w{i}") for i in range(1, 7)], pick(FIRST).alias("s"), pick(SECOND).alias("t"))


#: Format strings over w1 .. w6, s and t (words and witnesses of a document); {c1} .. are capitalised words.
BANDS = {
    "bude": "5 {w1} {s} : {w2} {t} || 6 {w3} {s}{t} : {w4} Otto || {w5} om. {t}",
    "teubner": "12 {w1}] {w2} {s} : om. {t} 15-16 {w3} {w4}] {w5} {t}",
    "paragraph": "18 {w1}] om. {s} 20 {w2}] {w3} {s} {t} 25 {w4}] {w5} {s} {w6} {t}",
    "line": "5 {w1} {s}{t} | {w2} Otto ∥ 7 {w3} {s} | {w4} {t} ∥ ◊ {w5} {t} | {w6} {s}",
    "verse": "1:18 {w1} WH NA ] {w2} RP ; {w3} TR • {w4} NA ] – RP 19 {w5} WH ] {w6} Treg",
    "marker": "1 {c1} {s} : {w2} {t}  2 {c3} : {w4} Marc.  3 {c5} add. {s}",
}
TEXTS = {
    "bude": "{w1} {w3} {w5}",
    "teubner": "{w1} {w3} {w4}",
    "paragraph": "{w1} {w2} {w4}",
    "line": "{w1} {w3} {w5}",
    "verse": "18 {w1} {w4} 19 {w5} end",
    "marker": "{c1}1 and {c3}2 and {c5}3 end",
}


def fill(template: str) -> F.Column:
    parts: list = []
    import re

    for piece in re.split(r"(\{\w+\})", template):
        if piece.startswith("{c"):
            parts.append(F.initcap(F.col("w" + piece[2])))
        elif piece.startswith("{"):
            parts.append(F.col(piece[1:-1]))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def fill_sql(template: str) -> str:
    import re

    out = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece.startswith("{c"):
            w = "w" + piece[2]
            out.append(f"upper({w}[1]) || {w}[2:]")
        elif piece.startswith("{"):
            out.append(piece[1:-1])
        elif piece:
            out.append(f"'{piece}'")
    return " || ".join(out) or "''"


def pages(d: DataFrame, convention: str) -> DataFrame:
    """A text block and one apparatus band for each row."""
    block = lambda layer, text: F.struct(F.lit(layer).alias("layer"), text.alias("text"))
    return d.select("doc_id", "page_index", F.array(block("text", fill(TEXTS[convention])), block("apparatus", fill(BANDS[convention]))).alias("blocks"))


#: (entry, side, text, witnesses, editors, qualifiers) of each convention's band; side 0 is the lemma.
EXPECTED = {
    "bude": [(0, 0, "{w1}", "{s}", "", ""), (0, 1, "{w2}", "{t}", "", ""), (1, 0, "{w3}", "{s},{t}", "", ""), (1, 1, "{w4}", "", "Otto", ""), (2, 0, "{w5}", "", "", ""), (2, 1, "", "{t}", "", "om.")],
    "teubner": [(0, 0, "{w1}", "", "", ""), (0, 1, "{w2}", "{s}", "", ""), (0, 2, "", "{t}", "", "om."), (1, 0, "{w3} {w4}", "", "", ""), (1, 1, "{w5}", "{t}", "", "")],
    "paragraph": [(0, 0, "{w1}", "", "", ""), (0, 1, "", "{s}", "", "om."), (1, 0, "{w2}", "", "", ""), (1, 1, "{w3}", "{s},{t}", "", ""), (2, 0, "{w4}", "", "", ""), (2, 1, "{w5}", "{s}", "", ""), (2, 2, "{w6}", "{t}", "", "")],
    "line": [(0, 0, "{w1}", "{s},{t}", "", ""), (0, 1, "{w2}", "", "Otto", ""), (1, 0, "{w3}", "{s}", "", ""), (1, 1, "{w4}", "{t}", "", ""), (2, 0, "{w5}", "{t}", "", "◊"), (2, 1, "{w6}", "{s}", "", "")],
    "verse": [(0, 0, "{w1}", "WH,NA", "", ""), (0, 1, "{w2}", "RP", "", ""), (0, 2, "{w3}", "TR", "", ""), (1, 0, "{w4}", "NA", "", ""), (1, 1, "", "RP", "", ""), (2, 0, "{w5}", "WH", "", ""), (2, 1, "{w6}", "Treg", "", "")],
    "marker": [(0, 0, "{c1}", "{s}", "", ""), (0, 1, "{w2}", "{t}", "", ""), (1, 0, "{c3}", "", "", ""), (1, 1, "{w4}", "", "Marc.", ""), (2, 0, "{c5}", "{s}", "", "add.")],
}


def expected_sql(convention: str) -> str:
    def text(side: int, template: str) -> str:
        x = fill_sql(template)  # the verse convention reads a lemma word printed twice without a gap once
        half = f"CASE WHEN len({x}) % 2 = 0 AND ({x})[:len({x}) // 2] = ({x})[len({x}) // 2 + 1:] THEN ({x})[:len({x}) // 2] ELSE {x} END"
        return half if convention == "verse" and side == 0 else x

    rows = " UNION ALL ".join(f"SELECT doc_id, page_index, {k} AS k, {side} AS side, {text(side, t)} AS text, {fill_sql(w)} AS witnesses, {fill_sql(e)} AS editors, {fill_sql(q)} AS qualifiers FROM six" for k, side, t, w, e, q in EXPECTED[convention])
    return f"WITH {WORDS_SQL} {rows}"
