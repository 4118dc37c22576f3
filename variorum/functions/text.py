"""Scalar functions as Catalyst expressions; only what Spark has no expression for (Unicode forms) is an Arrow UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variorum.kernels import folds, matching, reading
from variorum.kernels.labels import LAYER_OF
from variorum.kernels.matching import LETTER

#: What Python's ``str.split()`` splits on, written out because Java's \\s is ASCII only.
SPACE = "[\\t-\\r\\x1C- \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
HANDS = {"*": "reading that prompted a correction", "ac": "before correction", "c": "after correction / corrector", "mr": "later hand (manus recentior)", "pc": "after correction / corrector"}


def normalise(c: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def preview(c: Column, limit: int = 120) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - 1), F.lit("…")))


def unwrap(c: Column) -> Column:
    """Line breaks as single spaces; nothing else changes."""
    return F.regexp_replace(c, "\\r\\n|\\r|\\n", " ")


def source_digest(c: Column) -> Column:
    return F.substring(F.sha2(unwrap(c), 256), 1, 12)


def source_excerpt(c: Column) -> Column:
    return preview(normalise(c))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.octet_length(c) / 4)).cast("bigint")


def xml_id(c: Column) -> Column:
    """ASCII alphanumerics stay, other characters become u and their code point in hex."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.array_join(F.transform(chars, lambda x: F.when(x.rlike("^[A-Za-z0-9]$"), x).otherwise(F.concat(F.lit("u"), F.lower(F.hex(F.ascii(x)))))), "")


def refusal_key(c: Column) -> Column:
    """One key per class of refusal: numbers folded to n, the meta line's own delimiters replaced, not dropped."""
    return F.translate(F.regexp_replace(normalise(c), "[0-9]+(?:[.,][0-9]+)*%?", "n"), "·;", ".,")


def letters(c: Column) -> Column:
    return F.regexp_replace(c, "\\P{L}", "")


def is_greek(c: Column) -> Column:
    """More than half of the letters are Greek."""
    greek = F.length(F.regexp_replace(c, "[^\\u0370-\\u03FF\\u1F00-\\u1FFF]|\\P{L}", ""))
    return F.coalesce(greek * 2 > F.length(letters(c)), F.lit(False))


def lang_tag(c: Column) -> Column:
    return F.when(is_greek(c), F.lit("grc"))


def hand(siglum: Column) -> Column:
    """The hand state at the end of a one-letter siglum, '' if there is none."""
    return F.regexp_extract(siglum, "^[A-Za-zÀ-ÖØ-öø-ÿĀ-ŽΑ-Ωα-ωϘ-ϡ](mr|ac|pc|c|[*1-9])$", 1)


def hand_label(h: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in HANDS.items() for x in kv])
    return F.when(h.rlike("^[1-9]$"), F.concat(F.lit("hand "), h)).otherwise(F.coalesce(names[h], F.lit("")))


def layer_of_label(label: Column) -> Column:
    """The layer that a producer's label declares; unknown unless the label is on the list."""
    token = F.trim(F.regexp_replace(F.lower(F.trim(label)), "[-_\\s]+", "-"), F.lit("-"))
    names = F.create_map(*[F.lit(x) for kv in LAYER_OF.items() for x in kv])
    return F.coalesce(names[token], names[F.regexp_replace(token, "^ocr-", "")], F.lit("unknown"))


def bracket_markers(c: Column) -> Column:
    """Markers glued to a word, rewritten as ⟦n⟧."""
    close, stop = "’'·;.,>}\\])", "—–»!:·;,.)\\] \\t\\n"
    return F.regexp_replace(c, f"(?<=[{LETTER}{close}])([0-9]{{1,2}})(?=[{LETTER}{stop}]|$)", "⟦$1⟧")


def has_marginal_numbers(c: Column) -> Column:
    """Three or more line numbers of 5, 10 .. 30 between white space."""
    return F.regexp_count(c, F.lit("(?:^|\\s)(?:5|10|15|20|25|30)(?=\\s|$)")) >= 3


def crop(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A rectangle within the page, cut to whole pixels."""
    fit = lambda v, most: F.greatest(F.lit(0), F.least(v, most)).cast("int")
    return F.struct(fit(x0, width).alias("x0"), fit(y0, height).alias("y0"), fit(x1, width).alias("x1"), fit(y1, height).alias("y1"))


@F.pandas_udf(T.IntegerType())
def repeated_markers(texts: pd.Series) -> pd.Series:
    return texts.map(lambda ts: matching.repeated_markers([t for t in ts if t is not None]), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def normalise_answer(s: pd.Series) -> pd.Series:
    return s.map(reading.answer, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def answer_set(s: pd.Series) -> pd.Series:
    return s.map(reading.answers, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def gold_set(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: sorted({reading.answer(x.removeprefix("#")) for x in xs if x is not None}), na_action="ignore")


@F.pandas_udf(T.StringType())
def excerpt(text: pd.Series, around: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else reading.excerpt(t, a or "") for t, a in zip(text, around)])


@F.pandas_udf(T.StringType())
def lemma_window(text: pd.Series, lemma: pd.Series, radius: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or x is None else reading.window(t, x, r) for t, x, r in zip(text, lemma, radius)])


@F.pandas_udf(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
def line_span(lines: pd.Series, entry: pd.Series) -> pd.DataFrame:
    """First and last of the lines that carry the entry; nulls where none does."""
    found = [None if x is None or e is None else reading.line_span(x, e) for x, e in zip(lines, entry)]
    return pd.DataFrame({"first": pd.array([f and f[0] for f in found], "Int32"), "last": pd.array([f and f[1] for f in found], "Int32")})


@F.pandas_udf(T.StringType())
def fold(s: pd.Series) -> pd.Series:
    return s.map(matching.fold, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def lemma_follows(lemma: pd.Series, before: pd.Series) -> pd.Series:
    return pd.Series([x is not None and y is not None and matching.follows(x, y) for x, y in zip(lemma, before)])


def fold_with(profile: str):
    """A comparator's fold of strings, and of each string of an array, as an Arrow UDF."""
    return F.pandas_udf(lambda s: s.map(lambda x: folds.fold(profile, x), na_action="ignore"), T.StringType())


def fold_each_with(profile: str):
    return F.pandas_udf(lambda s: s.map(lambda xs: [None if x is None else folds.fold(profile, x) for x in xs], na_action="ignore"), T.ArrayType(T.StringType()))


def folded_words(folded: Column) -> Column:
    """Words of a text that the golden fold has been through."""
    return F.filter(F.split(folded, "[\\s!(),.:;?\\[\\]«·»]+"), lambda w: w != "")
