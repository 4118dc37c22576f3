"""Registries from the pages that declare sigla and abbreviations. A registry is rows of ``token``, ``role``,
``description``; later lines overwrite earlier ones of the same token."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Editors named in many editions; an edition's own declarations come first.
EDITORS = {"Bekker": "Bekk.", "Bentley": "Bentl.", "Dindorf": "Dind.", "Erasmus": "Erasm.", "Heinsius": "Heins.", "Lachmann": "Lachm.", "Madvig": "Madv.", "Migne": "Mign.", "Nipperdey": "Nipp.", "Otto": "", "Scaliger": "Scal.", "Stephanus": "Steph.", "Wilamowitz": "Wil."}
_LOW, _UP, _CAPS = "ā-žø-ÿà-öa-z", "Ā-ŽÀ-ÞA-Z", "Ϙ-ϡα-ωΑ-Ω"
_HEAD = "(?i)manuscripts|abr[eé]viations|conspectus|sigl"
_EQUALS = f"^\\s*([{_CAPS}Ā-Žø-ÿØ-öÀ-Öa-zA-Z][{_CAPS}Ā-Žø-ÿØ-öÀ-Öa-zA-Z0-9 ,.*-]{{0,24}}?)\\s*=\\s*(\\S.*?)\\s*$"
_BRACKETS = "^\\s*\\[([^\\n\\]]{1,24})\\]\\s+(\\S.*)$"
_SIGLUM = f"^[{_CAPS}a-zA-Z][a-z]?[0-9]?\\*?$"
_EDITOR = f"^[{_UP}][{_LOW}{_UP}-]+\\.?$"
_NAME = f"[{_UP}][{_LOW}{_UP}ﬀ-ﬆ.'-]"
_YEAR = "(?:\\s+[0-9]{4}[a-z]?)?$"


def declarations(lines: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``token``, ``role``, ``description`` declared by ``text`` lines in the order of ``n``."""
    t = F.col("text")
    eq, br = t.rlike(_EQUALS), t.rlike(_BRACKETS)
    several = F.transform(F.split(F.regexp_extract(t, _EQUALS, 1), ","), lambda x: F.trim(x))
    role = lambda x: F.when(x.rlike(_SIGLUM), "witness").when(x.rlike(_EDITOR), "editor")
    a = F.transform(several, lambda x: F.struct(x.alias("token"), role(x).alias("role")))
    b = F.trim(F.regexp_extract(t, _BRACKETS, 1))
    ed = lambda x: F.struct(x.alias("token"), F.lit("editor").alias("role"))
    one, initial, many = f"^({_NAME}+){_YEAR}", f"^([{_UP}])\\. ([{_UP}][{_LOW}ﬀ-ﬆ'-]+)$", f"^({_NAME}*(?:\\s+{_NAME}+)+){_YEAR}"
    name = F.regexp_extract(b, many, 1)
    bracket = (
        F.when(b.rlike("^[Ϙ-ϡα-ωΑ-ΩA-Z](?:mr|ac|c)?\\*?[0-9]?$"), F.array(F.struct(b.alias("token"), F.lit("witness").alias("role"))))
        .when(b.rlike(one), F.array(ed(F.regexp_extract(b, one, 1))))
        .when(b.rlike(initial), F.array(ed(F.concat(F.regexp_extract(b, initial, 1), F.lit(". "), F.regexp_extract(b, initial, 2))), ed(F.concat(F.regexp_extract(b, initial, 1), F.regexp_extract(b, initial, 2)))))
        .when(b.rlike(many), F.array(ed(name), ed(F.regexp_replace(name, " ", ""))))
    )
    said = F.when(eq, F.regexp_extract(t, _EQUALS, 2)).otherwise(F.regexp_extract(t, _BRACKETS, 2))
    d = lines.where(eq | br).select(*keys, "n", said.alias("description"), F.explode(F.when(eq, a).otherwise(bracket)).alias("d"))
    d = d.select(*keys, "n", "d.token", "d.role", "description").where("role is not null and token <> ''")
    return d.groupBy(*keys, "token", "role").agg(F.max_by("description", "n").alias("description"))


def _declaring(pages: DataFrame, group: str, least: int) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    decl = F.size(F.filter(lines, lambda x: x.rlike(_EQUALS) | x.rlike(_BRACKETS)))
    head = F.split("text", "\n")[0].rlike(_HEAD) | F.substring("text", 1, 200).rlike(_HEAD) & F.col("text").rlike("[=\\[]")
    return pages.select(group, "page_index", head.alias("head"), ((decl >= least) & (2 * decl >= F.size(lines))).alias("goes_on"))


def _to_end(p: DataFrame, first: DataFrame, horizon: int, group: str) -> DataFrame:
    after = p.join(first, group).where(F.col("page_index").between(F.col("first") + 1, F.col("first") + horizon))
    stop = after.where("not goes_on").groupBy(group).agg(F.min("page_index").alias("stop"))
    last = after.groupBy(group).agg(F.max("page_index").alias("there"))
    end = F.least(F.coalesce("stop", F.col("first") + horizon + 1), F.coalesce("there", "first") + 1)
    return first.join(stop, group, "left").join(last, group, "left").select(group, "first", (end - 1).alias("last"))


def conspectus_pages(pages: DataFrame, horizon: int = 8, least: int = 2, group: str = "doc_id") -> DataFrame:
    """The page that opens the conspectus and those after it while half of their lines, and ``least``, declare."""
    p = _declaring(pages, group, least)
    return _to_end(p, p.where("head").groupBy(group).agg(F.min("page_index").alias("first")), horizon, group)


def conspectus_from(pages: DataFrame, page: int, horizon: int = 40, least: int = 2, group: str = "doc_id") -> DataFrame:
    """The same from a page that the user names, whatever its heading: a long register is followed further."""
    p = _declaring(pages, group, least)
    return _to_end(p, p.where(F.col("page_index") == page).select(group, F.col("page_index").alias("first")), horizon, group)


def builtin(spark) -> DataFrame:
    rows = [(t, "editor", name) for name, short in EDITORS.items() for t in (name, short) if t]
    return spark.createDataFrame(rows, "token string, role string, description string")


def merged(parts: list[DataFrame], *keys: str) -> DataFrame:
    """Registries united; of a token in several the first part's row stands."""
    d = None
    for i, p in enumerate(parts):
        q = p.select(*keys, "token", "role", "description", F.lit(i).alias("p"))
        d = q if d is None else d.unionByName(q)
    return d.groupBy(*keys, "token", "role").agg(F.min_by(F.struct("description"), "p").alias("s")).select(*keys, "token", "role", "s.description")


def as_maps(registry: DataFrame, *keys: str) -> DataFrame:
    """``witnesses`` and ``editors`` as maps, one row per key: what ``entries`` reads a page with."""
    pick = lambda r: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("token", F.coalesce("description", F.lit("")).alias("d"))))))
    return registry.groupBy(*keys).agg(pick("witness").alias("witnesses"), pick("editor").alias("editors"))
