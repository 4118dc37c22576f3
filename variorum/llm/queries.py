"""The queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.llm import bpe, exact, html, langid, licenses, packing, repetition, simhash, urlfilter, warc

#: (list, pattern, day, action). Pages have no fetch date, so the query gives each one that follows from its id.
URL_LIST = [
    ("spam", "spam-farm.example.org", "2024-01-15", "add"),
    ("spam", "spam-farm.example.org", "2024-05-01", "remove"),
    ("spam", "spam-farm.example.org", "2024-09-01", "add"),
    ("spam", "cheap-pills.example.com", "2024-02-01", "add"),
    ("gambling", "casino-win.example.com", "2024-03-10", "add"),
    ("gambling", "casino-win.example.com", "2024-11-20", "remove"),
    ("trackers", "tionsh.example.net", "2024-04-01", "add"),
    ("trackers", "tionsh.example.net", "2024-04-15", "remove"),
    ("trackers", "tionsh.example.net", "2024-04-15", "add"),
    ("trackers", "tionsh.example.net", "2024-07-01", "add"),
    ("trackers", "tionsh.example.net", "2024-08-01", "remove"),
    ("optout", "ththre.example.com/fr", "2024-06-01", "add"),
    ("optout", "ththen.example.org/en", "2024-01-01", "add"),
    ("optout", "ththen.example.org/en", "2024-03-01", "remove"),
    ("optout", "Example.NET/es/", "2024-10-01", "add"),
    ("legal", "thing.example.org", "2024-01-01", "remove"),
]
_DAY = "DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INT)"


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", F.expr(f"date_add(DATE '2024-01-01', CAST((page_id * 37) % 366 AS INT))").alias("day"))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame(URL_LIST, "list string, pattern string, day string, action string")
    out = urlfilter.filter_urls(captures(spark, sf_dir), entries)
    return out.select("page_id", "url", F.col("day").cast("string").alias("day"), "blocked", "lists", "pattern", F.col("since").cast("string").alias("since"))


def warc_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_of(warc.read(warc.write(table(spark, sf_dir, "pages"))))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.encode(table(spark, sf_dir, "documents"))
    return bpe.decode(tokens.withColumn("n_tokens", F.size("tokens")))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": url_filter,
        "op2_warc_reader": warc_reader,
        "op3_bpe": bpe_round_trip,
        "op4_best_fit_packing": best_fit_packing,
        "op5_license_scan": license_scan,
        "op6_html_text": html_text,
        "op7_language_id": language_id,
        "op8_exact_dedup": exact_dedup,
        "op9_simhash_near_dedup": simhash_near_dedup,
        "op10_quality_rules": quality_rules,
    }


_ENTRIES = ", ".join(f"('{a}', '{b}', DATE '{c}', '{d}')" for a, b, c, d in URL_LIST)
URL_SQL = f"""
WITH entries(list, raw, day, action) AS (VALUES {_ENTRIES}),
named AS (SELECT list, day, action, CASE WHEN contains(raw, '/') THEN lower(split_part(raw, '/', 1)) || rtrim(substr(raw, instr(raw, '/')), '/') ELSE lower(raw) END AS pattern FROM entries),
last AS (SELECT list, pattern, day, bool_or(action = 'remove') AS gone FROM named GROUP BY ALL),
pages_ AS (SELECT page_id, url, {_DAY} AS day, rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
parts AS (SELECT page_id, url, day, host, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM pages_ WHERE host <> ''),
keys AS (
    SELECT page_id, day, unnest(list_transform(range(1, len(labels) + 1), lambda i: array_to_string(labels[i:], '.'))) AS pattern FROM parts
    UNION
    SELECT page_id, day, unnest(list_transform(range(1, len(segs) + 1), lambda i: host || '/' || array_to_string(segs[1:i], '/'))) FROM parts),
lists AS (SELECT DISTINCT list, pattern FROM last),
asked AS (SELECT page_id, list, k.pattern, k.day FROM keys k JOIN lists USING (pattern)),
state AS (SELECT a.page_id, a.list, a.pattern, a.day, l.gone FROM asked a ASOF JOIN last l ON a.list = l.list AND a.pattern = l.pattern AND a.day >= l.day),
active AS (SELECT s.page_id, s.list, s.pattern,
    (SELECT min(x.day) FROM last x WHERE x.list = s.list AND x.pattern = s.pattern AND NOT x.gone AND x.day <= s.day
        AND x.day > coalesce((SELECT max(y.day) FROM last y WHERE y.list = s.list AND y.pattern = s.pattern AND y.gone AND y.day <= s.day), DATE '1900-01-01')) AS since
    FROM state s WHERE NOT s.gone),
hits AS (SELECT page_id, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists, arg_min(pattern, (-length(pattern), pattern)) AS pattern, min(since) AS since FROM active GROUP BY page_id)
SELECT page_id, url, CAST(day AS VARCHAR) AS day, lists IS NOT NULL AS blocked, lists, pattern, CAST(since AS VARCHAR) AS since
FROM pages_ LEFT JOIN hits USING (page_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": URL_SQL,
        "op2_warc_reader": "SELECT page_id, url, html FROM pages",
        "op8_exact_dedup": """
            SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY text
            UNION ALL SELECT doc_id, 1 FROM documents WHERE text IS NULL""",
    }
