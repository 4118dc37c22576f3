"""URL filters (1): temporal list join.

Dated list entries (``list``, ``pattern``, ``day``, ``action`` 'add' or 'remove') become validity intervals: an entry is
active from the day of an 'add' until, exclusively, the day of the next 'remove' of the same pattern in the same list.
Every capture (``url``, ``day`` of its fetch) is evaluated against the entries that were active on that day. Intervals
of one (list, pattern) don't overlap, so the as-of join - the latest interval that began by the day, if it hasn't ended -
is an equi-join on the pattern with the day between its bounds.

The intervals are written and counted. While their size allows they are broadcast: each task looks its captures'
patterns up where they are, and only hits are shuffled, combined by (URL, day) in the task first. Beyond, the patterns of
the distinct (URL, day) pairs are shuffled to the intervals, hot ones split by adaptive execution. The hits are written
and counted too, and broadcast to the captures while their size allows; so captures that match nothing never move unless
hits and lists are both too large for memory.

A pattern is a host (``example.com``: it and all its subdomains) or a host with a path (``example.com/ads``: that host
and all paths at or below it). Hosts are compared in lower case, without user, port and trailing dot; the scheme, query
and fragment are ignored. Paths are compared as they stand, by whole segments.

Edge cases. A null URL, or one without scheme and host, matches nothing and isn't blocked; nor is a capture with a null
day. Entries with a null list, pattern or day, or another action, are ignored. On one day a 'remove' follows all 'add's
of the same pattern, so it wins. Adding twice or removing what isn't there changes nothing. Captures are judged by URL
and day alone: repeated rows get equal rows, and distinct pairs are joined once. An empty list blocks nothing; an
empty table gives an empty one. All columns of the captures pass through, but one named like an output column
(``blocked``, ``lists``, ``pattern``, ``since``, in any case) is replaced by it. Inner names can't clash with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from variorum.llm import common
from variorum.llm.common import besides, broadcast_if_small, written

#: Assumed size of an interval or a hit in memory, its strings included.
ROW_BYTES = 400
_URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)"


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"\.+$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 2)


def patterns_of(url: Column) -> Column:
    """All patterns that match the URL: the host's suffixes, and the host with each prefix of the path."""
    host, labels = host_of(url), F.split(host_of(url), r"\.")
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.when(F.size(segments) > 0, F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/"))))
    return F.when(host != "", F.array_distinct(F.concat(hosts, F.coalesce(paths, F.array().cast("array<string>")))))


def intervals(entries: DataFrame) -> DataFrame:
    """``list``, ``pattern``, ``since``, ``until`` (null: still active); disjoint for each list and pattern."""
    rows = entries.select(F.col("list").cast("string"), F.lower("pattern").alias("low"), F.col("pattern"), F.to_date("day").alias("day"), "action")
    # the host is compared in lower case, the path as it stands
    head = F.instr("pattern", "/")
    pattern = F.when(head > 0, F.concat(F.expr("substring(low, 1, instr(pattern, '/') - 1)"), F.rtrim(F.expr("substring(pattern, instr(pattern, '/'))"), F.lit("/")))).otherwise(F.col("low"))
    days = rows.select("list", pattern.alias("pattern"), "day", "action").where("list is not null and pattern is not null and day is not null and action in ('add', 'remove')")
    last = days.groupBy("list", "pattern", "day").agg(F.max(F.col("action") == "remove").alias("gone"))
    w = Window.partitionBy("list", "pattern").orderBy("day")
    turns = last.withColumn("was", F.lag("gone", 1, True).over(w)).where(F.col("gone") != F.col("was"))
    return turns.withColumn("until", F.lead("day").over(w)).where(~F.col("gone")).select("list", "pattern", F.col("day").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """The captures with ``blocked`` (boolean), ``lists`` (sorted, joined by commas; null where not blocked),
    ``pattern`` (the longest that matched, of those the first by name) and ``since`` (the earliest beginning)."""
    outputs = ["blocked", "lists", "pattern", "since"]
    through = besides(captures, outputs)
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in through]).alias("r"), F.col(f"`{url}`").alias("u"), F.to_date(F.col(f"`{day}`")).alias("d"))
    spans = written(intervals(entries), "intervals")
    count = spans.count()
    asked = rows.select("u", "d").where("u is not null and d is not null")
    if count * ROW_BYTES > common.BROADCAST_BYTES:
        asked = asked.distinct()
    keys = asked.withColumn("pattern", F.explode(patterns_of(F.col("u"))))
    hit = keys.join(broadcast_if_small(spans, count, ROW_BYTES), "pattern").where((F.col("d") >= F.col("since")) & (F.col("until").isNull() | (F.col("d") < F.col("until"))))
    hit = hit.groupBy("u", "d", "list").agg(F.min(F.struct(-F.length("pattern"), F.col("pattern").alias("p"))).alias("best"), F.min("since").alias("since"))
    found = hit.groupBy("u", "d").agg(F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"), F.min("best").alias("best"), F.min("since").alias("since"))
    found = written(found, "hits")
    out = rows.join(broadcast_if_small(found, found.count(), ROW_BYTES), ["u", "d"], "left")
    return out.select(*[F.col(f"r.`{c}`").alias(c) for c in through], F.col("lists").isNotNull().alias("blocked"), "lists", F.col("best.p").alias("pattern"), "since")
