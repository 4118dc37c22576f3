"""License scans (5): fuzzy short-notice search.

A notice may be found with up to ``errors`` edits (insertions, deletions, substitutions). Split into errors + 1 pieces,
at least one piece of it stands unedited in any such occurrence (pigeonhole), so all pieces of all notices go into one
Aho-Corasick automaton and each exact hit names the only window in which an occurrence around it can lie. Windows of
one notice that touch are merged, and the regex library's bounded-error matching, told to improve each match, verifies
them and reports span and edits. Every occurrence that a search of the whole text would find lies in some window, so
the result is that of the whole search.

Comparison ignores case (lower case, character by character, so that positions stay) and how a notice is laid out: any
run of white space counts as one space, as does a line break with the comment sign that begins the next line, so a
wrapped notice costs no edits. Spans are places in the text as it stands. Occurrences of one notice don't overlap,
leftmost first; different notices may overlap.

Edge cases. Null and empty texts have no hits and so no rows. Any length is scanned whole. Repeated rows give repeated
hits. Empty in, empty out. Only the id and the text are read; extra columns are ignored. An output column whose name the
id has gets an underscore.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.llm.common import free, map_arrow

#: (id, license, notice, permitted edits). Edits leave seeds of 5 characters at least.
NOTICES = [
    ("apache-2.0", "permissive", "licensed under the apache license, version 2.0", 3),
    ("mit", "permissive", "released under the mit license", 2),
    ("mit-grant", "permissive", "permission is hereby granted, free of charge, to any person obtaining a copy", 5),
    ("bsd", "permissive", "redistribution and use in source and binary forms, with or without modification, are permitted", 6),
    ("isc", "permissive", "permission to use, copy, modify, and/or distribute this software for any purpose", 5),
    ("gpl-3.0", "copyleft", "licensed under the gnu general public license, version 3", 4),
    ("lgpl", "copyleft", "gnu lesser general public license", 2),
    ("agpl", "copyleft", "gnu affero general public license", 2),
    ("mpl-2.0", "copyleft", "subject to the terms of the mozilla public license, v. 2.0", 4),
    ("cc-by-nc-4.0", "noncommercial", "licensed under cc by-nc 4.0", 2),
    ("cc-by-sa", "copyleft", "creative commons attribution-sharealike", 3),
    ("public-domain", "permissive", "released into the public domain", 2),
    ("reserved", "reserved", "all rights reserved", 2),
    ("confidential", "reserved", "this document is proprietary and confidential", 3),
    ("apache-warranty", "permissive", "on an \"as is\" basis, without warranties or conditions of any kind", 5),
    ("mit-warranty", "permissive", "the software is provided \"as is\", without warranty of any kind", 4),
    ("zlib", "permissive", "this software is provided 'as-is', without any express or implied warranty", 4),
    ("bsd-names", "permissive", "nor the names of its contributors may be used to endorse or promote products", 5),
    ("boost", "permissive", "boost software license - version 1.0", 2),
    ("unlicense", "permissive", "this is free and unencumbered software released into the public domain", 4),
    ("cc0", "permissive", "cc0 1.0 universal", 1),
    ("cc-by-4.0", "permissive", "licensed under a creative commons attribution 4.0 international license", 4),
    ("cc-by-nc", "noncommercial", "creative commons attribution-noncommercial", 3),
    ("cc-by-nd", "noderivatives", "creative commons attribution-noderivatives", 3),
    ("gpl-grant", "copyleft", "redistribute it and/or modify it under the terms of the gnu general public license", 5),
    ("gpl-later", "copyleft", "either version 2 of the license, or (at your option) any later version", 4),
    ("gfdl", "copyleft", "gnu free documentation license", 2),
    ("epl", "copyleft", "eclipse public license", 1),
    ("artistic", "permissive", "under the artistic license 2.0", 2),
    ("spdx", "tag", "spdx-license-identifier:", 2),
]


def lower(text: str) -> str:
    """Lower case of the same length: characters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


_LAYOUT = re.compile(r"\s*\n\s*(?:(?:[#*;%]+|//+|--+)\s+)?|\s{2,}|[^\S ]")


def flat(low: str) -> tuple[str, list[int], list[int]]:
    """The text with each run of white space as one space, and places in it with the places in ``low`` that they stand for."""
    parts, at, here, there, n = [], 0, [0], [0], 0
    for m in _LAYOUT.finditer(low):
        parts += (low[at : m.start()], " ")
        n += m.start() - at + 1
        at = m.end()
        here.append(n)
        there.append(at)
    return "".join(parts) + low[at:], here, there


def seeds(notice: str, errors: int) -> list[tuple[str, int]]:
    """errors + 1 pieces of about equal length, and where each begins."""
    k, n = errors + 1, len(notice)
    cuts = [i * n // k for i in range(k + 1)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices: list[tuple[str, str, str, int]]) -> None:
        import ahocorasick
        import regex

        self.notices = notices
        self.automaton = ahocorasick.Automaton()
        by = defaultdict(list)
        for i, (_, _, notice, errors) in enumerate(notices):
            for piece, at in seeds(notice, errors):
                by[piece].append((i, at))
        for piece, uses in by.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(f"(?e)(?:{regex.escape(n, literal_spaces=True)}){{e<={e}}}") for _, _, n, e in notices]

    def windows(self, low: str) -> dict[int, list[list[int]]]:
        out: dict[int, list[list[int]]] = {}
        for end, (size, uses) in self.automaton.iter(low):
            for i, at in uses:
                _, _, notice, errors = self.notices[i]
                a = max(0, end + 1 - size - at - errors)
                b = min(len(low), end + 1 - size - at + len(notice) + errors)
                spans = out.setdefault(i, [])
                spans.append([a, b])
        for i, spans in out.items():
            spans.sort()
            merged = [spans[0]]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            out[i] = merged
        return out

    def scan(self, text: str) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(notice, start, end, substitutions, insertions, deletions) in characters."""
        low, here, there = flat(lower(text))
        for i, spans in sorted(self.windows(low).items()):
            for a, b in spans:
                for m in self.patterns[i].finditer(low, a, b):
                    yield i, *(there[k] + p - here[k] for p in m.span() for k in [bisect.bisect_right(here, p) - 1]), *m.fuzzy_counts

    def whole(self, text: str) -> Iterator[tuple[int, int, int, int, int, int]]:
        """The same by search of the whole text, for tests."""
        low, here, there = flat(lower(text))
        place = [0] * (len(low) + 1)
        for h, t, end in zip(here, there, [*here[1:], len(low) + 1]):
            for p in range(h, end):
                place[p] = t + p - h
        for i, p in enumerate(self.patterns):
            for m in p.finditer(low):
                yield i, place[m.start()], place[m.end()], *m.fuzzy_counts


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", notices: list[tuple[str, str, str, int]] | None = None) -> DataFrame:
    """One row per occurrence: id, ``notice``, ``license_class``, ``span_start``, ``span_end`` (characters, end exclusive),
    ``substitutions``, ``insertions``, ``deletions``, ``matched`` (the text of the span)."""
    notices = NOTICES if notices is None else notices
    body = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__text")).where("__text is not null")
    kind = body.schema.fields[0].dataType.simpleString()
    held: list[Scanner] = []
    names = free(NAMES, [key])

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        if not held:
            held.append(Scanner(notices))
        at, rows = [], []
        for k, t in enumerate(b.column(1).to_pylist()):
            for i, s, e, *edits in held[0].scan(t):
                at.append(k)
                rows.append((notices[i][0], notices[i][1], s, e, *edits, t[s:e]))
        if not rows:
            return None
        cols = list(zip(*rows))
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(cols, types))], names=[key, *names])

    kinds = ["string", "string", "bigint", "bigint", "int", "int", "int", "string"]
    return map_arrow(body, run, ", ".join([f"`{key}` {kind}", *(f"`{n}` {k}" for n, k in zip(names, kinds))]))


NAMES = ["notice", "license_class", "span_start", "span_end", "substitutions", "insertions", "deletions", "matched"]
