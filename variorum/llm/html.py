"""HTML extraction (6): layout-aware rendering.

A tree builder (implied tags: paragraphs end at blocks, items at items, cells at cells, rows at rows, options at
options; end tags close what is open inside them and are ignored where nothing is open) and a renderer that emits all
visible text: blocks on lines of their own, paragraphs, headings, lists and tables apart by an empty line, ``br`` as a
line break, list items with their bullet or number and indented by depth, ``pre`` as it stands, tables as columns
padded to equal width, with row and column spans.

Not visible: head, script, style, template, noscript, iframe, object, svg, audio, video and the like; elements with
``hidden``, ``display: none``, ``visibility: hidden`` (unless a descendant turns it back on) or, of inputs, type hidden;
all of closed ``details`` but the summary; comments, declarations.

Edge cases. Null HTML gives null text; empty HTML, and HTML without visible text, empty text. Unclosed tags, comments
and attribute quotes are closed by the end of the text; a ``<`` that begins no tag is text. Elements may be nested to any
depth: neither the builder nor the renderer recurses. A cell spans 1000 columns and 65,534 rows at most and no row
beyond its table, as the HTML standard rules. Rows are rendered one by one: repeated rows give equal rows, empty tables
empty ones. Other columns pass through, but one named like the output (in any case) is replaced by it. Pages of any
length are rendered whole.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Generator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.llm.common import besides, map_arrow

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_WORDS = re.compile(r"[^ \t\n\r\f]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noframes noembed xmp".split())
_GONE = frozenset("head script style template noscript iframe object embed svg math audio video canvas map datalist noframes noembed title meta link base param source track".split())
_APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre figure fieldset hr form".split())
_BLOCK = _APART | frozenset("html body div article section nav header footer main aside address center dir details summary dialog dd dt li figcaption hgroup legend optgroup option search tr td th thead tbody tfoot caption".split())
_ENDS_P = _BLOCK - frozenset("option optgroup legend".split())
#: A start tag ends the open elements of the first set, searched up to one of the second.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
_P_SCOPE = frozenset("table td th caption button object".split())
_HEAD_ONLY = frozenset("head title meta link base script style template noscript".split())


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def attr(self, name: str) -> str | None:
        """An attribute's value, '' of one without; None where it isn't there."""
        if name not in self.attrs.lower():
            return None
        for k, a, b, c in _ATTR.findall(self.attrs):
            if k.lower() == name:
                return entities.unescape(a or b or c)
        return None

    def number(self, name: str, default: int, most: int) -> int:
        try:
            return max(0, min(most, int(self.attr(name) or default)))
        except ValueError:
            return default


def build(source: str) -> Node:
    root = Node("#root")
    stack, pos, n = [root], 0, len(source)
    many: Counter[str] = Counter()  # open elements of each tag, so that what isn't open isn't searched for

    def close(upto: int) -> None:
        many.subtract(x.tag for x in stack[upto:])
        del stack[upto:]

    def find(names, scope) -> int:
        if not any(many[t] for t in names):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                return i
            if stack[i].tag in scope:
                return 0
        return 0

    def text(t: str) -> None:
        if t:
            if stack[-1].tag == "head" and t.strip():
                close(len(stack) - 1)
            stack[-1].children.append(t)

    while pos < n:
        m = _TAG.search(source, pos)
        if not m:
            text(entities.unescape(source[pos:]))
            break
        if m.start() > pos:
            text(entities.unescape(source[pos : m.start()]))
        pos = m.end()
        name = m["name"] or m["name2"]
        if not name:
            if m["cdata"]:
                text(m["cdata"])
            continue
        tag, rest = name.lower(), m["rest"] if m["name"] else m["rest2"]
        if m["end"] or m["end2"]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif i := find({tag}, frozenset() if tag in ("html", "body", "table") else ({"table"} if tag not in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else frozenset())):
                close(i)
            continue
        if stack[-1].tag == "head" and tag not in _HEAD_ONLY:
            close(len(stack) - 1)
        if tag in _ENDS_P and (i := find({"p"}, _P_SCOPE)):
            close(i)
        if tag in _IMPLIED:
            names, scope = _IMPLIED[tag]
            while i := find(names, scope):
                close(i)
        node = Node(tag, rest)
        stack[-1].children.append(node)
        if tag in _RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(source, pos)
            inner = source[pos : end.start()] if end else source[pos:]
            node.children.append(entities.unescape(inner) if tag in ("textarea", "title") else inner)
            pos = end.end() if end else n
        elif tag not in _VOID and not (rest.endswith("/") and tag not in _BLOCK):
            stack.append(node)
            many[tag] += 1
    return root


class Lines:
    """Lines under construction: collapsed words, and the space that blocks keep from each other."""

    __slots__ = ("cur", "gap", "lines", "space")

    def __init__(self) -> None:
        self.lines, self.cur, self.space, self.gap = [], [], False, 0

    def _open(self) -> None:
        if not self.cur and self.gap:
            if self.lines and self.gap > 1 and self.lines[-1] != "":
                self.lines.append("")
            self.gap = 0

    def text(self, t: str) -> None:
        words = _WORDS.findall(t)
        if not words:
            self.space = self.space or bool(t and self.cur)
            return
        self._open()
        if self.cur and (self.space or t[0] in " \t\n\r\f"):
            self.cur.append(" ")
        self.cur.append(" ".join(words))
        self.space = t[-1] in " \t\n\r\f"

    def brk(self) -> None:
        self._open()
        self.lines.append("".join(self.cur))
        self.cur, self.space = [], False

    def block(self, gap: int) -> None:
        if self.cur:
            self.lines.append("".join(self.cur))
            self.cur = []
        self.space = False
        if self.lines:
            self.gap = max(self.gap, gap)

    def add(self, lines: list[str], gap: int) -> None:
        """Finished lines as a block of their own."""
        self.block(gap)
        if lines:
            self._open()
            self.lines += lines
            self.gap = gap

    def done(self) -> list[str]:
        self.block(0)
        out = self.lines
        while out and not out[-1]:
            out.pop()
        while out and not out[0]:
            del out[0]
        return out


def hidden(node: Node) -> bool:
    if node.tag in _GONE:
        return True
    a = node.attrs
    if not a:
        return False
    low = a.lower()
    if "hidden" in low and (node.attr("hidden") is not None or (node.tag == "input" and (node.attr("type") or "").lower() == "hidden")):
        return True
    return "display" in low and bool(_HIDE.search(node.attr("style") or ""))


#: A renderer's step: it yields the steps that it waits for and returns their results to the one that waits for it.
Step = Generator["Step", list[str] | None, list[str] | None]


def completed(step: Step) -> list[str] | None:
    """The result of a step and of all it waits for, on a stack of our own, however deep."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def inside(node: Node, out: Lines, pre: bool, seen: bool) -> Step:
    shut = node.tag == "details" and node.attr("open") is None
    count = node.number("start", 1, 1 << 30) if node.tag == "ol" else 0
    for c in node.children:
        if isinstance(c, str):
            if seen and not shut:
                if pre:
                    for k, line in enumerate(c.split("\n")):
                        if k:
                            out.brk()
                        if line:
                            out._open()
                            out.cur.append(line)
                else:
                    out.text(c)
        elif not shut or c.tag == "summary":
            if c.tag == "li" and node.tag in ("ul", "ol", "menu", "dir"):
                if node.tag == "ol":
                    count = c.number("value", count, 1 << 30)
                    yield item(c, out, f"{count}. ", pre, seen)
                    count += not hidden(c)
                else:
                    yield item(c, out, "- ", pre, seen)
            elif node.tag == "li" and c.tag in ("ul", "ol", "menu", "dir") and not hidden(c):
                out.add((yield sub(c, pre, seen)), 1)
            else:
                yield render(c, out, pre, seen)


def sub(node: Node, pre: bool, seen: bool) -> Step:
    inner = Lines()
    yield inside(node, inner, pre, seen)
    return inner.done()


def item(node: Node, out: Lines, mark: str, pre: bool, seen: bool) -> Step:
    if hidden(node):
        return
    if m := _VISIBILITY.search(node.attr("style") or ""):
        seen = m[1].lower() == "visible"
    lines = yield sub(node, pre, seen)
    if lines:
        out.add([mark + lines[0], *(" " * len(mark) + x if x else x for x in lines[1:])], 1)


def table(node: Node, out: Lines, pre: bool, seen: bool) -> Step:
    rows: list[Node] = []
    for c in node.children:
        if isinstance(c, str):
            if c.strip() and seen:
                out.text(c)
        elif hidden(c):
            continue
        elif c.tag == "tr":
            rows.append(c)
        elif c.tag in ("thead", "tbody", "tfoot"):
            for r in c.children:
                if not isinstance(r, str) and r.tag == "tr":
                    if not hidden(r):
                        rows.append(r)
                elif isinstance(r, str):
                    if seen:
                        out.text(r)
                else:
                    yield render(r, out, pre, seen)
        else:
            yield render(c, out, pre, seen)
    out.block(1)
    busy: dict[int, int] = {}  # per column, the row at which the last cell that reaches down into it ends
    cells: list[tuple[int, int, int, list[str], bool]] = []
    for y, r in enumerate(rows):
        x = 0
        for c in r.children:
            if isinstance(c, str):
                if seen:
                    out.text(c)
                continue
            if c.tag not in ("td", "th"):
                yield render(c, out, pre, seen)
                continue
            if hidden(c):
                continue
            while busy.get(x, 0) > y:
                x += 1
            wide, high = max(1, c.number("colspan", 1, 1000)), max(1, min(len(rows) - y, c.number("rowspan", 1, 65_534)))
            for dx in range(wide if high > 1 else 0):
                busy[x + dx] = y + high
            shown = seen
            if m := _VISIBILITY.search(c.attr("style") or ""):
                shown = m[1].lower() == "visible"
            cells.append((y, x, wide, (yield sub(c, pre, shown)), (c.attr("align") or "").lower() == "right"))
            x += wide
    width: dict[int, int] = {}
    for _, x, wide, lines, _ in cells:
        if wide == 1:
            width[x] = max(width.get(x, 0), *map(len, lines), 0)
    for _, x, wide, lines, _ in sorted(cells, key=lambda c: c[2]):
        have = sum(width.setdefault(k, 0) for k in range(x, x + wide)) + 2 * (wide - 1)
        width[x + wide - 1] += max(0, max(map(len, lines), default=0) - have)
    left, at = {}, 0
    for x in sorted(width):
        left[x] = at
        at += width[x] + 2
    done: list[str] = []
    by_row: dict[int, list] = {}
    for c in cells:
        by_row.setdefault(c[0], []).append(c)
    for y in range(len(rows)):
        own = by_row.get(y, [])
        for k in range(max((len(c[3]) for c in own), default=0)):
            line = ""
            for _, x, wide, lines, right in own:
                if k < len(lines):
                    room = sum(width[q] for q in range(x, x + wide)) + 2 * (wide - 1)
                    line = line.ljust(left[x]) + (lines[k].rjust(room) if right else lines[k])
            done.append(line.rstrip())
    out.add(done, 2)


def render(node: Node, out: Lines, pre: bool, seen: bool) -> Step:
    tag = node.tag
    if tag == "br":
        if seen:
            out.brk()
        return
    if hidden(node):
        return
    if node.attrs and "visibility" in node.attrs.lower() and (m := _VISIBILITY.search(node.attr("style") or "")):
        seen = m[1].lower() == "visible"
    if tag == "table":
        out.block(2)
        yield table(node, out, pre, seen)
        return
    if tag == "input":
        if seen and (node.attr("type") or "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url"):
            out.text(f" {node.attr('value') or ''} ".rstrip() + " ")
        return
    if tag == "pre" or tag == "textarea":
        lines = yield sub(node, True, seen)
        out.add(lines, 2 if tag == "pre" else 1)
        return
    if tag == "blockquote" or tag == "dd":
        out.add(["    " + x if x else x for x in (yield sub(node, pre, seen))], 2 if tag == "blockquote" else 1)
        return
    gap = 2 if tag in _APART else 1 if tag in _BLOCK else 0
    if gap:
        out.block(gap)
    yield inside(node, out, pre, seen)
    if gap:
        out.block(gap)


def extract_text(source: str | None) -> str | None:
    """The visible text; lines apart by newlines, without any at the ends."""
    if source is None:
        return None
    return "\n".join(completed(sub(build(source), False, True)))


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """The pages' other columns and ``out``. No shuffle."""
    names = besides(pages, [html, out])
    body = pages.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{html}`").alias("__html"))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in body.schema.fields[:-1]), f"`{out}` string"])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([extract_text(t) for t in b.column(len(names)).to_pylist()], pa.string())], names=[*names, out])

    return map_arrow(body, run, fields)
