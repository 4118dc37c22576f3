"""ALTO, hOCR and PAGE-XML files to blocks, one task per file and no driver in between. A file that isn't what it was
handed over as gives a row with ``refused`` instead of a failed task: a wrong file must not stop a corpus.

``files`` has ``path`` and ``content`` (string or binary, as of ``wholetext`` or ``binaryFile``)."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from variorum.kernels.labels import LAYER_OF

BLOCK = "path string, page int, printed_page string, block int, layer string, text string, source string, generative boolean, confidence double, evidence string, refused string"
_ARROW = pa.schema([("path", pa.string()), ("page", pa.int32()), ("printed_page", pa.string()), ("block", pa.int32()), ("layer", pa.string()), ("text", pa.string()), ("source", pa.string()), ("generative", pa.bool_()), ("confidence", pa.float64()), ("evidence", pa.string()), ("refused", pa.string())])
_MAGIC = {b"%PDF-": "a PDF", b"\x1f\x8b": "a gzip archive", b"\x89PNG": "a PNG image", b"\xff\xd8\xff": "a JPEG image", b"II*\x00": "a TIFF image", b"MM\x00*": "a TIFF image", b"PK\x03\x04": "a ZIP container"}
_OCR = "OCR output — text is generated, not decoded"


class Refused(ValueError):
    """Why a file isn't what it was handed over as."""


def sniff(raw: bytes, kind: str) -> bytes:
    if not raw.strip():
        raise Refused(f"the file is empty, so there is nothing to read as {kind}")
    for magic, what in _MAGIC.items():
        if raw.startswith(magic):
            raise Refused(f"this is {what}, not {kind}")
    return raw


def xml_root(raw: bytes, kind: str, tag: str) -> ET.Element:
    try:
        root = ET.fromstring(sniff(raw, kind))
    except ET.ParseError as e:
        raise Refused(f"not {kind}: no well-formed XML ({e})") from None
    if name(root) != tag:
        raise Refused(f"not {kind}: its root is <{name(root)}> and not <{tag}>")
    return root


def name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def below(e: ET.Element, tag: str) -> Iterator[ET.Element]:
    return (x for x in e.iter() if x is not e and name(x) == tag)


def layer(label: str | None) -> str:
    """The layer that a label declares; unknown unless it is on the list."""
    token = re.sub(r"[-_\s]+", "-", (label or "").strip().lower()).strip("-")
    return LAYER_OF.get(token) or LAYER_OF.get(token.removeprefix("ocr-"), "unknown")


def number(s: str | None, low: float = float("-inf"), high: float = float("inf")) -> list[float]:
    try:
        v = float(s) if s else None
    except ValueError:
        return []
    return [v] if v is not None and low <= v <= high else []


@dataclass
class Block:
    layer: str
    lines: list[str]
    confidence: float
    evidence: str


@dataclass
class Page:
    printed: str | None = None
    blocks: list[Block] = field(default_factory=list)


def mean(values: list[float]) -> float:
    return sum(values) / len(values) if values else 0.0


def read_alto(raw: bytes, labels: tuple[str, ...] = ()) -> list[Page]:
    root, page = xml_root(raw, "ALTO", "alto"), Page()
    tags = {e.get("ID"): e.get("LABEL") or e.get("TYPE") for e in root.iter() if name(e) in ("LayoutTag", "OtherTag") and e.get("ID")}
    for tb in below(root, "TextBlock"):
        said, sure = [], []
        for line in (x for x in tb if name(x) == "TextLine"):
            words = [x.get("CONTENT", "") if name(x) == "String" else " " for x in line if name(x) in ("SP", "String")]
            sure += [v for x in line if name(x) == "String" for v in number(x.get("WC"))]
            if words:
                said.append("".join(words).strip())
        label = next((tags[r] for r in (tb.get("TAGREFS") or "").split() if tags.get(r)), tb.get("TYPE"))
        if said:
            page.blocks.append(Block(layer(label), said, mean(sure), f"ALTO TextBlock; {_OCR}" + (f"; TAG/TYPE={label}" if label else "")))
    return [page]


def _primary(e: ET.Element) -> tuple[str, list[float]]:
    """Text and confidence of the element's TextEquiv of least index, the first of equals."""

    def rank(x: ET.Element) -> int:
        i = x.get("index") or "0"
        return int(i) if re.fullmatch("-?[0-9]+", i) else 0

    equivs = [x for x in e if name(x) == "TextEquiv"]
    if not equivs:
        return "", []
    best = min(equivs, key=rank)
    carriers = {name(x): x.text or "" for x in reversed(best)}
    return carriers.get("Unicode", carriers.get("PlainText", "")).strip(), number(best.get("conf"), 0, 1)


def _regions(e: ET.Element) -> Iterator[ET.Element]:
    for x in e:
        if name(x) == "TextRegion":
            yield x
        else:
            yield from _regions(x)


def read_page(raw: bytes, labels: tuple[str, ...] = ()) -> list[Page]:
    root, page = xml_root(raw, "PAGE-XML", "PcGts"), Page()
    src = next((x for x in root if name(x) == "Page"), None)
    if src is None:
        raise Refused("PAGE-XML without a <Page>")
    order = any(name(x) == "ReadingOrder" for x in src)
    for region in _regions(src):
        said, sure = [], []
        for line in below(region, "TextLine"):
            text, conf = _primary(line)
            sure += conf
            if not text:
                words = [_primary(w) for w in below(line, "Word")]
                sure += [v for _, c in words for v in c]
                text = " ".join(t for t, _ in words if t)
            if text:
                said.append(text)
        if not said:
            text, conf = _primary(region)
            sure += conf
            said = [x for x in text.splitlines() if x.strip()]
        kind = region.get("type")
        note = "PAGE-XML TextRegion" + (f" (@type={kind})" if kind else "") + f"; {_OCR}" + ("; ReadingOrder declared, not applied (document order kept)" if order else "")
        if said:
            page.blocks.append(Block(layer(kind), said, mean(sure), note))
    return [page]


@dataclass
class Node:
    tag: str = ""
    classes: frozenset[str] = frozenset()
    props: dict[str, str] = field(default_factory=dict)
    parts: list = field(default_factory=list)

    def nodes(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]

    def text(self) -> str:
        return "".join(p.text() if isinstance(p, Node) else p for p in self.parts)

    def line(self) -> str:
        return re.sub(r"\s+", " ", self.text()).strip()

    def all(self) -> Iterator[Node]:
        for n in self.nodes():
            yield n
            yield from n.all()

    def outer(self, classes: frozenset[str]) -> list[Node]:
        if self.classes & classes:
            return [self]
        return [x for n in self.nodes() for x in n.outer(classes)]


_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS, _PARS, _LINES, _WORDS = (frozenset(x.split()) for x in ("ocr_carea ocrx_block", "ocr_par", "ocr_line ocrx_line", "ocr_word ocrx_word"))
LOGICAL = frozenset("ocr_" + x for x in "abstract author blockquote caption chapter display footer header pageno part section subsection subsubsection title".split())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node()
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in _EMPTY:
            a = {k: v or "" for k, v in attrs}
            props = {k: v.strip() for k, _, v in (x.strip().partition(" ") for x in a.get("title", "").split(";")) if k}
            node = Node(tag, frozenset(a.get("class", "").split()), props)
            self.open[-1].parts.append(node)
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        """Nothing to collect and nothing to open."""

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def read_hocr(raw: bytes, labels: tuple[str, ...] = ()) -> list[Page]:
    try:
        text = sniff(raw, "hOCR").decode()
    except UnicodeDecodeError as e:
        raise Refused(f"not hOCR: no UTF-8 text (byte {e.start})") from None
    if "<" in text[text.rfind(">") + 1 :]:
        raise Refused("not hOCR: the file ends inside unterminated markup, so it is truncated")
    tree = _Tree()
    tree.feed(text)
    tree.close()
    found = tree.root.outer(frozenset(["ocr_page"]))
    if not found:
        raise Refused("no ocr_page element: not hOCR")
    pages = []
    for p in found:
        page = Page(p.props.get("lpageno") or None)
        for b in p.outer(_BLOCKS) or p.outer(_PARS) or [p]:
            said = [x for x in (n.line() for n in b.outer(_LINES)) if x] or [x for x in [b.line()] if x]
            words = [n for n in b.all() if n.classes & _WORDS]
            sure = [v for w in words for v in number(w.props.get("x_wconf"))] or [v for w in words for c in w.props.get("x_confs", "").split() for v in number(c)]
            scale = 100 if sure and max(sure) > 1 else 1
            logical = sorted(c for n in (b, *b.all()) for c in n.classes if c in LOGICAL or c in labels)
            honoured = [c for c in dict.fromkeys(logical) if layer(c) != "unknown"]
            note = f"hOCR {' '.join(sorted(b.classes)) or b.tag or 'block'}; {_OCR}"
            if logical:
                note += f"; logical class declared ({' '.join(dict.fromkeys(logical))}) — " + (f"honored as {layer(honoured[0])}" if honoured else "not a critical-edition register")
            if said:
                page.blocks.append(Block(layer(honoured[0]) if honoured else "unknown", said, min(1.0, max(0.0, mean(sure) / scale)), note))
        pages.append(page)
    return pages


def _read(files: DataFrame, reader: Callable[[bytes, tuple[str, ...]], list[Page]], labels: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                blank = dict.fromkeys(_ARROW.names) | {"path": path}
                try:
                    pages = reader(content.encode() if isinstance(content, str) else content or b"", labels)
                except Refused as e:
                    rows.append(blank | {"refused": str(e)})
                    continue
                for p, page in enumerate(pages):
                    rows += [blank | {"page": p, "printed_page": page.printed, "block": i, "layer": x.layer, "text": "\n".join(x.lines), "source": "ocr", "generative": True, "confidence": x.confidence, "evidence": x.evidence} for i, x in enumerate(page.blocks)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.select("path", "content").mapInArrow(run, BLOCK)


def alto(files: DataFrame) -> DataFrame:
    return _read(files, read_alto, ())


def pagexml(files: DataFrame) -> DataFrame:
    return _read(files, read_page, ())


def hocr(files: DataFrame, labels: tuple[str, ...] = ()) -> DataFrame:
    """``labels``: further classes that are taken for declared layers."""
    return _read(files, read_hocr, labels)
