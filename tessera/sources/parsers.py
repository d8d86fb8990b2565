"""Documents to markdown: HTML, JSON, delimited text, plain text, EPUB and office packages.

Parsers run on Arrow batches of (name, bytes) and never fail a batch: a row that can't be parsed has an error instead of markdown.
Formats that need libraries outside the standard ones are hooks in ``register``.
"""

from __future__ import annotations

import csv
import html
import io
import json
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import extension
from tessera.sources.pdf import pdf_markdown

#: Encodings tried in turn (fixed order).
ENCODINGS = ("utf-8", "utf-16", "gb18030", "latin-1")


def decoded(data: bytes) -> str:
    if data.startswith((b"\xff\xfe", b"\xfe\xff")):
        return data.decode("utf-16", "replace")
    for name in ENCODINGS:
        if name != "utf-16":
            try:
                return data.decode(name)
            except UnicodeDecodeError:
                pass
    return data.decode("utf-8", "replace")


class _Markdown(HTMLParser):
    """Markdown of the elements that carry text; scripts, styles and comments are left out."""

    SKIP, BLOCK = {"script", "style", "noscript", "template", "head"}, {"p", "div", "section", "article", "header", "footer", "main", "nav", "aside", "ul", "ol", "blockquote", "body", "figure", "form"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.lists: list[int | None] = []
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None
        self.link: str | None = None
        self.pre = False

    def write(self, text: str) -> None:
        (self.out if self.cell is None else self.cell).append(text)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.SKIP:
            self.skip += 1
        elif self.skip:
            return
        elif re.fullmatch("h[1-6]", tag):
            self.write("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
            self.write("\n")
        elif tag == "li":
            depth = max(0, len(self.lists) - 1)
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
            mark = "-" if not self.lists or self.lists[-1] is None else f"{self.lists[-1]}."
            self.write("\n" + "  " * depth + mark + " ")
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows is not None:
            if not self.rows:
                self.rows.append([])
            self.cell = []
        elif tag == "pre":
            self.pre = True
            self.write("\n\n```\n")
        elif tag == "br":
            self.write("\n")
        elif tag == "a" and a.get("href"):
            self.link = a["href"]
            self.write("[")
        elif tag == "img":
            self.write(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag in self.BLOCK:
            self.write("\n\n")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.write("\n")
        elif tag in ("td", "th") and self.cell is not None and self.rows:
            self.rows[-1].append(re.sub(r"\s+", " ", "".join(self.cell)).strip())
            self.cell = None
        elif tag == "table" and self.rows is not None:
            rows, self.rows, self.cell = [r for r in self.rows if r], None, None
            self.write("\n\n" + table(rows) + "\n\n")
        elif tag == "pre":
            self.pre = False
            self.write("\n```\n\n")
        elif tag == "a" and self.link is not None:
            self.write(f"]({self.link})")
            self.link = None
        elif re.fullmatch("h[1-6]", tag) or tag in self.BLOCK:
            self.write("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.write(data if self.pre else re.sub(r"\s+", " ", data))


def table(rows: list[list[str]]) -> str:
    """A markdown table; short rows are padded and bars escaped."""
    if not rows:
        return ""
    width = max(map(len, rows))
    cells = [[c.replace("|", "\\|").replace("\n", " ") for c in r] + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in cells]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def html_markdown(data: bytes) -> str:
    p = _Markdown()
    p.feed(decoded(data))
    p.close()
    lines = [x.rstrip() for x in "".join(p.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x if x.startswith(" ") and x.strip().startswith(("-", "1")) else x.strip() if "```" in x else x.lstrip() for x in lines)).strip()


def json_markdown(data: bytes) -> str | tuple[str, dict]:
    """JSON, or JSON lines without those that aren't, whose number is noted, or the text as it is; fenced."""
    text = decoded(data)
    try:
        return "```json\n" + json.dumps(json.loads(text), indent=2, ensure_ascii=False) + "\n```"
    except ValueError:
        pass
    good, bad = [], 0
    for line in filter(str.strip, text.splitlines()):
        try:
            good.append(json.dumps(json.loads(line), ensure_ascii=False))
        except ValueError:
            bad += 1
    fenced = "```json\n" + ("\n".join(good) if good else text.strip()) + "\n```"
    return (fenced, {"skipped": bad}) if good and bad else fenced


def csv_markdown(data: bytes) -> str:
    return table([[c.strip() for c in r] for r in csv.reader(io.StringIO(decoded(data))) if any(c.strip() for c in r)])


def text_markdown(data: bytes) -> str:
    return decoded(data).strip()


def epub_markdown(data: bytes) -> str:
    book, parts = zipfile.ZipFile(io.BytesIO(data)), []
    root = next(e.get("full-path") for e in ElementTree.fromstring(book.read("META-INF/container.xml")).iter() if e.tag.endswith("rootfile"))
    package = ElementTree.fromstring(book.read(root))
    items = {e.get("id"): e.get("href") for e in package.iter() if e.tag.endswith("}item")}
    base = root.rpartition("/")[0]
    for ref in (e.get("idref") for e in package.iter() if e.tag.endswith("}itemref")):
        try:
            parts.append(html_markdown(book.read(f"{base}/{items[ref]}" if base else items[ref])))
        except (KeyError, TypeError):  # a spine entry without its file is left out
            continue
    return "\n\n---\n\n".join(p for p in parts if p)


def _office(data: bytes, name: str):
    return ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read(name))


def docx_markdown(data: bytes) -> str:
    w, out = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", []
    for e in _office(data, "word/document.xml").find(f"{w}body"):
        if e.tag == f"{w}p":
            said = "".join(t.text or "" for t in e.iter(f"{w}t")).strip()
            style = next((s.get(f"{w}val") or "" for s in e.iter(f"{w}pStyle")), "")
            level = re.fullmatch(r"Heading(\d)", style)
            mark = "# " if style == "Title" else "#" * int(level[1]) + " " if level else "- " if style.startswith("ListBullet") else "1. " if style.startswith("ListNumber") else "> " if "Quote" in style else ""
            if said:
                out.append(f"*{said}*" if style == "Caption" else mark + said)
        elif e.tag == f"{w}tbl":
            rows = [["".join(t.text or "" for t in c.iter(f"{w}t")).strip() for c in r.iter(f"{w}tc")] for r in e.iter(f"{w}tr")]
            out.append(table([r[: len(rows[0])] for r in rows]))
    return "\n\n".join(out)


def xlsx_markdown(data: bytes) -> str:
    s, book, out = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", zipfile.ZipFile(io.BytesIO(data)), []
    strings = ["".join(t.text or "" for t in e.iter(f"{s}t")) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
    parts = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in book.namelist() else {}
    related = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    for i, e in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{s}sheet")):
        name, part, rows = e.get("name"), parts.get(e.get(related), f"worksheets/sheet{i + 1}.xml"), []
        for r in ElementTree.fromstring(book.read(part[1:] if part.startswith("/") else f"xl/{part}")).iter(f"{s}row"):
            cells: list[str] = []
            for c in r.iter(f"{s}c"):
                letters = re.match("[A-Z]+", c.get("r") or "A")[0]
                at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1
                value = next((v.text or "" for v in c.iter(f"{s}v")), "".join(t.text or "" for t in c.iter(f"{s}t")))
                cells += [""] * (at - len(cells)) + [strings[int(value)] if c.get("t") == "s" and value else value]
            if any(x.strip() for x in cells):
                rows.append(cells)
        if rows:
            out.append(f"## {name}\n\n{table(rows)}")
    return "\n\n".join(out)


def pptx_markdown(data: bytes) -> str:
    a, p = "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/presentationml/2006/main}"
    book, out = zipfile.ZipFile(io.BytesIO(data)), []
    slides = sorted((n for n in book.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    for i, name in enumerate(slides, 1):
        shapes, title = [], ""
        for s in ElementTree.fromstring(book.read(name)).iter(f"{p}sp"):
            said = "\n".join(x for x in ("".join(t.text or "" for t in q.iter(f"{a}t")).strip() for q in s.iter(f"{a}p")) if x)
            off = next(s.iter(f"{a}off"), None)
            kind = next((h.get("type") for h in s.iter(f"{p}ph")), None)
            if kind in ("title", "ctrTitle"):
                title = said
            elif said:
                shapes.append((int(off.get("y")) // 10 if off is not None else 0, int(off.get("x")) if off is not None else 0, said))
        out.append("\n\n".join([f"## Slide {i}: {title}".rstrip(": "), *(x[2] for x in sorted(shapes))]))
    return "\n\n".join(out)


_PARSERS: dict[str, Callable[[bytes], str | tuple[str, dict]]] = {}


def register(parser: Callable[[bytes], str], *extensions: str) -> None:
    """A parser for extensions; layout and image formats come in this way."""
    _PARSERS.update({e.lower(): parser for e in extensions})


register(html_markdown, "html", "htm", "xhtml")
register(json_markdown, "json", "jsonl", "ndjson")
register(csv_markdown, "csv")
register(text_markdown, "txt", "log", "rst", "md", "markdown")
register(epub_markdown, "epub")
register(docx_markdown, "docx")
register(xlsx_markdown, "xlsx")
register(pptx_markdown, "pptx")
register(pdf_markdown, "pdf")


def known() -> set[str]:
    """Extensions that have a parser."""
    return set(_PARSERS)


def parse(files: DataFrame, name: str = "path", content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """name, markdown, parser, error and notes (JSON of what a parser left out) of each file, by its extension, beside the columns ``keep``."""
    parsers = dict(_PARSERS)

    def run(batches):
        for batch in batches:
            out = ([], [], [], [])
            for _, kind, data in zip(*(c.to_pylist() for c in batch.columns[:3])):
                try:
                    said = parsers[kind](data or b"") if kind in parsers else None
                    said, notes = said if isinstance(said, tuple) else (said, None)
                    row = said, kind if kind in parsers else None, None if kind in parsers else f"unsupported: {kind}", notes and json.dumps(notes)
                except Exception as e:  # a damaged file is that row's error
                    row = None, kind, f"{type(e).__name__}: {e}", None
                for column, x in zip(out, row):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in out), *batch.columns[3:]], ["name", "markdown", "parser", "error", "notes", *keep])

    kept = "".join(f", `{c}` {files.schema[c].dataType.simpleString()}" for c in keep)
    return files.select(F.col(name).alias("name"), extension(F.col(name)).alias("kind"), F.col(content).cast("binary").alias("data"), *keep).mapInArrow(run, "name string, markdown string, parser string, error string, notes string" + kept)


def page_class(text: Column, image_share: Column, least_words: int = 20, image_from: float = 0.5) -> Column:
    """TEXT, IMAGE or SPARSE: few different words count as none, much junk or image is IMAGE."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")
    unique = F.try_divide(F.size(F.array_distinct(words)), F.size(words))
    n = F.when(unique < 0.30, 0).otherwise(F.size(words))
    length = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", ""))
    junk = F.try_divide(F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{L}\p{N}\p{P}\s]", "")), length)
    return F.when(F.coalesce(junk, F.lit(0.0)) > 0.30, "IMAGE").when(n >= least_words, "TEXT").when(image_share >= image_from, "IMAGE").otherwise("SPARSE")


def document_mode(pages: DataFrame, doc: str, label: str, least: float = 0.8) -> DataFrame:
    """TEXT for documents of which 80 % or more of the pages are text, else HYBRID."""
    share = F.avg((F.col(label) == "TEXT").cast("double"))
    return pages.groupBy(doc).agg(share.alias("_share")).select(doc, F.round("_share", 6).alias("text_share"), F.when(F.col("_share") >= least, "TEXT").otherwise("HYBRID").alias("mode"))


def unescaped(text: str) -> str:
    return html.unescape(text)
