"""Chunkers: windows over tokens, splits by a mark, and heading-aware splits of markdown."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.tokenizers import Tokenizer, Words
from tessera.plans.staging import bound_batches

#: Headings, articles of laws, and a sentence's end before a capital (fixed patterns).
HEADING, ARTICLE = re.compile(r"^(#{1,6})\s+(.*)$"), re.compile(r"Điều\s+\d+")
#: A table's row and the rule under its header; the marks of list items within a line (fixed patterns).
TABLE_ROW, TABLE_RULE = re.compile(r"^\s*\|.*\|\s*$"), re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+\|?\s*$")
ITEM = re.compile(r"(?:^|[\s|])(?:[•●▪◦*+\-]|\d+\.)\s+")
SENTENCE = re.compile(r"(?<=[.?!])\s+(?=[A-ZĐÁÀẢÃẠÂẦẤẨẪẬĂẰẮẲẴẶÉÈẺẼẸÊỀẾỂỄỆÍÌỈĨỊÓÒỎÕỌÔỒỐỔỖỘƠỜỚỞỠỢÚÙỦŨỤƯỪỨỬỮỰÝỲỶỸỴ])")


def windows(text: str | None, size: int, overlap: int, tail: bool, tokenizer: Tokenizer) -> Iterator[tuple[int, str]]:
    """(tokens, content) of windows every size - overlap tokens; ``tail``: also the one that lies within the overlap of the last."""
    tokens = tokenizer.encode(text or "")
    step = size - min(overlap, size - 1)
    last = len(tokens) - 1 if tail else max(len(tokens) - 1 - (size - step), 0)
    for s in range(0, last + 1 if tokens else 0, step):
        part = tokens[s : s + size]
        yield len(part), tokenizer.decode(part).strip()


def _chunked(docs: DataFrame, key: str, text: str, cut: Callable[[str | None], Iterable[tuple[int, str]]]) -> DataFrame:
    """Rows (key, chunk_order_index, tokens, content): each text is read once, whatever the number of its chunks."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            at, nth, tokens, content = [], [], [], []
            for i, t in enumerate(batch.column(1)):
                for n, (count, said) in enumerate(cut(t.as_py())):
                    at.append(i), nth.append(n), tokens.append(count), content.append(said)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(nth, pa.int32()), pa.array(tokens, pa.int32()), pa.array(content, pa.string())], [key, "chunk_order_index", "tokens", "content"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, chunk_order_index int, tokens int, content string")


def window_chunks(docs: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text", tail: bool = True, tokenizer: Tokenizer = Words()) -> DataFrame:
    return _chunked(docs, key, text, lambda t: windows(t, size, overlap, tail, tokenizer))


def split_chunks(docs: DataFrame, mark: str, size: int, overlap: int, only: bool = False, key: str = "doc_id", text: str = "text", tokenizer: Tokenizer = Words()) -> DataFrame:
    """Pieces between marks (a regular expression), those over ``size`` windowed; with ``only``, these are an error."""

    def cut(t: str | None) -> Iterator[tuple[int, str]]:
        for piece in re.split(mark, t or ""):
            tokens = tokenizer.encode(piece)
            if len(tokens) <= size:
                yield len(tokens), tokenizer.decode(tokens).strip()
            elif only:
                raise ValueError(f"a piece exceeds the limit of tokens: {len(tokens)}")
            else:
                yield from windows(piece, size, overlap, True, tokenizer)

    return _chunked(docs, key, text, cut)


@dataclass
class Section:
    level: int
    path: list[str]
    lines: list[str] = field(default_factory=list)
    line: int = 1
    parent: bool = False


def sections(text: str) -> list[Section]:
    """Sections of a markdown text in order; ``parent`` marks those that hold others."""
    out, open_ = [Section(0, [])], [0]
    for number, line in enumerate(text.splitlines(), 1):
        m = HEADING.match(line)
        if not m:
            out[-1].lines.append(line)
            continue
        level = len(m[1])
        while out[open_[-1]].level >= level:
            open_.pop()
        above = out[open_[-1]]
        above.parent = True
        out.append(Section(level, [*above.path, m[2].strip()], line=number))
        open_.append(len(out) - 1)
    return out


def is_table(block: str) -> bool:
    rows = block.splitlines()
    return len(rows) >= 2 and bool(TABLE_ROW.match(rows[0]) and TABLE_RULE.match(rows[1]))


def blocks(text: str) -> list[str]:
    return [b.strip("\n") for b in re.split(r"\n\s*\n", text) if b.strip()]


@dataclass(frozen=True)
class Sizes:
    """Limits of a markdown split in tokens: of a child, of a table that stays whole, of a cell that does, of a pack of list items."""

    child: int = 256
    table: int = 256
    cell: int = 80
    items: int = 400
    tokenizer: Tokenizer = Words()

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode(text))

    def cut(self, text: str) -> list[str]:
        """Runs of as many tokens as a child has."""
        return [content for _, content in windows(text, self.child, 0, True, self.tokenizer) if content]


def packed(pieces: list[str], most: int, join: str, sizes: Sizes, whole: bool = False) -> Iterator[str]:
    """Pieces put together greedily while their tokens sum to ``most``; a longer one is cut, or stands by itself (``whole``)."""
    held, n = [], 0
    for p in pieces:
        own = sizes.count(p)
        if held and n + own > most:
            yield join.join(held).strip()
            held, n = [], 0
        if own > most and not whole:
            yield from sizes.cut(p)
        else:
            held.append(p)
            n += own
    if held:
        yield join.join(held).strip()


def list_items(cell: str) -> list[str]:
    """The items of a list that stands in a table's cell: from each mark on; where there are fewer than two, what semicolons part."""
    items = [x.strip() for x in ITEM.sub(lambda m: "\n" + m[0].lstrip(), cell).split("\n")]
    items = [x for x in items if ITEM.match(" " + x)]
    parts = [x for x in re.split(r"\s*;\s*", cell.strip()) if x] if len(items) < 2 else []
    return parts if len(parts) >= 2 else items


def cells_of(row: str) -> list[str]:
    return [c.strip() for c in row.strip().removeprefix("|").removesuffix("|").split("|")]


def table_pieces(prefix: str, table: str, sizes: Sizes) -> Iterator[str]:
    """A long table by rows under headings and header; a row with a long cell that holds a list by packs of its items. What is still too long is cut."""
    rows = table.splitlines()
    head, body = "\n".join(rows[:2]), [r for r in rows[2:] if r.strip()]
    if not body:
        yield (prefix + table).strip()
    for row in body:
        cells, made, most = cells_of(row), [row], max(sizes.child, sizes.items)
        for i, cell in enumerate(cells):
            items = list_items(cell) if sizes.count(cell) > sizes.cell else []
            if len(items) >= 2:
                made = ["| " + " | ".join([*cells[:i], pack, *cells[i + 1 :]]) + " |" for pack in packed(items, sizes.items, " ", sizes, whole=True)]
                most = max(sizes.child, 2 * sizes.items)
                break
        for piece in (f"{prefix}{head}\n{x}".strip() for x in made):
            yield from [piece] if sizes.count(piece) <= most else sizes.cut(piece)


def small_table(prefix: str, caption: str | None, table: str, sizes: Sizes) -> str:
    """A table in one piece under headings, and with the paragraph before it if both fit."""
    most = sizes.table + sizes.count(prefix)
    for said in ([f"{prefix}{caption}\n\n{table}"] if caption else []) + [prefix + table]:
        if sizes.count(said.strip()) <= most:
            return said.strip()
    return table.strip()


def markdown_parts(text: str, sizes: Sizes = Sizes()) -> Iterator[tuple[str, str, str | None, int]]:
    """(content, parent text, heading path, number of the parent) of a markdown text's leaf sections: a table ends a part; children carry their headings."""
    parent = -1
    for s in sections(text or ""):
        body = "\n".join(s.lines).strip()
        if s.parent or not body:
            continue
        prefix = "".join(f"{'#' * (i + 1)} {h}\n" for i, h in enumerate(s.path)) + ("\n" if s.path else "")
        path, said = " > ".join(s.path) or None, []
        parts: list[tuple[list[str], str | None]] = []
        for b in blocks(body):
            if is_table(b):
                parts.append((said, b))
                said = []
            else:
                said.append(b)
        if said:
            parts.append((said, None))
        for words, grid in parts:
            parent += 1
            whole = (prefix + "\n\n".join([*words, *([grid] if grid else [])])).strip()
            for piece in packed(words, sizes.child, "\n\n", sizes):
                yield (prefix + piece).strip(), whole, path, parent
            if grid and sizes.count(grid) <= sizes.table:
                yield small_table(prefix, words[-1] if words else None, grid, sizes), whole, path, parent
            elif grid:
                for piece in table_pieces(prefix, grid, sizes):
                    yield piece, whole, path, parent


def legal_route(text: Column) -> Column:
    """How a legal text is split: by articles at the beginning of a line, by second-level headings, by any heading or by paragraphs."""
    t = F.coalesce(text, F.lit(""))
    n = lambda p: F.size(F.regexp_extract_all(t, F.lit(p), F.lit(0)))
    return F.when(n(r"(?m)^Điều\s+\d+") >= 2, "articles").when(n("(?m)^## ") >= 3, "headings2").when(n(r"(?m)^#{1,6}\s+\S") >= 1, "headings").otherwise("paragraphs")


def _paragraphs(text: str) -> list[str]:
    return [p for p in re.split(r"\n\s*\n+", text) if p.strip()]


def _filled(pieces: Iterable[str], target: int, overlap: int = 0) -> list[str]:
    """Pieces joined by blank lines while their lengths sum to ``target``; each begins with the last ``overlap`` characters of the one before."""
    out, held = [], []
    for p in pieces:
        if held and sum(map(len, held)) + len(p) > target:
            out.append("\n\n".join(held))
            held = [out[-1][-overlap:]] if overlap else []
        held.append(p)
    return [*out, "\n\n".join(held)] if held else out


def legal_chunks(text: str, target: int = 1500, overlap: int = 200, most: int = 2500, least: int = 200) -> list[tuple[str, str | None, list[str], int]]:
    """(content, label, heading path, first line) of a legal text: split by its route; those over ``most`` characters are filled anew up to ``target``, those under ``least`` joined to the one before of equal label.

    What stands before the first article or heading has no label, as have windows of paragraphs, whose line is 0. An
    article's path is that of the headings above it, of any level."""
    lines, stack, paths = text.splitlines(), [], []
    for x in lines:  # the headings that each line is under, itself included
        h = HEADING.match(x)
        if h and h[2].strip():
            stack = [p for p in stack if p[0] < len(h[1])] + [(len(h[1]), h[2].strip())]
        paths.append(list(stack))
    headed = [i for i, x in enumerate(lines) if paths[i] and (i == 0 or paths[i] != paths[i - 1] or HEADING.match(x)) and HEADING.match(x)]
    articles = [i for i, x in enumerate(lines) if ARTICLE.match(x)]
    if len(articles) >= 2:
        cut, label = articles, lambda i: ARTICLE.match(lines[i])[0]
    else:
        deepest = 2 if sum(x.startswith("## ") for x in lines) >= 3 else 3
        cut, label = [i for i in headed if paths[i][-1][0] <= deepest], lambda i: paths[i][-1][1]
    raw: list[tuple[str, str | None, list[str], int]] = []
    if len(articles) >= 2 or headed:
        if cut:
            raw.append(("\n".join(lines[: cut[0]]).strip(), None, [t for _, t in paths[0]] if len(articles) >= 2 else [], 1))
        raw += [("\n".join(lines[a:b]).rstrip(), label(a), [t for _, t in paths[a]], a + 1) for a, b in zip(cut, [*cut[1:], len(lines)])]
    else:
        raw = [(w, None, [], 0) for w in _filled(map(str.strip, _paragraphs(text)), target, overlap)]
    out: list[tuple[str, str | None, list[str], int]] = []
    for body, name, heads, line in raw:
        pieces = _paragraphs(body) if len(body) > most else []
        if len(pieces) == 1:
            pieces = [x for x in SENTENCE.split(body) if x.strip()]
        for piece in _filled(pieces, target) if pieces else [body] if body.strip() else []:
            if out and len(piece) < least and out[-1][1] == name and len(out[-1][0]) + len(piece) <= most:
                out[-1] = (f"{out[-1][0].rstrip()}\n\n{piece.lstrip()}", *out[-1][1:])
            else:
                out.append((piece, name, heads, line))
    return out


def chunk_markdown(docs: DataFrame, key: str = "doc_id", text: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """Parent-child chunks of markdown texts; ids are hashes of document, place and content, so equal parents of a document are two."""

    def run(batches):
        for batch in batches:
            rows = ([], [], [], [], [], [], [])
            at = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                own = batch.column(0)[i].as_py()
                for n, (content, parent, path, nth) in enumerate(markdown_parts(t or "", sizes)):
                    at.append(i)
                    for column, x in zip(rows, (hashlib.md5(f"{own}:{n}:{content}".encode()).hexdigest(), content, hashlib.md5(f"{own}:{nth}:{parent}".encode()).hexdigest(), parent, n, sizes.count(content), path)):
                        column.append(x)
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(rows, kinds))], [key, "id", "content", "parent_id", "parent_text", "chunk_order_index", "tokens", "heading_path"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, id string, content string, parent_id string, parent_text string, chunk_order_index int, tokens int, heading_path string")


def chunk_legal(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches):
        for batch in batches:
            at, got = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for n, c in enumerate(legal_chunks(t or "")):
                    at.append(i)
                    got.append((n, *c))
            columns = list(zip(*got)) or [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32())))], [key, "ordinal", "content", "section_label", "heading_path", "start_line"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ordinal int, content string, section_label string, heading_path array<string>, start_line int")
