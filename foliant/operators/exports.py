"""JSON exports of page converters, in four dialects, as blocks; and their spans by page.

Flat lists of items (`text`, `page_idx` from 0), lists of pages' lists with nested `content` (their order is no page
number), paged documents (`pages` with `blocks`), and paged documents of lines and spans (`pdf_info` with
`para_blocks`). Reading an item is a small helper; documents are rows of Arrow batches (`formats.reader`), and spans are
cut by Spark itself.

Defined results: figures, tables and code have a `kind`; a heading that ends as a sentence does is text; lists of
references, page furniture and unknown types are left out, and so is all below a heading of references; a figure without
text leaves its image with the block before it. Malformed pages, levels, schemas and trailing text are errors.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.headings import REFERENCES, Headings, squeezed

# Types of formulas with their marks; of prose; of floats with their kinds; the schema and version that is read.
MATH = {"inline_equation": "$", "equation_inline": "$", "interline_equation": "$$", "equation_interline": "$$"}
TITLES = {"title", "doc_title", "paragraph_title"}
PROSE = TITLES | {"text", "paragraph"}
DISPLAYED = {"equation", "equation_interline", "interline_equation"}
FLOATS = {"image": "figure", "chart": "figure", "table": "table", "code": "code", "algorithm": "code"}
SCHEMA, VERSION = "docvortex.middle", "2.0"
MOST_PAGES = 1_000_000
# Fixed value: a heading that is only a number, as `A.` or `2.1.`.
LABEL = re.compile(r"(?:[0-9]+|[A-Z]|[IVXLC]+)(?:\.[0-9]+)*\.")

Export = tuple[str, str | None, int | None, int | None, str, list[str]]


def spoken(node: object) -> str:
    """The text of any JSON: lists are joined, formulas marked, objects of other types silent."""
    if isinstance(node, str):
        return node
    if isinstance(node, list):
        return "".join(spoken(n) for n in node)
    if isinstance(node, dict):
        kind = node.get("type") or "text"
        said = spoken(node.get("content")) if kind == "text" or kind in MATH else ""
        return f" {MATH[kind]}{said}{MATH[kind]} " if said and kind in MATH else said
    return ""


def _dicts(node: object) -> list[dict]:
    return [n for n in node if isinstance(n, dict)] if isinstance(node, list) else []


def lined(item: dict) -> str:
    """The spans of an item's lines, a line each, and of the items in it."""
    return "\n".join([spoken(line.get("spans")) for line in _dicts(item.get("lines"))] + [lined(b) for b in _dicts(item.get("blocks"))])


class _Cells(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.open = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.rows.append([])
            self.open = False
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append("")
            self.open = True

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr"):
            self.open = False

    def handle_data(self, data: str) -> None:
        if self.open:
            self.rows[-1][-1] += data


def table_text(source: str) -> str:
    """Rows as lines, cells apart by ` | `; without rows the bare text."""
    cells = _Cells()
    cells.feed(source)
    cells.close()
    if not cells.rows:
        return html.unescape(re.sub(r"<[^>]*>", " ", source))
    return "\n".join(" | ".join(squeezed(c) for c in row) for row in cells.rows)


def _float_text(item: dict, name: str) -> str:
    inner = item["content"] if isinstance(item.get("content"), dict) else item
    fields = [f"{name}_caption", *{"code": ["code_body", "code_content"], "table": ["table_body", "html"]}.get(name, []), f"{name}_footnote"]
    said = []
    for field in fields:
        value = inner.get(field)
        if field in ("table_body", "html"):
            said += [table_text(value)] if isinstance(value, str) else []
        elif isinstance(value, (str, list)):
            said += [value] if isinstance(value, str) else [spoken(v) for v in value]
    text = "\n".join(said)
    return text if text.strip() else lined(item)


def _listed(item: dict) -> str:
    inner = item.get("content")
    if not isinstance(inner, dict):
        return "\n".join(spoken(v) for v in item.get("list_items") or [])
    if inner.get("list_type") == "reference_list":
        return ""
    return "\n".join(spoken(v.get("item_content")) for v in _dicts(inner.get("list_items")))


def _whole(value: object) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def item_text(item: dict) -> tuple[str, str, int, str]:
    """(text, kind, level, image) of one item; no text for what isn't read."""
    name, inner = item.get("type"), item.get("content") if isinstance(item.get("content"), dict) else {}
    if name in PROSE:
        text = spoken(inner.get("title_content" if name == "title" else "paragraph_content")) if inner else spoken(item.get("text")) or spoken(item.get("content"))
        levels = [n for n in map(_whole, (inner.get("level"), item.get("text_level"), item.get("level"))) if n is not None]
        level = levels[-1] if levels else 0
        return squeezed(text or lined(item)), "", max(level, 1) if name in TITLES else level, ""
    if name == "list":
        return squeezed(_listed(item)), "", 0, ""
    if name in DISPLAYED:
        formula = spoken(inner.get("math_content"))
        return squeezed(f"$${formula}$$" if formula else spoken(item.get("text")) or lined(item)), "", 0, ""
    if name in FLOATS:
        kind = FLOATS[name]
        text = _float_text(item, "code" if kind == "code" else name)
        source = inner.get("image_source")
        image = source.get("path") if isinstance(source, dict) else item.get("img_path")
        lines = [squeezed(t) for t in text.split("\n")] if kind == "table" else [squeezed(text)]
        return "\n".join(t for t in lines if t), kind, 0, image if isinstance(image, str) and kind != "code" else ""
    return "", "", 0, ""


def _page(value: object) -> int:
    at = _whole(value)
    if at is None or not 0 <= at <= MOST_PAGES:
        raise ValueError("not a page index")
    return at + 1


def _items(found: object, page: int | None) -> Iterator[tuple[dict, int | None]]:
    if isinstance(found, dict):
        yield found, _page(found["page_idx"]) if "page_idx" in found else page
    elif isinstance(found, list):
        for f in found:
            yield from _items(f, page)
    else:
        raise ValueError("an item is neither an object nor a list")


def _paged(root: dict) -> Iterator[tuple[dict, int | None]]:
    if root.get("schema") and (root["schema"] != SCHEMA or root.get("schema_version") != VERSION):
        raise ValueError("unknown schema or version")
    pages, key = (root["pages"], "blocks") if isinstance(root.get("pages"), list) else (root.get("pdf_info"), "para_blocks")
    if not isinstance(pages, list) or len(_dicts(pages)) < len(pages):
        raise ValueError("no list of pages")
    numbers = [_page(p.get("page_idx")) for p in pages]
    if len(set(numbers)) < len(numbers):
        raise ValueError("a page twice")
    for number, page in zip(numbers, pages):
        if not isinstance(page.get(key), list):
            raise ValueError("a page without blocks")
        yield from _items(page[key], number)


def export_blocks(source: str) -> list[Export]:
    """The blocks of an export of any dialect."""
    root = json.loads(source)
    if not isinstance(root, (list, dict)):
        raise ValueError("neither a list nor a document")
    out: list[Export] = []
    headings = Headings()
    for item, page in _items(root, None) if isinstance(root, list) else _paged(root):
        text, kind, level, image = item_text(item)
        if level > 6:
            raise ValueError("a heading below level 6")
        if text and level > 0 and not (text.endswith((".", "。")) and not LABEL.fullmatch(text)):
            headings.open(level, text)
        if any(t.lower() in REFERENCES for t in headings.titles()):
            continue
        if text:
            out.append((text, headings.path(), page, page, kind, [image] if image else []))
        elif image and out:
            out[-1][5].append(image)
    if not out:
        raise ValueError("no text")
    return out


_LINES = "lines:array<struct<spans:array<struct<content:string,html:string,cross_page:boolean>>>>"
SPANS = f"struct<pdf_info:array<struct<page_idx:int,para_blocks:array<struct<{_LINES},blocks:array<struct<{_LINES},blocks:array<struct<{_LINES}>>>>>>>>>"


def spans(df: DataFrame, key: str, source: str) -> DataFrame:
    """(key, at, page, text) of a document of lines and spans: a span marked as crossing stands on the next page. Items
    within items are read two levels deep, as the format has them. Other dialects have no rows."""
    page = df.select(key, F.posexplode(F.from_json(F.col(source), SPANS)["pdf_info"]).alias("a", "p")).filter("p.page_idx >= 0")
    block = page.select(key, "a", (F.col("p.page_idx") + 1).alias("page"), F.posexplode("p.para_blocks").alias("b", "x"))

    def gathered(items: Column, field: str) -> Column:
        return F.flatten(F.filter(F.transform(items, lambda i: i[field]), lambda f: f.isNotNull()))

    inner = F.filter(F.array("x.blocks"), lambda i: i.isNotNull())
    below = F.flatten(inner)
    own = F.flatten(F.filter(F.array("x.lines"), lambda i: i.isNotNull()))
    every = F.concat(own, gathered(below, "lines"), gathered(gathered(below, "blocks"), "lines"))
    line = block.select(key, "a", "b", "page", F.posexplode(gathered(every, "spans")).alias("c", "s"))
    text = F.concat_ws(" ", "s.content", "s.html")
    number = F.col("page") + F.coalesce(F.col("s.cross_page"), F.lit(False)).cast("int")
    return line.select(key, F.struct("a", "b", "c").alias("at"), number.alias("page"), text.alias("text")).filter(F.col("text").rlike(r"\S"))
