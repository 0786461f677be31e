"""Documents in several formats as blocks (text, section, page, kind).

JSON formats are parsed by Spark itself. HTML, TEI, JATS and DOCX go through small event readers over the standard
library, a document a row in Arrow batches. A document that can't be parsed has an `error` and no blocks, so one bad file
doesn't end a job: `parsed` gives the blocks, and `failures` the rows to set aside. Null and blank documents have no block.
"""

from __future__ import annotations

import io
import re
import zipfile
from html.entities import html5
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.exports import export_blocks
from foliant.operators.headings import Headings, squeezed

BLOCKS = "struct<blocks:array<struct<text:string,section:string,page_start:int,page_end:int,kind:string,images:array<string>>>,error:string>"
PAGED = "struct<version:int,blocks:array<struct<text:string,section:string,pageStart:int,pageEnd:int,kind:string>>>"
LISTED = "array<struct<type:string,text:string,text_level:int,page_idx:int>>"

# Elements whose content isn't shown; that are a block each; that end a block; without content; whose end tag may be left out; that are no text.
HIDDEN = {"head", "script", "style", "nav", "footer", "aside", "form", "button", "noscript", "svg", "math", "template"}
LEAVES = {"p", "li", "pre", "blockquote", "dt", "dd", "td", "th", "figcaption"}
BREAKS = LEAVES | {"div", "section", "article", "main", "body", "ul", "ol", "dl", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "col", "area", "base", "embed", "source", "track"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
SKIPPED = {"ref-list", "ack", "fn-group", "listBibl", "figure", "formula", "table", "note", "table-wrap", "fig", "disp-formula"}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[tuple[tuple[int, int], str | None, str]] = []  # (rank and number of the root, section, text)
        self.headings, self.held, self.stack, self.hidden, self.level, self.title = Headings(), "", [], 0, 0, ""
        self.roots, self.met = {"main": 0, "article": 0}, {"main": 0, "article": 0}

    def rank(self) -> tuple[int, int]:
        return (2, self.met["main"]) if self.roots["main"] else (1, self.met["article"]) if self.roots["article"] else (0, 0)

    def flush(self) -> None:
        kept = self.held.strip("\n") if "pre" in self.stack else squeezed(self.held)
        if kept.strip() and not self.hidden:
            self.parts.append((self.rank(), self.headings.path(), kept))
        self.held = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if self.stack and ((self.stack[-1] == "p" and tag in BREAKS and tag != "br") or self.stack[-1] in CLOSED_BY.get(tag, ())):
            self.handle_endtag(self.stack[-1])  # an end tag that may be left out
        if self.hidden or tag in HIDDEN or "hidden" in a or a.get("aria-hidden") == "true":
            if tag not in VOID:
                self.flush() if not self.hidden and tag in BREAKS | HIDDEN else None
                self.hidden += 1
                self.stack.append(tag)
            return
        if tag in BREAKS and tag != "br":
            self.flush()
        if tag == "br":
            self.held += "\n"
        if re.fullmatch(r"h[1-6]", tag):
            self.level, self.title = int(tag[1]), ""
        if tag in self.roots:
            self.met[tag] += not self.roots[tag]
            self.roots[tag] += 1
        if tag not in VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.stack:
            return
        while self.stack:
            top = self.stack[-1]
            if self.hidden:
                self.hidden -= 1
            elif re.fullmatch(r"h[1-6]", top):
                self.headings.open(self.level, squeezed(self.title))
                self.level = 0
            elif top in BREAKS:
                self.flush()
            self.stack.pop()
            if top in self.roots and not self.hidden:
                self.roots[top] = max(0, self.roots[top] - 1)
            if top == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if self.level:
            self.title += data
        else:
            self.held += data


def html_blocks(source: str) -> list[tuple[str, str | None]]:
    """The first main, else the first article, else the body; headings set the section and are no blocks."""
    page = _Page()
    page.feed(source)
    page.close()
    page.flush()
    kind = max((r[0] for r, _, _ in page.parts), default=0)
    first = min((r for r, _, _ in page.parts if r[0] == kind), default=(0, 0))
    return [(t, s) for r, s, t in page.parts if r == first]


def _parsed(source: str, doctype: bool = False) -> ElementTree.Element:
    """The root; named characters are those of HTML. A document type is dropped where the format has one, entities of its own are refused."""
    if "<!ENTITY" in source or ("<!DOCTYPE" in source and not doctype):
        raise ValueError("document types and entities aren't allowed")
    source = re.sub(r"<!DOCTYPE[^\[>]*(?:\[[^\]]*\]\s*)?>", "", source)
    known = {"amp", "lt", "gt", "quot", "apos"}
    source = re.sub(r"&([A-Za-z][A-Za-z0-9]*);", lambda m: m[0] if m[1] in known else html5.get(m[1] + ";", m[0]), source)
    root = ElementTree.fromstring(source)
    if sum(1 for _ in root.iter()) > 200_000:
        raise ValueError("too many elements")
    return root


def _local(node: ElementTree.Element) -> str:
    return node.tag.rsplit("}", 1)[-1] if isinstance(node.tag, str) else ""


def _text(node: ElementTree.Element) -> str:
    def shown(at: ElementTree.Element):
        yield at.text or ""
        for kid in at:
            if _local(kid) not in SKIPPED:
                yield from shown(kid)
            yield kid.tail or ""

    return squeezed("".join(shown(node)))


def coordinate_pages(coords: str | None) -> tuple[int | None, int | None]:
    """First and last page of `page,x,y,w,h;…`; a malformed box is an error."""
    if not coords:
        return None, None
    pages = []
    for box in coords.strip().rstrip(";").split(";"):
        parts = box.split(",")
        if len(parts) != 5 or not parts[0].strip().isdigit() or int(parts[0]) < 1:
            raise ValueError("malformed coordinates")
        [float(p) for p in parts[1:]]
        pages.append(int(parts[0]))
    return min(pages), max(pages)


Block = tuple[str, str | None, int | None, int | None]


def _walked(root: ElementTree.Element, heading: str, division: str, path: tuple[str, ...] = (), joins: bool = False) -> list[Block]:
    """The paragraphs below a node, with the titles of their divisions; with `joins`, neighbours of one division and page are one block."""
    out: list[Block] = []

    def walk(node: ElementTree.Element, path: tuple[str, ...], depth: int) -> None:
        if depth > 128:
            raise ValueError("nested too deeply")
        here, last = path, False
        for kid in node:
            name = _local(kid)
            if name in SKIPPED or (name == division and kid.get("type") in ("references", "acknowledgement")):
                continue
            if name == heading:
                here = (*path, _text(kid)) if _text(kid) else path
            elif name == "p":
                if t := _text(kid):
                    pages = coordinate_pages(kid.get("coords")) if joins else (None, None)
                    if joins and last and out[-1][2:] == pages:
                        out[-1] = (out[-1][0] + "\n\n" + t, *out[-1][1:])
                    else:
                        out.append((t, " / ".join(here) or None, *pages))
                    last = True
            else:
                walk(kid, here, depth + 1)
                last = False

    walk(root, path, 0)
    return out


def tei_blocks(source: str) -> list[Block]:
    """The abstract, the body, and appendices; pages by coordinates. Without a paragraph in the body it is an error."""
    root = _parsed(source)
    if root.tag != "{http://www.tei-c.org/ns/1.0}TEI":
        raise ValueError("no TEI document")
    find = lambda name: [n for n in root.iter() if _local(n) == name]
    out: list[Block] = []
    for part in find("abstract"):
        out += _walked(part, "head", "div", ("Abstract",), True) or ([(_text(part), "Abstract", None, None)] if _text(part) else [])
    body = [b for part in find("body") for b in _walked(part, "head", "div", (), True)]
    if not body:
        raise ValueError("no paragraph")
    for part in find("back"):
        for kid in part.iter():
            if _local(kid) == "div" and kid.get("type") in ("appendix", "annex"):
                body += _walked(kid, "head", "div", (), True)
    return out + body


def jats_blocks(source: str) -> list[Block]:
    """The abstract and the sections of the body."""
    root = _parsed(source, doctype=True)
    if _local(root) != "article":
        raise ValueError("no article")
    out = [b for n in root.iter() if _local(n) == "abstract" for b in _walked(n, "title", "sec", ("Abstract",))]
    out += [b for n in root.iter() if _local(n) == "body" for b in _walked(n, "title", "sec")]
    if not out:
        raise ValueError("no paragraph")
    return out


def plain_blocks(source: str) -> list[Block]:
    """The whole text as one block."""
    if "\x00" in source:
        raise ValueError("no text")
    return [(source, None, None, None)] if source.strip() else []


def docx_blocks(source: bytes) -> list[tuple[str, str | None]]:
    """Paragraphs; headings by their outline level are blocks too. Deleted, hidden and drawn runs are left out."""
    with zipfile.ZipFile(io.BytesIO(source)) as z:
        if sum(i.file_size for i in z.infolist()) > 256 << 20:
            raise ValueError("too large")
        body = _parsed(z.read("word/document.xml").decode())
        levels = {}
        if "word/styles.xml" in z.namelist():
            for style in _parsed(z.read("word/styles.xml").decode()).iter():
                for o in style.iter() if _local(style) == "style" else ():
                    if _local(o) == "outlineLvl":
                        levels[next(v for k, v in style.attrib.items() if k.endswith("styleId"))] = int(next(iter(o.attrib.values()))) + 1
    out, open_ = [], Headings()
    for p in body.iter():
        if _local(p) != "p":
            continue
        level, text = 0, []
        for style in p.iter():
            if _local(style) == "pStyle":
                name = next(iter(style.attrib.values()))
                built_in = re.fullmatch(r"[Hh]eading ?([1-6])", name)
                level = levels.get(name, int(built_in[1]) if built_in else 0)
        for own in p.iter():
            if _local(own) == "outlineLvl" and (n := int(next(iter(own.attrib.values())))) < 6:
                level = n + 1
        gone = {id(t) for d in p.iter() if _local(d) in ("del", "drawing", "instrText") for t in d.iter()}
        for run in p.iter():
            if _local(run) == "r" and id(run) not in gone and not any(_local(v) == "vanish" and next(iter(v.attrib.values()), "true") not in ("false", "0", "off") for v in run.iter()):
                text += [t.text or "" for t in run.iter() if _local(t) == "t" and id(t) not in gone]
        words = squeezed("".join(text))
        if words and level:
            open_.open(level, words)
        if words:
            out.append((words, open_.path()))
    return out


READERS = {
    "html": html_blocks,
    "grobid-tei": tei_blocks,
    "jats": jats_blocks,
    "docx": docx_blocks,
    "text": plain_blocks,
    "mineru": export_blocks,
}
NAMES = ("text", "section", "page_start", "page_end", "kind", "images")


def _read(source: str | bytes | None, name: str) -> dict:
    """The blocks of one document, or the error; stored bytes are UTF-8, but for a format that is binary."""
    try:
        if isinstance(source, bytes) and name != "docx":
            source = source.decode("utf-8-sig")
        got = READERS[name](source) if source else []
        return {"blocks": [dict(zip(NAMES, (*b, *(None, None, "", [])[len(b) - 2 :]))) for b in got], "error": None}
    except Exception as e:  # noqa: BLE001 - a bad document is a row, not a failed job
        return {"blocks": [], "error": f"{type(e).__name__}: {e}"[:200]}


def reader(name: str):
    """A column function: the blocks of each document, or the error."""

    @F.pandas_udf(BLOCKS)
    def run(sources: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_read(s, name) for s in sources], columns=["blocks", "error"])

    return run


def read_any(source: str, name: str) -> Column:
    """The same over two columns, stored bytes and their formats, in one pass; a format without a reader is an error."""

    @F.pandas_udf(BLOCKS)
    def run(sources: pd.Series, names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_read(s, n) for s, n in zip(sources, names)], columns=["blocks", "error"])

    return run(source, name)


def parsed(df: DataFrame, key: str, source: str, name: str) -> DataFrame:
    """(key, block_ord, text, section, page_start, page_end, kind, images) of one format."""
    return df.withColumn("__b", reader(name)(F.col(source))).select(key, F.posexplode("__b.blocks").alias("block_ord", "b")).select(key, "block_ord", "b.*")


def failures(df: DataFrame, key: str, source: str, name: str) -> DataFrame:
    """(key, error) of the documents that couldn't be parsed."""
    return df.select(key, reader(name)(F.col(source))["error"].alias("error")).filter("error IS NOT NULL")


def paged_blocks(source: Column) -> Column:
    """Explicit blocks of version 1; both pages or neither, from 1 on, in order."""
    doc = F.from_json(source, PAGED)
    good = lambda b: b["text"].isNotNull() & (F.trim(b["text"]) != "") & (b["pageStart"].isNull() == b["pageEnd"].isNull()) & (b["pageStart"].isNull() | ((b["pageStart"] >= 1) & (b["pageEnd"] >= b["pageStart"])))
    return F.when(doc["version"] == 1, F.filter(doc["blocks"], good))


def listed_blocks(df: DataFrame, key: str, source: str) -> DataFrame:
    """A content list: pages count from 0, levelled texts are headings (of one open level each), the rest blocks under them."""
    from pyspark.sql import Window

    items = df.select(key, F.posexplode(F.from_json(F.col(source), LISTED)).alias("block_ord", "i")).filter(F.trim("i.text") != "")
    order = Window.partitionBy(key).orderBy("block_ord")
    section = F.last(F.when(F.col("i.text_level") >= 1, F.col("i.text")), ignorenulls=True).over(order)
    return items.select(key, "block_ord", F.col("i.text").alias("text"), section.alias("section"), (F.col("i.page_idx") + 1).alias("page"), (F.coalesce("i.text_level", F.lit(0)) >= 1).alias("is_heading"))


def detected(path: Column, start: Column) -> Column:
    """The format by suffix, then by the first element of XML, else text."""
    low = F.lower(path)
    root = F.regexp_extract(start, r"<(?:\w+:)?([A-Za-z]+)[\s>/]", 1)
    by_suffix = F.when(low.rlike(r"\.(md|markdown)$"), "markdown").when(low.rlike(r"\.html?$"), "html").when(low.rlike(r"\.docx$"), "docx").when(low.rlike(r"content_list(_v2)?\.json$|\.mineru\.json$"), "mineru").when(low.rlike(r"scan\.json$"), "paged-text")
    return F.coalesce(by_suffix, F.when(root == "TEI", "grobid-tei").when(root == "article", "jats"), F.lit("text"))
