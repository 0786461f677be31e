"""Chunking: sentence units, chunks by buffer, chunks by meaning.

Units and folds are small helpers over one text; blocks, unit texts, vectors and neighbour similarities are rows and
columns of Spark, so that texts are embedded once, as a stage of their own, and similarities are a window.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import WIDE, token_estimate
from foliant.operators.vectors import cosine


@dataclass(frozen=True)
class Limits:
    """Tokens of a chunk: least, target and most by meaning, most of a unit; target, most and overlap by buffer."""

    least: int = 120
    target: int = 280
    most: int = 420
    unit: int = 140
    buffer_target: int = 180
    buffer_most: int = 240
    overlap: int = 30

    def __post_init__(self) -> None:
        if not 0 < self.least <= self.target <= self.most or not 0 < self.unit <= self.most or not 0 <= self.overlap < self.buffer_target <= self.buffer_most:
            raise ValueError("limits out of order")


_WIDE = re.compile(f"[{WIDE}]")
_END = re.compile(r"[。！？]|[.!?](?=\s)|\n+")
# Formulas that no cut divides: displayed ones of up to 4096 characters, inline ones of up to 512 on a line.
_MATH = re.compile(r"(?<!\\)\$\$(?:(?!\n\s*\n|\$\$).){1,4096}?\$\$|(?<![\\$])\$(?![\s$])(?:\\.|[^$\n\\]){1,512}\$", re.S)


def estimate(text: str) -> int:
    wide = len(_WIDE.findall(text))
    return max(1, wide + (len(text) - wide + 3) // 4)


def _formulas(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _MATH.finditer(text)] if "$" in text else []


def _inside(spans: list[tuple[int, int]], at: int) -> tuple[int, int] | None:
    k = bisect_right(spans, (at, len(spans) and spans[-1][1] + 1)) - 1
    return spans[k] if k >= 0 and spans[k][0] < at < spans[k][1] else None


def hard_cuts(text: str, start: int, end: int, most: int, spans: list[tuple[int, int]], at_blank: bool = False) -> Iterator[tuple[int, int]]:
    """Longest pieces of at most `most` tokens; a formula moves to the next piece whole, and may overrun only alone."""
    while start < end:
        low, high = start + 1, min(end, start + 4 * most + 4)
        if high == end and estimate(text[start:end]) <= most:
            yield start, end
            return
        while low < high:  # the furthest end that fits
            mid = (low + high + 1) // 2
            low, high = (mid, high) if estimate(text[start:mid]) <= most else (low, mid - 1)
        cut = low
        blank = text.rfind(" ", start, cut)
        if at_blank and blank > start + (cut - start) // 2:
            cut = blank + 1
        if span := _inside(spans, cut):
            cut = span[0] if span[0] > start else min(span[1], end)
        yield start, cut
        start = cut


def units_of(text: str, most: int) -> list[tuple[int, int]]:
    """Sentences and lines with the white space behind them, none over `most` tokens; formulas stay whole."""
    spans, out, start = _formulas(text), [], 0
    for m in _END.finditer(text):
        if _inside(spans, m.start() + 1) or m.start() < start:
            continue
        end = m.end()
        if text[m.start()] != "\n":
            while end < len(text) and text[end].isspace() and text[end] != "\n":
                end += 1
        out.append((start, end))
        start = end
    out.append((start, len(text)))
    cut = [p for a, b in out for p in hard_cuts(text, a, b, most, spans, at_blank=True)]
    kept: list[tuple[int, int]] = []
    for a, b in cut:  # blank stretches go with the unit before them
        if text[a:b].strip():
            kept.append((a, b))
        elif kept:
            kept[-1] = kept[-1][0], b
    return kept


def unit_rows(blocks: DataFrame, key: list[str], text: str = "text", most: int = Limits.unit) -> DataFrame:
    """A row a unit: key, unit_no, start, end, line (line ends before it), unit, tokens."""
    kind = "array<struct<start:int,end:int,line:int>>"

    def placed(text: str) -> list[dict]:
        out, at, line = [], 0, 0
        for a, b in units_of(text, most):
            line += text.count("\n", at, a)
            out.append({"start": a, "end": b, "line": line})
            at = a
        return out

    @F.pandas_udf(kind)
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([placed(t) if t else [] for t in texts])

    x = blocks.filter(F.col(text).rlike(r"\S")).select(*key, F.col(text).alias("__t"), F.posexplode(split(F.col(text))).alias("unit_no", "__u"))
    unit = F.substr(F.col("__t"), F.col("__u.start") + 1, F.col("__u.end") - F.col("__u.start"))
    return x.select(*key, "unit_no", F.col("__u.start").alias("start"), F.col("__u.end").alias("end"), F.col("__u.line").alias("line"), unit.alias("unit")).withColumn("tokens", token_estimate(F.col("unit")))


def fold_by_meaning(texts: list[str], similar: list[float], limits: Limits) -> list[int]:
    """Last unit of each chunk: cut where neighbours are least alike within the limits, ties nearest to the target."""
    wide, size = [0], [0]
    for t in texts:
        w = len(_WIDE.findall(t))
        wide.append(wide[-1] + w)
        size.append(size[-1] + len(t))

    def tokens(i: int, j: int) -> int:  # of units i to j
        w = wide[j + 1] - wide[i]
        return max(1, w + (size[j + 1] - size[i] - w + 3) // 4)

    out, at, last = [], 0, len(texts) - 1
    while at <= last:
        rest = tokens(at, last)
        if rest <= limits.target:
            out.append(last)
            break
        furthest, best = at, None
        for end in range(at, last + 1):
            n = tokens(at, end)
            if n > limits.most:
                break
            furthest = end
            short_tail = end < last and rest <= limits.most and tokens(end + 1, last) < limits.least
            if n < limits.least or end == last or short_tail or texts[end + 1].lstrip().startswith("$$"):
                continue
            rank = (round(similar[end], 12), abs(n - limits.target), end)
            best = min(best, rank) if best else rank
        out.append(best[2] if best else furthest)
        at = out[-1] + 1
    return out


def by_meaning(blocks: DataFrame, key: list[str], embed: Callable[[Column], Column], limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """Semantic chunks of each block: key, chunk_no, start, end, first_line, last_line (from 0 within the block), content, tokens. `embed` makes a vector column of unit texts."""
    units = unit_rows(blocks, key, text, limits.unit).withColumn("v", embed(F.trim("unit")))
    order = Window.partitionBy(*key).orderBy("unit_no")
    similar = units.withColumn("alike", F.coalesce(cosine(F.col("v"), F.lead("v").over(order)), F.lit(0.0))).drop("v")
    rows = F.sort_array(F.collect_list(F.struct("unit_no", "start", "end", "line", "unit", "alike")))  # the units of one block

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def fold(us: pd.Series) -> pd.Series:
        out = []
        for u in us:
            ends = fold_by_meaning([x["unit"] for x in u], [x["alike"] for x in u], limits)
            out.append([{"first": a, "last": b} for a, b in zip([0, *[e + 1 for e in ends[:-1]]], ends)])
        return pd.Series(out)

    g = similar.groupBy(*key).agg(rows.alias("u"))
    c = g.select(*key, "u", F.posexplode(fold("u")).alias("chunk_no", "c"))
    part = F.array_join(F.transform(F.slice("u", F.col("c.first") + 1, F.col("c.last") - F.col("c.first") + 1), lambda r: r["unit"]), "")
    content = F.regexp_replace(part, r"^\s+|\s+$", "")
    ends = lambda text: F.regexp_count(text, F.lit("\n"))
    first = F.element_at("u", F.col("c.first") + 1)
    low = first["line"] + ends(F.regexp_extract(part, r"^\s+", 0))
    out = c.select(*key, "chunk_no", first["start"].alias("start"), F.element_at("u", F.col("c.last") + 1)["end"].alias("end"), low.alias("first_line"), content.alias("content"))
    return out.withColumn("last_line", F.col("first_line") + ends(F.col("content"))).withColumn("tokens", token_estimate(F.col("content")))


def repacked(text: str, most: int) -> list[str]:
    """Lines and sentences joined by blanks up to `most` tokens."""
    if estimate(text) <= most:
        return [text]
    out, held = [], ""
    for a, b in units_of(text, most):
        part = text[a:b].strip()
        joined = f"{held} {part}" if held else part
        if held and estimate(joined) > most:
            out.append(held)
            joined = part
        held = joined
    return [*out, held] if held else out


def fold_by_buffer(pieces: list[tuple[str, tuple, int | None]], limits: Limits) -> list[tuple[str, int]]:
    """pieces (text, section, page) in order -> (content, index of the first new piece). A buffer grows to the target; its tail is carried on as overlap within a section and page run."""
    out: list[tuple[str, int]] = []
    held, fresh, first, place, page = "", False, 0, None, None
    for i, (text, section, at) in enumerate(pieces):
        turned = held and (section != place or (at is not None and page is not None and at > page))
        if turned:
            if fresh:
                out.append((held.rstrip(), first))
            held, fresh = "", False
        for part in repacked(text, limits.buffer_most):
            joined = f"{held}\n\n{part}" if held else part
            if held and estimate(joined) > limits.buffer_most:
                if fresh:
                    out.append((held.rstrip(), first))
                    held = held[-2 * limits.overlap :] if limits.overlap else ""
                while held and estimate(f"{held}\n\n{part}") > limits.buffer_most:
                    held = held[(len(held) + 1) // 2 :] if len(held) > 1 else ""
                fresh, joined = False, f"{held}\n\n{part}" if held else part
            if not fresh:
                first = i
            held, fresh = joined, True
            if estimate(held) >= limits.buffer_target:
                out.append((held.rstrip(), first))
                held, fresh = held[-2 * limits.overlap :] if limits.overlap else "", False
        place, page = section, at if at is not None else page
    if fresh and held.strip():
        out.append((held.rstrip(), first))
    return out


def by_buffer(blocks: DataFrame, limits: Limits = Limits(), key: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """Buffered chunks of each document (key, place, text, section, page_start): key, chunk_index, content, tokens, section, place (of
    the block that the first new piece is from). With the document alone as key also `id`. A buffer is emptied where the section
    or page turns, so each such run is folded by itself, and no row holds more than one run of a document."""
    order = Window.partitionBy(*key).orderBy("place")
    seen = F.last("page_start", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    turns = ~F.lag("section").over(order).eqNullSafe(F.col("section")) | F.coalesce(F.col("page_start") > seen, F.lit(False))
    x = blocks.filter(F.col("text").rlike(r"[^\s\p{Z}]")).select(*key, "place", "text", "section", turns.cast("int").alias("turns"))
    x = x.withColumn("run", F.sum("turns").over(order))
    rows = F.sort_array(F.collect_list(F.struct("place", "text")))  # the blocks of one run

    @F.pandas_udf("array<struct<content:string,place:long>>")
    def fold(runs: pd.Series) -> pd.Series:
        out = []
        for d in runs:
            pieces = [(p.strip(), r["place"]) for r in d for p in re.split(r"\n{2,}", r["text"]) if p.strip()]
            out.append([{"content": t, "place": pieces[i][1]} for t, i in fold_by_buffer([(p, None, None) for p, _ in pieces], limits)])
        return pd.Series(out)

    g = x.groupBy(*key, "run", "section").agg(rows.alias("b"))
    c = g.select(*key, "run", "section", F.posexplode(fold("b")).alias("no", "c"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy("run", "no")) - 1
    out = c.select(*key, number.alias("chunk_index"), "c.content", "section", "c.place").withColumn("tokens", token_estimate(F.col("content")))
    return out.withColumn("id", F.concat_ws("-", *key, "chunk_index")) if key == ("document_id",) else out


# Texts of this format are code or notes unless their names say otherwise.
TEXT, PROSE_NAMES = "text", r"(?i)(\.txt$|(^|/)rag-source\.json$)"


def by_sense(path: Column, file_format: Column) -> Column:
    """Whether a document is cut by meaning: all but plain texts that may be code."""
    return (F.coalesce(file_format, F.lit(TEXT)) != TEXT) | F.coalesce(path.rlike(PROSE_NAMES), F.lit(False))


def routed(merged: DataFrame, embed: Callable[[Column], Column], limits: Limits = Limits(), mode: str = "semantic") -> DataFrame:
    """Merged blocks (document_id, path, file_format, group_no, text, section, page_start, page_end, line_start) as chunks:
    document_id, chunk_index (from 0, without gaps), id, route, section, pages, lines, content, tokens.

    By meaning a block at a time where `by_sense`; else by buffer, a block at a time for structured formats and over the
    whole document for plain text. `mode="legacy"` sends all by buffer. Blocks without pages or lines have chunks without.
    """
    if mode not in ("semantic", "legacy"):
        raise ValueError("mode is semantic or legacy")
    sense = by_sense(F.col("path"), F.col("file_format")) if mode == "semantic" else F.lit(False)
    whole = F.coalesce("file_format", F.lit(TEXT)) == TEXT
    x = merged.withColumn("route", F.when(sense, "meaning").when(whole, "document").otherwise("block"))
    place = ["document_id", "group_no"]
    about = x.select(*place, "section", "page_start", "page_end", "line_start")
    one = by_meaning(x.filter("route = 'meaning'"), place, embed, limits).select(*place, F.col("chunk_no").alias("no"), "content", "tokens", "first_line", "last_line", F.lit("meaning").alias("route"))
    by_block = x.filter("route = 'block'").select(*place, F.col("group_no").alias("place"), "text", "section", "page_start")
    two = by_buffer(by_block, limits, tuple(place)).select(*place, F.col("chunk_index").alias("no"), "content", "tokens", F.lit("block").alias("route"))
    by_document = x.filter("route = 'document'").select("document_id", F.col("group_no").alias("place"), "text", "section", "page_start")
    three = by_buffer(by_document, limits).select("document_id", F.col("place").alias("group_no"), F.col("chunk_index").alias("no"), "content", "tokens", F.lit("document").alias("route"))
    cut = one.unionByName(two, True).unionByName(three, True).join(about, place)
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("group_no", "no")) - 1
    out = cut.withColumn("chunk_index", number).withColumn("line_end", F.col("line_start") + F.col("last_line")).withColumn("line_start", F.col("line_start") + F.coalesce("first_line", F.lit(0)))
    return out.select("document_id", "chunk_index", F.concat_ws("-", "document_id", "chunk_index").alias("id"), "route", "group_no", "section", "page_start", "page_end", "line_start", "line_end", "content", "tokens")
