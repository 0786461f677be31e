"""Block-level transforms: reading order, merging, headings, paragraphs.

All are windows within one document, spread by hash: a task sorts the blocks of its documents, and spills. A document that
has a third of all blocks is one task's.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.headings import REFERENCES

FLOATS = ("figure", "table")


def joinable(before: str) -> Column:
    """May this block follow the block `before` (a struct column) in one paragraph group?"""
    b = F.col(before)
    same = (b["kind"] == F.col("kind")) & b["section"].eqNullSafe(F.col("section")) & b["page_start"].eqNullSafe(F.col("page_start")) & b["page_end"].eqNullSafe(F.col("page_end"))
    lines = F.length(b["text"]) - F.length(F.replace(b["text"], F.lit("\n"), F.lit("")))
    unlined = b["line_start"].isNull() & F.col("line_start").isNull()
    adjacent = (b["line_end"] + 2 == F.col("line_start")) & (b["line_end"] - b["line_start"] == lines)
    return F.coalesce(same & (unlined | F.coalesce(adjacent, F.lit(False))), F.lit(False))


_PARTS = ["kind", "section", "page_start", "page_end", "line_start", "line_end", "text"]


def reading_order(blocks: DataFrame) -> DataFrame:
    """Adds `place`: figures and tables float behind the run of text that they interrupt. Blank blocks are dropped."""
    blocks = blocks.filter(F.col("text").rlike(r"\S")).withColumn("kind", F.coalesce("kind", F.lit(""))).withColumn("floats", F.col("kind").isin(*FLOATS))
    order = Window.partitionBy("document_id", "floats").orderBy("block_ord")
    before = F.lag(F.struct(*_PARTS)).over(order)
    starts = blocks.withColumn("before", before).withColumn("starts", (~F.col("floats") & (F.col("before").isNull() | ~joinable("before"))).cast("int"))
    run = F.sum("starts").over(Window.partitionBy("document_id").orderBy("block_ord"))
    ordered = starts.withColumn("run", run).drop("before", "starts")
    return ordered.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("run", "floats", "block_ord")))


def merged(blocks: DataFrame) -> DataFrame:
    """Consecutive joinable blocks of the reading order as one: texts joined by a blank line, the last line end, the rest of the first."""
    order = Window.partitionBy("document_id").orderBy("place")
    x = reading_order(blocks).withColumn("before", F.lag(F.struct(*_PARTS)).over(order))
    x = x.withColumn("group_no", F.sum((F.col("before").isNull() | ~joinable("before")).cast("int")).over(order))
    members = F.sort_array(F.collect_list(F.struct("place", "text", "line_end", *[c for c in _PARTS if c not in ("text", "line_end")])))  # within one document
    g = x.groupBy("document_id", "group_no").agg(members.alias("m"))
    first = F.col("m")[0]
    return g.select(
        "document_id",
        "group_no",
        F.array_join(F.transform("m", lambda r: r["text"]), "\n\n").alias("text"),
        F.size("m").alias("blocks"),
        *[first[c].alias(c) for c in ("kind", "section", "page_start", "page_end", "line_start")],
        F.element_at("m", -1)["line_end"].alias("line_end"),
    )


def line_levels(lines: list[str]) -> list[tuple[int, str | None, bool]]:
    """(level, title, whether it is code) of each line: level 1 to 6 where a heading begins. A fence is closed by one of
    its own character and at least its length; underlined paragraphs of several lines are one heading."""
    out: list[tuple[int, str | None, bool]] = []
    fence, paragraph = "", []  # the open fence; the lines of the open paragraph
    for i, line in enumerate(lines):
        mark = re.match(r" {0,3}(`{3,}|~{3,})(.*)$", line)
        if fence or (mark and not (mark[1][0] == "`" and "`" in mark[2])):
            if not fence:
                fence = mark[1]
            elif mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip():
                fence = ""
            out.append((0, None, True))
            paragraph = []
            continue
        hashes, under = re.match(r" {0,3}(#{1,6})(?:[ \t]+(.*))?$", line), re.match(r" {0,3}(=+|-+)[ \t]*$", line)
        out.append((0, None, False))
        if hashes:
            out[-1] = (len(hashes[1]), re.sub(r"(^|[ \t]+)#+[ \t]*$", "", hashes[2] or "").strip(), False)
            paragraph = []
        elif under and paragraph:
            out[paragraph[0]] = (1 if under[1][0] == "=" else 2, " ".join(lines[k].strip() for k in paragraph), False)
            paragraph = []
        elif not line.strip() or (not paragraph and re.match(r" {0,3}(?:[-*+>] |\d+[.)] )| {4}|\t", line)):
            paragraph = []
        elif paragraph or i == 0 or not re.match(r" {0,3}(?:[-*+>] |\d+[.)] )", line):
            before = out[i - 1] if i else None
            if paragraph or before is None or not lines[i - 1].strip() or before[0] or before[2]:
                paragraph.append(i)
    return out


def shown_line(line: Column) -> Column:
    """Images as their alternative text, a table on one line as its cells."""
    t = F.regexp_replace(line, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    cells = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?i)</t[dh]>\s*<t[dh][^>]*>", " | "), r"(?i)</tr>\s*<tr[^>]*>", " | "), r"<[^<>]+>", "")
    return F.when(t.rlike(r"(?i)^\s*<table"), F.trim(cells)).otherwise(t)


def markdown_sections(texts: DataFrame) -> DataFrame:
    """Markdown (doc_id, text) as one block a section: (doc_id, section_no, section, line_start, line_end, text).

    Lines are rows; the path of open headings is a window over the lines of a document; what a line is takes a small
    helper over the text. Headings inside fences are text, an underlined paragraph is a heading, reference sections are
    left out, images show their alternative text, and blank edge lines are trimmed. Null and blank texts have no block.
    """

    @F.pandas_udf("array<struct<level:int,title:string,code:boolean>>")
    def levels(sources: pd.Series) -> pd.Series:
        return pd.Series([[{"level": n, "title": t, "code": c} for n, t, c in line_levels(s.split("\n"))] for s in sources])

    cut = texts.filter(F.col("text").rlike(r"\S")).select("doc_id", F.split("text", "\n").alias("l"), levels("text").alias("k"))
    lines = cut.select("doc_id", F.posexplode(F.arrays_zip("l", "k")).alias("i", "z")).select("doc_id", "i", F.col("z.l").alias("line"), "z.k.*")
    order = Window.partitionBy("doc_id").orderBy("i")
    x = lines.withColumn("line", F.when(F.col("code"), F.col("line")).otherwise(shown_line(F.col("line"))))
    # The open heading of level n is the last one of that level, unless a higher one came after it.
    for n in range(1, 7):
        last = F.last(F.when(F.col("level") == n, F.struct(F.col("i").alias("at"), F.col("title").alias("t"))), ignorenulls=True).over(order)
        x = x.withColumn(f"h{n}", last)
    open_ = [F.when(F.coalesce(F.greatest(*[F.coalesce(F.col(f"h{m}")["at"], F.lit(-1)) for m in range(1, n)], F.lit(-1)), F.lit(-1)) <= F.col(f"h{n}")["at"], F.col(f"h{n}")["t"]) for n in range(2, 7)]
    path = F.filter(F.array(F.col("h1")["t"], *open_), lambda t: t.isNotNull() & (t != ""))
    x = x.withColumn("path", path).withColumn("section_no", F.sum((F.col("level") > 0).cast("int")).over(order))
    x = x.filter(~F.exists("path", lambda t: F.lower(t).isin(*REFERENCES)))
    rows = F.sort_array(F.collect_list(F.struct("i", "line")))  # the lines of one section
    g = x.filter(F.col("line").rlike(r"\S") | (F.col("level") == 0)).groupBy("doc_id", "section_no").agg(rows.alias("r"), F.max(F.array_join("path", " / ")).alias("section"))
    kept = F.filter("r", lambda r: r["line"].rlike(r"\S"))
    low, high = kept[0]["i"], F.element_at(kept, -1)["i"]
    g = g.filter(F.size(kept) > 0)
    return g.select("doc_id", "section_no", "section", (low + 1).alias("line_start"), (high + 1).alias("line_end"), F.array_join(F.transform(F.filter("r", lambda r: (r["i"] >= low) & (r["i"] <= high)), lambda r: r["line"]), "\n").alias("text"))
