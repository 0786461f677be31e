"""Pages for texts that have none, from an export of the same document that has them; figures for chunks.

All rest on `alignment.aligned`, an equi-join of windows. A document of whose long passages fewer than SHARE are found is
taken for another one: `doubtful` names it, and nothing is taken from its export.

Defined results: null, blank and short passages aren't located; passages that aren't located lie, in `paged_paragraphs`,
between their located neighbours, keep their own pages in `repaged`, and go with the last located one in `figure_places`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.alignment import WINDOW, aligned, skeleton
from foliant.sources.tables import small, staged

SHARE = 0.7


def _located(passages: DataFrame, paged: DataFrame) -> DataFrame:
    """(row_id, doc, long, page_start, page_end) of every passage (row_id, doc, text)."""
    found = aligned(passages.select("row_id", "doc", "text"), paged).drop("hits")
    long = F.coalesce(F.length(skeleton(F.col("text"))) >= WINDOW, F.lit(False))
    return staged(passages.select("row_id", "doc", long.alias("long")).join(found, "row_id", "left"), "located")  # it feeds the check and the result


def doubtful(located: DataFrame) -> DataFrame:
    """(doc, eligible, located) of the documents whose export matches too little."""
    counts = located.groupBy("doc").agg(F.count_if("long").alias("eligible"), F.count_if(F.col("long") & F.col("page_start").isNotNull()).alias("located"))
    return counts.filter(F.col("located") < SHARE * F.col("eligible"))


def paragraphs(blocks: DataFrame) -> DataFrame:
    """Blocks (doc, block_ord, text, line_start) cut at blank lines: doc, block_ord, part, line_start, line_end, text."""
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("i"), line.alias("t"), line.rlike(r"\S").alias("full")))
    each = blocks.filter(F.col("text").rlike(r"\S")).select("doc", "block_ord", "line_start", F.explode(lines).alias("l")).select("doc", "block_ord", "line_start", "l.*")
    order = Window.partitionBy("doc", "block_ord").orderBy("i")
    starts = F.col("full") & ~F.coalesce(F.lag("full").over(order), F.lit(False))
    part = each.withColumn("part", F.sum(starts.cast("int")).over(order)).filter("full")
    rows = F.sort_array(F.collect_list(F.struct("i", "t")))  # the lines of one paragraph
    g = part.groupBy("doc", "block_ord", "part").agg(F.max("line_start").alias("line_start"), rows.alias("r"))
    low, high = F.col("r")[0]["i"], F.element_at("r", -1)["i"]
    text = F.array_join(F.transform("r", lambda x: x["t"]), "\n")
    return g.select("doc", "block_ord", "part", (F.col("line_start") + high).alias("line_end"), (F.col("line_start") + low).alias("line_start"), text.alias("text"))


def paged_paragraphs(blocks: DataFrame, paged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (doc, block_ord, text, line_start) as paragraphs with pages, and the doubtful documents, which have none."""
    parts = paragraphs(blocks).withColumn("row_id", F.concat_ws(":", "doc", "block_ord", "part"))
    located = _located(parts, paged)
    off = doubtful(located)
    x = parts.join(located.select("row_id", "page_start", "page_end"), "row_id").join(off.select("doc"), "doc", "left_anti")
    forth, back = (Window.partitionBy("doc").orderBy(*(f(c) for c in ("block_ord", "part"))) for f in (F.asc, F.desc))
    before, after = F.last("page_end", True).over(forth), F.last("page_start", True).over(back)
    x = x.withColumn("before", F.coalesce(before, after)).withColumn("after", F.greatest(F.coalesce(after, before), F.coalesce(before, after)))
    pages = [F.coalesce("page_start", "before").alias("page_start"), F.coalesce("page_end", "after").alias("page_end")]
    return x.select("doc", "block_ord", "part", "line_start", "line_end", *pages, "text"), off


def repaged(blocks: DataFrame, paged: DataFrame) -> DataFrame:
    """Blocks (row_id, doc, text, page_start, page_end, …) moved to the pages that the export names for them."""
    located = _located(blocks, paged)
    found = located.join(doubtful(located).select("doc"), "doc", "left_anti").select("row_id", F.col("page_start").alias("__a"), F.col("page_end").alias("__z"))
    out = blocks.join(found, "row_id", "left").withColumn("page_start", F.coalesce("__a", "page_start")).withColumn("page_end", F.coalesce("__z", "page_end"))
    return out.select(*blocks.columns)


def figure_places(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Blocks (row_id, doc, place, text, images), chunks (doc, chunk_index, text) -> (doc, chunk_index, place, image): the chunk
    that holds a figure's text, else that of the last located block before it. Only documents with figures are aligned."""
    docs = staged(blocks.filter(F.size("images") > 0).select("doc").distinct(), "figure-documents")
    docs = F.broadcast(docs) if small(docs) else docs
    blocks, chunks = (x.join(docs, "doc", "left_semi") for x in (blocks, chunks))
    located = _located(blocks, chunks.select("doc", F.col("chunk_index").alias("page"), "text"))
    x = blocks.select("row_id", "place", "images").join(located, "row_id").join(doubtful(located).select("doc"), "doc", "left_anti")
    last = F.last("page_end", True).over(Window.partitionBy("doc").orderBy("place"))
    return x.withColumn("chunk_index", last).filter("chunk_index IS NOT NULL").select("doc", "chunk_index", "place", F.explode("images").alias("image"))
