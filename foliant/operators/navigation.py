"""Navigation of one document's passages: order, outline, ranges, token budget.

Inputs are passages (doc, idx, section, page_start, page_end, tokens). No window sorts a whole document: runs are counted in
parts of PART places, and the parts, a row each, are put in order by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


PART = 4096


def _order() -> object:
    return Window.partitionBy("doc").orderBy("idx")


def outline(passages: DataFrame) -> DataFrame:
    """Runs of equal sections: (doc, run, section, nth occurrence of that name, first, last, passages, page_start, page_end).
    Null sections are empty ones; passages without a document or place are left out."""
    local = Window.partitionBy("doc", "part").orderBy("idx")
    x = passages.withColumn("section", F.coalesce("section", F.lit(""))).withColumn("part", F.floor(F.col("idx") / PART))
    new = F.lag("section").over(local)
    x = x.withColumn("run", F.sum((new.isNull() | (new != F.col("section"))).cast("int")).over(local))
    parts = x.groupBy("doc", "part").agg(F.min_by("section", "idx").alias("head"), F.max_by("section", "idx").alias("tail"), F.max("run").alias("runs"))
    order = Window.partitionBy("doc").orderBy("part")
    goes_on = F.coalesce(F.lag("tail").over(order) == F.col("head"), F.lit(False)).cast("int")
    parts = parts.withColumn("goes_on", goes_on).withColumn("upto", F.sum(F.col("runs") - F.col("goes_on")).over(order))
    before = F.col("upto") - F.col("runs")  # the runs before the part, without the one that goes on in it
    x = x.join(parts.select("doc", "part", before.alias("before")), ["doc", "part"]).withColumn("run", F.col("run") + F.col("before"))
    runs = x.groupBy("doc", "run", "section").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("passages"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"))
    return runs.withColumn("nth", F.row_number().over(Window.partitionBy("doc", "section").orderBy("run")))


def without_common_head(outlines: DataFrame) -> DataFrame:
    """Drops the first part of all section paths of a document if all non-empty ones share it and one is nested."""
    nested = F.contains(F.col("section"), F.lit(" / "))
    head = F.when(F.col("section") != "", F.split_part("section", F.lit(" / "), F.lit(1)))
    heads = outlines.groupBy("doc").agg(((F.min(head) == F.max(head)) & F.max(nested)).alias("common"))
    cut = F.when(nested, F.expr("substring(section, instr(section, ' / ') + 3)")).otherwise(F.col("section"))
    x = outlines.join(heads, "doc")
    return x.withColumn("short", F.when(F.coalesce("common", F.lit(False)), cut).otherwise(F.col("section"))).drop("common")


def around(passages: DataFrame, centers: DataFrame, reach: int = 2) -> DataFrame:
    """Passages at most `reach` before or after the center (doc, center) of their document."""
    return passages.join(centers, "doc").filter(F.col("idx").between(F.col("center") - reach, F.col("center") + reach))


def pages(passages: DataFrame, low: int, high: int) -> DataFrame:
    """From the first to the last passage that overlaps the pages; the range has no gaps. Two numbers a document, aggregated before the shuffle, and a join."""
    if not 1 <= low <= high:
        raise ValueError("pages go from 1 on, in order")
    hit = passages.filter((F.col("page_start") <= high) & (F.col("page_end") >= low))
    ends = hit.groupBy("doc").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    return passages.join(ends, "doc").filter(F.col("idx").between(F.col("first"), F.col("last"))).drop("first", "last")


def page_range(text: Column) -> Column:
    """`8` or `8-9` as (low, high); null where it is neither or out of order."""
    low, high = F.regexp_extract(text, r"^\s*(\d{1,6})\s*(?:-\s*\d{1,6}\s*)?$", 1), F.regexp_extract(text, r"^\s*\d{1,6}\s*-\s*(\d{1,6})\s*$", 1)
    a, b = F.nullif(low, F.lit("")).cast("int"), F.coalesce(F.nullif(high, F.lit("")).cast("int"), F.nullif(low, F.lit("")).cast("int"))
    return F.when((a >= 1) & (b >= a), F.struct(a.alias("low"), b.alias("high")))


def between(passages: DataFrame, first: int | None = None, last: int | None = None, pages_of: tuple[int, int] | None = None) -> DataFrame:
    """A range of passages by number, or by pages; not both."""
    if pages_of is not None and (first is not None or last is not None):
        raise ValueError("a range is by passages or by pages")
    if pages_of is not None:
        return pages(passages, *pages_of)
    if first is not None and last is not None and last < first:
        raise ValueError("the range is out of order")
    return passages.filter((F.col("idx") >= (first or 0)) & (F.lit(last is None) | (F.col("idx") <= (last if last is not None else 0))))


def budget(passages: DataFrame, most: int = 4000) -> DataFrame:
    """Passages from the first on while their tokens fit; the first always; `next`: where to go on, `shown`: the section where it changes.

    A passage has a token at least, so no more than `most` + 1 passages of a document matter; each task cuts to those
    before anything is shuffled, and the windows run over them only.
    """
    if not 1 <= most <= 16_000:
        raise ValueError("the budget must be within 1 and 16000")
    w = Window.partitionBy("doc")
    x = passages.withColumn("rn", F.row_number().over(_order())).filter(F.col("rn") <= most + 1)
    x = x.withColumn("upto", F.sum(F.greatest("tokens", F.lit(1))).over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("fits", (F.col("upto") <= most) | (F.col("rn") == 1))
    x = x.withColumn("next", F.min(F.when(~F.col("fits"), F.col("idx"))).over(w)).filter("fits")
    before = F.lag("section").over(_order())
    return x.withColumn("shown", F.when((F.col("rn") == 1) | ~before.eqNullSafe(F.col("section")), F.col("section"))).drop("rn", "fits")


def relative(path: Column, root: str) -> Column:
    return F.when(F.startswith(path, F.lit(root)), F.substr(path, F.lit(len(root) + 1))).otherwise(path)
