"""Page alignment by shared windows, and hand corrections.

A text's skeleton is its letters and digits, lower-cased. Windows of WINDOW characters of a passage's skeleton (every
STEP-th) are looked up among the windows of the paged blocks of its document; windows that stand on several pages say
nothing and are left out. A passage goes from the first to the last page that at least LEAST of its windows name. All
is an equi-join on document and window hash, so documents spread over tasks by window, however long they are.

Defined results: null and short texts, and passages without enough hits, have no row; repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, STEP, LEAST = 24, 8, 2
PIECE = 128  # characters of a text whose windows are cut at once; a multiple of STEP, and no less than WINDOW


def skeleton(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]", "")


def _windows(df: DataFrame, step: int) -> DataFrame:
    """A row for every `step`-th window `w` of each row's `text`, beside the other columns. Texts are cut into pieces of PIECE
    characters first, so work is in proportion to length, and only the windows of one piece are in memory at once."""
    rest = [c for c in df.columns if c != "text"]
    pieces = F.regexp_extract_all(skeleton(F.col("text")), F.lit(f".{{1,{PIECE}}}"), F.lit(0))
    cut = df.select(*rest, pieces.alias("__p")).select(*rest, F.explode(F.arrays_zip(F.col("__p").alias("own"), F.slice("__p", 2, F.greatest(F.size("__p"), F.lit(1))).alias("after"))).alias("__x"))
    run = cut.select(*rest, F.concat("__x.own", F.coalesce(F.substring("__x.after", 1, WINDOW - 1), F.lit(""))).alias("__s"))
    run = run.filter(F.length("__s") >= WINDOW)
    return run.select(*rest, F.explode(F.transform(F.sequence(F.lit(1), F.length("__s") - (WINDOW - 1), F.lit(step)), lambda i: F.substr("__s", i, F.lit(WINDOW)))).alias("w"))


def aligned(passages: DataFrame, paged: DataFrame) -> DataFrame:
    """passages (row_id, doc, text), paged (doc, page, text) -> (row_id, page_start, page_end, hits)."""
    known = _windows(paged.filter("page IS NOT NULL").select("doc", "page", "text"), 1)
    named = known.groupBy("doc", "w").agg(F.min("page").alias("page"), F.max("page").alias("other")).filter("page = other").drop("other")
    asked = _windows(passages.select("row_id", "doc", "text"), STEP).distinct()
    votes = asked.join(named, ["doc", "w"]).groupBy("row_id", "page").agg(F.count("*").alias("hits")).filter(F.col("hits") >= LEAST)
    return votes.groupBy("row_id").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.sum("hits").alias("hits"))


def corrected(text: Column, fixes: list[tuple[str, str]]) -> Column:
    """Literal replacements in order; a text that is blank afterwards is null."""
    for wrong, right in fixes:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return F.when(text.rlike(r"\S"), text)


def occurrences(df: DataFrame, text: str, wrong: str) -> int:
    """How often a literal stands in all texts; a correction is accepted only where that is once."""
    n = (F.length(text) - F.length(F.replace(F.col(text), F.lit(wrong), F.lit("")))) / len(wrong)
    return int(df.agg(F.sum(n)).first()[0] or 0)


def accepted(df: DataFrame, text: str, wrong: str, right: str) -> tuple[str, str]:
    """The correction, if it is one line, no comment, and meets exactly one place."""
    if not wrong or any(c in wrong + right for c in "\t\n") or wrong.startswith("#"):
        raise ValueError("a correction is one line without tabs that doesn't begin with #")
    if (n := occurrences(df, text, wrong)) != 1:
        raise ValueError(f"the text stands in {n} places")
    return wrong, right
