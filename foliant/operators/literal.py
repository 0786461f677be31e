"""Literal search: a pattern's characters, white space left out, within a text's characters, white space left out.

An inverted join of windows. Texts are cut into windows of w characters one after the other, patterns into all windows of
w characters. A pattern of at least 2 w - 1 characters that stands in a text covers a whole window of it, at one of w
offsets; so for each offset the pattern asks for one window only, the one that is rarest in the texts by count, and the
texts with that window are candidates. They are compared in full. Patterns of each length use the largest w that fits,
down to single characters, so none is too short.

Texts are cut once for each w that some pattern needs, and only windows that some pattern has are shuffled.
Defined results: null and blank patterns and texts match nothing; repeated rows count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.sources.tables import small, staged

WINDOWS = (32, 16, 8, 4, 2, 1)
MOST_SENT = 32 << 20  # bytes of the patterns' windows that are broadcast; beyond, a shuffled join


def stripped(text: Column) -> Column:
    return F.translate(text, " \n\t\r", "")


def containing(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """rows (row_id, text), patterns (query_id, pattern) -> (query_id, row_id) of each text with a pattern."""
    asked = staged(patterns.select("query_id", stripped(F.col("pattern")).alias("p")).filter("p <> ''").distinct().withColumn("pid", F.xxhash64("p")), "patterns")
    texts = rows.select("row_id", stripped(F.col("text")).alias("t")).filter("t <> ''")
    fits = [F.when(F.length("p") >= 2 * w - 1, w) for w in WINDOWS]
    forms = asked.select("pid", "p", F.coalesce(*fits).alias("w")).distinct()
    used = sorted(r["w"] for r in forms.select("w").distinct().collect())  # at most one for each of WINDOWS
    if not used:
        kinds = [df.schema[c].dataType.simpleString() for df, c in ((patterns, "query_id"), (rows, "row_id"))]
        return rows.sparkSession.createDataFrame([], f"query_id {kinds[0]}, row_id {kinds[1]}")

    def all_windows(w: int) -> DataFrame:
        at = F.posexplode(F.regexp_extract_all("p", F.lit(f"(?s)(?=(.{{{w}}}))."), F.lit(1))).alias("at", "g")
        return forms.filter(F.col("w") == w).select("pid", at).select("pid", F.pmod("at", F.lit(w)).alias("offset"), F.xxhash64(F.lit(w), "g").alias("g"))

    def own_windows(w: int) -> DataFrame:
        cut = F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(f"(?s).{{{w}}}"), F.lit(0)))).alias("g")
        return texts.select("row_id", cut).select("row_id", F.xxhash64(F.lit(w), "g").alias("g"))

    wanted = staged(reduce(DataFrame.unionByName, map(all_windows, used)).distinct(), "pattern-windows")
    keys = wanted.select("g").distinct()
    keys = F.broadcast(keys) if small(wanted, MOST_SENT) else keys
    there = staged(reduce(DataFrame.unionByName, map(own_windows, used)).join(keys, "g", "left_semi"), "text-windows")
    counted = there.groupBy("g").agg(F.count("*").alias("n"))
    rarest = wanted.join(counted, "g", "left").groupBy("pid", "offset").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r"))
    probes = rarest.filter("r.n > 0").select("pid", F.col("r.g").alias("g")).distinct()
    met = probes.join(there, "g").select("pid", "row_id").distinct()
    return met.join(texts, "row_id").join(asked, "pid").filter(F.contains("t", F.col("p"))).select("query_id", "row_id").distinct()
