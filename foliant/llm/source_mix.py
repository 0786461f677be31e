"""Mixing sources to target weights by Poisson replication.

A source of size s with share w of the total T needs each of its documents w*T/s times on average. Each document
draws its count by inverting the Poisson distribution at a uniform number made from a hash of its id and a seed, so a
retried task or a second run draws the same counts. Counts are cut at the source's cap; the rate is raised so that the
mean of the cut distribution still meets the target. A source that misses its target even at its cap repeats every
document cap times.

Sizes are worked out in one pass and written as narrow rows, once for each document; all counts derive from them. The
rates are a table of one row for each listed source, sent to the tasks if it is small. Texts are read once more for the
mixture: a row's copies are made where it is read, and one shuffle, by a random place, brings them in order; repeated
rows meet at the same places and drop out there. Sizes are summed before they are shuffled, so a hot source is no hot
task. Nothing is collected.

Defined results: sources compare trimmed and lower-cased; null sources and sources not listed take no part; null and
blank texts have size 0 and no copy; a listed source without documents has share 0; a weight that is null, negative
or zero has target 0; target rows of one source that repeat are taken once (the largest weight, then the largest cap).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import token_estimate
from foliant.sources.tables import small, staged, table


def source_key(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))


def text_size(text: Column) -> Column:
    return F.when(text.isNull() | (F.length(F.regexp_replace(text, r"\s+", "")) == 0), F.lit(0)).otherwise(token_estimate(text)).cast("long")


def cut_poisson(rate: float, cap: int) -> list[float]:
    """P(count <= k) for k < cap of a Poisson distribution cut at `cap` whose mean is `rate`; [] if every count is `cap`."""
    if cap <= 0 or rate >= cap:
        return []

    def below(mean: float) -> list[float]:
        out, total = [], 0.0
        for k in range(cap):  # by logarithms, for e to the minus mean may vanish
            total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) if mean > 0 else float(k == 0)
            out.append(min(total, 1.0))
        return out

    low, high = 0.0, max(1.0, rate)
    while cap - sum(below(high)) < rate and high < 64 * cap + 64:  # the mean of a count is the sum of P(count > k)
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if cap - sum(below(mid)) < rate else (low, mid)
    return below(high)


def sized_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, key, size), each document once; written, for everything below reads it."""
    narrow = documents.select("doc_id", source_key(F.col("source")).alias("key"), text_size(F.col("text")).alias("size"))
    return staged(narrow.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), "document-sizes")


def mix_rates(sized_docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, key, max_repeats, size, target_share, wanted, rate, capped, below) of each listed source."""
    sizes = sized_docs.groupBy("key").agg(F.sum("size").alias("size"))
    listed = (
        targets.filter(F.col("source").isNotNull())
        .groupBy(source_key(F.col("source")).alias("key"))
        .agg(F.max(F.struct(F.greatest(F.nanvl(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), "source")).alias("t"))
        .select("key", "t.*")
    )
    sized = listed.join(sizes, "key", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    whole = sized.agg(F.sum("weight").alias("weights"), F.sum("size").alias("total"))  # one row

    @F.pandas_udf("array<double>")
    def below(rate: pd.Series, cap: pd.Series) -> pd.Series:
        return pd.Series([cut_poisson(r, int(c)) for r, c in zip(rate, cap)])

    share = F.when(F.col("weights") > 0, F.col("weight") / F.col("weights")).otherwise(F.lit(0.0))
    rated = (
        sized.join(F.broadcast(whole))
        .withColumn("target_share", share)
        .withColumn("wanted", F.col("target_share") * F.col("total"))
        .withColumn("capped", F.col("max_repeats") * F.col("size") < F.col("wanted"))
        .withColumn("rate", F.when(F.col("size") > 0, F.least(F.col("wanted") / F.col("size"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0)))
    )
    return staged(rated.select("source", "key", "max_repeats", "size", "target_share", "wanted", "rate", "capped", below("rate", "max_repeats").alias("below")), "mix-rates")


def draw(doc_id: Column, seed: int) -> Column:
    """A uniform number in (0, 1) made from the id and the seed."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), doc_id.cast("string"))), 1, 12), 16, 10)
    return (digits.cast("double") + 0.5) / float(2**48)


def _copies(rates: DataFrame, seed: int) -> tuple[DataFrame, Column]:
    """The rates to join by key, and the number of copies of a row with doc_id, size and a rate."""
    some = rates.select("key", F.col("source").alias("listed"), "max_repeats", "below")
    drawn = F.when(F.size("below") == 0, F.col("max_repeats")).otherwise(F.size(F.filter("below", lambda p: p < draw(F.col("doc_id"), seed))))
    return F.broadcast(some) if small(some) else some, F.when(F.col("size") > 0, drawn).otherwise(F.lit(0))


def copy_counts(sized_docs: DataFrame, rates: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, key, source, size, copies) of the documents of listed sources."""
    some, copies = _copies(rates, seed)
    return sized_docs.join(some, "key").select("doc_id", "key", F.col("listed").alias("source"), "size", copies.alias("copies"))


def mix_report(documents: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """Target and reached share of each listed source, and the fewest copies of any of its documents that has a size."""
    docs = sized_documents(documents)
    rates = mix_rates(docs, targets)
    least = F.min(F.when(F.col("size") > 0, F.col("copies")))
    got = copy_counts(docs, rates, seed).groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("mixed_size"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), least.alias("least_copies"))
    joined = staged(rates.drop("below").join(got, "key", "left").fillna(0, ["mixed_size", "copies", "most_copies"]), "mix-report")  # a row a listed source
    mixed = joined.agg(F.sum("mixed_size").alias("mixed_total"))
    return joined.join(F.broadcast(mixed)).withColumn("reached_share", F.when(F.col("mixed_total") > 0, F.col("mixed_size") / F.col("mixed_total")).otherwise(F.lit(0.0))).drop("key", "mixed_total")


def mix(documents: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """Every copy of every drawn document, in an order that is random over all sources: (place, doc_id, copy_no, source, size, text)."""
    some, copies = _copies(mix_rates(sized_documents(documents), targets), seed)
    rows = documents.filter("doc_id IS NOT NULL").select("doc_id", source_key(F.col("source")).alias("key"), text_size(F.col("text")).alias("size"), "text")
    each = rows.join(some, "key").withColumn("copies", copies).filter("copies > 0").select("doc_id", F.col("listed").alias("source"), "size", "text", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
    placed = each.withColumn("place", F.xxhash64("doc_id", "copy_no", F.lit(seed)))
    return placed.repartitionByRange("place").dropDuplicates(["place", "doc_id", "copy_no"]).sortWithinPartitions("place", "doc_id", "copy_no").select("place", "doc_id", "copy_no", "source", "size", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed sources that stay below their target in the mixture though every document with a size has all the copies it may have."""
    report = mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    at_cap = F.coalesce(F.col("least_copies") >= F.col("max_repeats"), F.lit(True))  # a source without documents has nothing more to give
    return report.filter(at_cap & (F.col("mixed_size") < F.col("wanted"))).select("source")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the mixture."""
    report = mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return report.select("source", "size", "max_repeats", "capped", "copies", "mixed_size", F.round("target_share", 6).alias("target_share"), F.round("reached_share", 6).alias("reached_share"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture itself."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).drop("place")


SQL = {
    "p7_found": """
WITH docs AS (
  SELECT DISTINCT doc_id, lower(trim(source)) AS key, text FROM documents),
sizes AS (
  SELECT key, sum(CASE WHEN text IS NULL OR length(regexp_replace(text, '\\s+', '', 'g')) = 0 THEN 0 ELSE
    greatest(1, length(regexp_replace(text, '[^\\x{3400}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}]', '', 'g'))
    + (length(regexp_replace(text, '[\\x{3400}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}]', '', 'g')) + 3) // 4) END) AS size
  FROM docs GROUP BY key),
listed AS (SELECT t.source, t.weight, t.max_repeats, coalesce(s.size, 0) AS size FROM mix_targets t LEFT JOIN sizes s ON s.key = lower(trim(t.source)))
SELECT source FROM listed
WHERE max_repeats * size < weight / (SELECT sum(weight) FROM listed) * (SELECT sum(size) FROM listed)""",
}

QUERIES = {"p7_found": p7_found, "p7_shares": p7_shares, "p7_mix": p7_mix}
