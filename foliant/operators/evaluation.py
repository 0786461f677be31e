"""Retrieval evaluation over batches of cases: recall, reciprocal rank, percentiles, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suffix_on_boundary(path: Column, suffix: Column) -> Column:
    return (path == suffix) | F.endswith(path, F.concat(F.lit("/"), F.ltrim(suffix, F.lit("/"))))


def scored(labels: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """labels (query_id, row_id), hits (query_id, row_id, rank) -> (query_id, labels, found, recall, rr). Cases without a hit count 0."""
    n = labels.groupBy("query_id").agg(F.count_distinct("row_id").alias("labels"))
    met = hits.filter(F.col("rank") <= k).join(labels.distinct(), ["query_id", "row_id"]).groupBy("query_id").agg(F.count_distinct("row_id").alias("found"), F.min("rank").alias("best"))
    x = n.join(met, "query_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return x.select("query_id", "labels", "found", F.round(F.col("found") / F.col("labels"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("best"), F.lit(0.0)), 6).alias("rr"))


def nearest_rank(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of each group: the value at place ceil(p n) in order. Counted by value, so no group is gathered."""
    from pyspark.sql import Window

    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*group).orderBy(value)
    x = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*group)))
    return x.groupBy(*group).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("upto") >= F.ceil(F.lit(p) * F.col("n")), F.col(value))).alias(name) for name, p in shares.items()])


def cost(calls: Column, tokens: Column, per_million: float | None) -> Column:
    """Null where a used component has no rate."""
    if per_million is None:
        return F.when(calls > 0, F.lit(None).cast("double")).otherwise(F.lit(0.0))
    return F.round(tokens / 1e6 * per_million, 6)


def label_hits(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """hits (query_id, rank, path, content, section), labels (query_id, label_no, pathSuffix, contains, section; one row for
    each of a label's alternatives) -> (query_id, label_no, rank) of each label's first hit. Parts of a label that are null
    aren't asked; a path suffix ends at a folder's boundary; texts compare by case."""
    named = labels.select("query_id", "label_no", F.col("pathSuffix").alias("s"), F.col("contains").alias("c"), F.col("section").alias("sec"))
    asks = lambda c, met: F.col(c).isNull() | F.coalesce(met, F.lit(False))
    good = asks("s", suffix_on_boundary(F.col("path"), F.col("s"))) & asks("c", F.contains(F.col("content"), F.col("c"))) & asks("sec", F.col("section") == F.col("sec"))
    some = F.coalesce("s", "c", "sec").isNotNull()
    return hits.join(named.filter(some), "query_id").filter(good).groupBy("query_id", "label_no").agg(F.min("rank").alias("rank"))


def recall_of_labels(labels: DataFrame, met: DataFrame, k: int) -> DataFrame:
    """(query_id, labels, found, recall, rr) of labels and their first hits; failed queries count 0."""
    n = labels.groupBy("query_id").agg(F.count_distinct("label_no").alias("labels"))
    got = met.filter(F.col("rank") <= k).groupBy("query_id").agg(F.count_distinct("label_no").alias("found"), F.min("rank").alias("best"))
    x = n.join(got, "query_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return x.select("query_id", "labels", "found", F.round(F.col("found") / F.col("labels"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("best"), F.lit(0.0)), 6).alias("rr"))


def changes(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Where two reports (keys, values) differ by more than rounding: (keys, value, before, after)."""
    flat = lambda df, name: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("value"), F.col(v).cast("double").alias(name)) for v in values])).alias("x")).select(*keys, "x.value", f"x.{name}")
    both = flat(before, "before").join(flat(after, "after"), [*keys, "value"], "full_outer")
    return both.filter(~F.col("before").eqNullSafe(F.col("after")) & ~F.coalesce(F.abs(F.col("before") - F.col("after")) <= 1e-9, F.lit(False)))


def written(report: DataFrame, path: str) -> None:
    """A report, of a row a mode or a case of a fixed set, as one JSON file in a folder that mustn't exist; Spark commits it whole or not at all."""
    report.coalesce(1).write.mode("errorifexists").option("ignoreNullFields", False).json(path)
