"""Joining ranked lists of several retrievers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOOST = 1.5


def scaled(df: DataFrame, score: str) -> DataFrame:
    """Min-max within each query; a list of equal scores is all 1."""
    w = Window.partitionBy("query_id")
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn("scaled", F.when(high == low, F.lit(1.0)).otherwise((F.col(score) - low) / (high - low)))


def boosted(score: Column, path: Column, first_word: Column) -> Column:
    """Half as much again where the first query word of more than one letter begins a word of the path."""
    words = F.regexp_extract_all(F.lower(path), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    return F.when(F.exists(words, lambda w: F.startswith(w, first_word)), score * BOOST).otherwise(score)


def first_word(query: Column) -> Column:
    return F.element_at(F.filter(F.regexp_extract_all(F.lower(query), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)), lambda w: F.length(w) > 1), 1)


def fused(lexical: DataFrame, vector: DataFrame, alpha: float, k: int) -> DataFrame:
    """(query_id, row_id, bm25, cosine, hybrid, rank). A missing side counts 0; without any vector hit the lexical side counts in full. Ties go by lexical, then by vector rank."""
    lex = scaled(lexical.select("query_id", "row_id", "score", F.col("rank").alias("lex_rank")), "score").withColumnRenamed("scaled", "a")
    vec = scaled(vector.select("query_id", "row_id", "cosine", F.col("rank").alias("vec_rank")), "cosine").withColumnRenamed("scaled", "b")
    both = lex.join(vec, ["query_id", "row_id"], "full_outer")
    any_vector = F.max(F.col("vec_rank").isNotNull()).over(Window.partitionBy("query_id"))
    weight = F.when(any_vector, F.lit(alpha)).otherwise(F.lit(1.0))
    value = F.round(weight * F.coalesce("a", F.lit(0.0)) + (1 - weight) * F.coalesce("b", F.lit(0.0)), 6)
    by = Window.partitionBy("query_id").orderBy(F.col("hybrid").desc(), F.col("lex_rank").asc_nulls_last(), F.col("vec_rank").asc_nulls_last())
    out = both.withColumn("hybrid", value).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return out.select("query_id", "row_id", F.coalesce("score", F.lit(0.0)).alias("bm25"), F.coalesce("cosine", F.lit(0.0)).alias("cosine"), "hybrid", "rank")
