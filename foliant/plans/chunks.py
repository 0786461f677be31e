"""Queries of chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import blocks as B
from foliant.operators import chunking as C
from foliant.operators.models import HashedWords, embedding
from foliant.plans.views import current


def sentence_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of every block: number, longest, and tokens in all."""
    u = C.unit_rows(current(spark, d, "blocks", "block_id", "text"), ["block_id"])
    return u.groupBy("block_id").agg(F.count("*").alias("units"), F.max("tokens").alias("most_tokens"), F.sum(F.length("unit")).alias("chars"))


def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    m = B.merged(current(spark, d, "blocks"))
    return C.by_meaning(m, ["document_id", "group_no"], embedding(HashedWords())).select("document_id", "group_no", "chunk_no", "start", "end", "tokens", F.md5("content").alias("digest"))


def legacy_chunks(spark: SparkSession, d: str) -> DataFrame:
    m = B.merged(current(spark, d, "blocks")).withColumn("place", F.col("group_no"))
    return C.by_buffer(m).select("id", "document_id", "chunk_index", "section", "tokens", F.md5("content").alias("digest"))


QUERIES = {"sentence_units": sentence_units, "semantic_chunks": semantic_chunks, "legacy_chunks": legacy_chunks}
SQL: dict[str, str] = {}
