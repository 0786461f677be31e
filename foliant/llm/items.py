"""The text items of the library: block texts and chunk contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.tables import table


def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin, item_id, text) of all blocks and chunks, repeated rows included."""
    blocks = table(spark, sf_dir, "blocks").select(F.lit("block").alias("origin"), F.col("block_id").alias("item_id"), "text")
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunk").alias("origin"), F.col("id").alias("item_id"), F.col("chunk_content").alias("text"))
    return blocks.unionByName(chunks)
