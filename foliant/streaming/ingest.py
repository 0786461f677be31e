"""Incremental indexing as a stream: new files of chunk rows replace their documents in the index.

Each micro-batch joins the live generation, is published as a new one, and the pointer moves last, so a batch that is
retried after a loss writes the same generation again and readers never see half of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.operators.sync import replaced
from foliant.sources.files import Generations
from foliant.sources.tables import newest


def index_stream(spark: SparkSession, source: str, schema: str, index: str, checkpoint: str, keep: int = 2) -> StreamingQuery:
    """Follow a folder of Parquet files of (path, document_id, hash, …); late states of a path lose to newer ones by `indexed`."""
    generations = Generations(spark, index)

    def apply(batch: DataFrame, epoch: int) -> None:
        name = f"g{epoch:09d}"
        if generations.active(name) == name:
            return  # the batch was published before the driver was lost
        fresh = newest(batch.filter("path IS NOT NULL"), ["path"], "indexed").select(*batch.columns)
        old = generations.read(name)
        if old is not None:
            known = old.select("path", F.col("indexed").alias("seen"))
            fresh = fresh.join(known, "path", "left").filter("seen IS NULL OR indexed >= seen").drop("seen").select(*batch.columns)
            fresh = replaced(old.select(*batch.columns), fresh, fresh.select("path").limit(0))
        generations.publish(fresh, name)  # written once, and renamed
        generations.clean(keep)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(files: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Indexed files and bytes by window and format over a stream, late rows within the watermark."""
    return files.withWatermark("indexed", late).groupBy(F.window("indexed", window), "file_format").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
