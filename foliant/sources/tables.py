"""Reading the Parquet tables of one data directory, and where intermediate tables go."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data directory; scans stay lazy, so Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session; a temporary one only where it is unset and
    the session is local, so driver and tasks are one machine. On a cluster without the setting this is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-foliant-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


_written: list[str] = []  # staged tables of this driver


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage at a table that outlives any executor; used where a result feeds several branches, so that the
    costly side (a Python stage, a shuffle) runs once. `drop_staged` deletes the tables once their results are written.
    """
    spark = df.sparkSession
    at = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(at)
    _written.append(at)
    return spark.read.schema(df.schema).parquet(at)


def drop_staged(spark: SparkSession) -> int:
    """Delete the staged tables that this driver wrote so far; frames that read them can't run any more. Their number."""
    gone = 0
    while _written:
        at = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))
    return gone


def small(df: DataFrame, most: int = 32 << 20) -> bool:
    """Whether the values of `df`, a staged table, fit in `most` bytes, with 16 for each value besides: counted over all
    its rows, so what is broadcast has a known bound."""
    wide = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c, kind in df.dtypes if kind == "string" or kind.startswith(("array", "struct", "map"))]
    size = sum(wide, F.lit(16 * len(df.columns)))
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most


def newest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key: the largest by `order` (nulls lowest), ties by the whole row, so the choice is stable.

    `max(struct)` aggregates map-side, so a key that holds a third of all rows is no hot task.
    """
    rest = [c for c in df.columns if c not in keys]
    lead = [F.col(c).alias(f"__o{i}") for i, c in enumerate(order)]
    row = F.struct(*lead, *[F.col(c) for c in rest])
    return df.groupBy(*keys).agg(F.max(row).alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])
