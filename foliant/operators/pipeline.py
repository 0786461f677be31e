"""From files to chunks with vectors: read, cut, embed, publish. A document that fails at a stage is a row of failures.

    chunks, failures = chunked_files(folder(spark, root), root, embedding(provider))

Files are read, parsed and cut in one pass each, a document a row; the results of parsing are staged, for they feed both
the chunks and the failures. `rebuilt` publishes a new generation and leaves the live one where anything is wrong.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import short_hash
from foliant.operators import blocks as B
from foliant.operators import formats as P
from foliant.operators.chunking import Limits, routed
from foliant.operators.navigation import relative
from foliant.sources.files import Generations
from foliant.sources.tables import staged

FIELDS = ["document_id", "block_ord", "text", "section", "page_start", "page_end", "line_start", "line_end", "kind"]


def parsed_files(files: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Files (path, content, error) -> documents' blocks with path and file_format, and failures (path, stage, error).

    Document ids are hashes of paths below the root. Empty and unreadable files, and those without text, are failures.
    """
    start = F.decode(F.substring("content", 1, 4096), "UTF-8")
    x = files.withColumn("document_id", short_hash(relative(F.col("path"), root.rstrip("/") + "/"))).withColumn("file_format", P.detected(F.col("path"), start))
    marked, paged = F.col("file_format") == "markdown", F.col("file_format") == "paged-text"
    text = F.col("content").cast("string")
    read = F.when(~marked & ~paged & F.col("error").isNull(), P.read_any("content", "file_format"))
    got = staged(x.select("path", "document_id", "file_format", F.col("error").alias("scan"), read.alias("b"), F.when((marked | paged) & F.col("error").isNull(), text).alias("source")), "parsed")
    about = got.select("document_id", "path", "file_format")
    shown = got.select("document_id", F.posexplode("b.blocks").alias("block_ord", "x")).select("document_id", "block_ord", "x.*").drop("images")
    listed = got.filter(F.col("file_format") == "paged-text").select("document_id", F.posexplode(P.paged_blocks(F.col("source"))).alias("block_ord", "x"))
    listed = listed.select("document_id", "block_ord", "x.text", "x.section", F.col("x.pageStart").alias("page_start"), F.col("x.pageEnd").alias("page_end"), F.coalesce("x.kind", F.lit("")).alias("kind"))
    cut = B.markdown_sections(got.filter(F.col("file_format") == "markdown").select(F.col("document_id").alias("doc_id"), F.col("source").alias("text")))
    cut = cut.select(F.col("doc_id").alias("document_id"), F.col("section_no").cast("int").alias("block_ord"), "text", F.nullif("section", F.lit("")).alias("section"), "line_start", "line_end", F.lit("").alias("kind"))
    every = shown.unionByName(listed, True).unionByName(cut, True).select(*FIELDS).join(about, "document_id")
    full = every.select("document_id").distinct()
    empty = got.filter("scan IS NULL AND b.error IS NULL").join(full, "document_id", "left_anti").select("path", F.lit("parse").alias("stage"), F.lit("no text").alias("error"))
    failed = got.filter("scan IS NOT NULL OR b.error IS NOT NULL").select("path", F.when(F.col("scan").isNotNull(), "scan").otherwise("parse").alias("stage"), F.coalesce("scan", "b.error").alias("error"))
    return every, failed.unionByName(empty)


def chunked(blocks: DataFrame, embed: Callable[[Column], Column], limits: Limits = Limits(), mode: str = "semantic") -> DataFrame:
    """Blocks with path and file_format as routed chunks."""
    about = blocks.groupBy("document_id").agg(F.max(F.struct("path", "file_format")).alias("d")).select("document_id", "d.*")
    return routed(B.merged(blocks).join(about, "document_id"), embed, limits, mode).join(about.select("document_id", "path"), "document_id")


def chunked_files(files: DataFrame, root: str, embed: Callable[[Column], Column], limits: Limits = Limits(), mode: str = "semantic") -> tuple[DataFrame, DataFrame]:
    """Files as chunks with their unit vectors, and the failures of all stages."""
    blocks, failures = parsed_files(files, root)
    return chunked(blocks, embed, limits, mode).withColumn("vector", embed(F.col("content"))), failures


def rebuilt(index: Generations, chunks: DataFrame, failures: DataFrame, keep: int = 2) -> str:
    """Publish the chunks as the next generation and keep `keep` in all; its name. With failures nothing is published."""
    if bad := failures.count():
        raise ValueError(f"{bad} files failed; the live generation stays")
    live = index.active()
    name = f"g{(int(live[1:]) if live else 0) + 1:09d}"
    whole = staged(chunks, "chunks")
    index.publish(whole, name, whole.filter("vector IS NOT NULL").select("id"))
    index.clean(keep)
    return name
