"""Queries of page alignment and corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.alignment import LEAST, STEP, WINDOW, aligned, corrected
from foliant.plans.views import current, current_sql

# Ligatures and marks of cut words, and what they stand for.
FIXES = [("\ufb01", "fi"), ("\ufb02", "fl"), ("\u00ac", "-"), ("\u2010", "-")]


def align_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of every chunk, found in the paged blocks of its document."""
    f = current(spark, d, "files", "path", "document_id")
    c = current(spark, d, "chunks", "id", "file_path", "chunk_content")
    passages = c.join(f, c["file_path"] == f["path"]).select(F.col("id").alias("row_id"), F.col("document_id").alias("doc"), F.col("chunk_content").alias("text"))
    b = current(spark, d, "blocks", "block_id", "document_id", "page_start", "text")
    return aligned(passages, b.select(F.col("document_id").alias("doc"), F.col("page_start").alias("page"), "text"))


def apply_fixes(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that the corrections change, and their new digest."""
    b = current(spark, d, "blocks", "block_id", "text").withColumn("fixed", corrected(F.col("text"), FIXES))
    return b.filter(~F.col("fixed").eqNullSafe(F.col("text")) & F.col("text").rlike(r"\S")).select("block_id", F.md5("fixed").alias("digest"))


QUERIES = {"align_pages": align_pages, "apply_fixes": apply_fixes}

_SK = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')"
_FIXED = "replace(replace(replace(replace(text, chr(64257), 'fi'), chr(64258), 'fl'), chr(172), '-'), chr(8208), '-')"
SQL = {
    "align_pages": f"""WITH b AS (SELECT document_id AS doc, page_start AS page, {_SK.format("text")} AS s FROM {current_sql("blocks", "block_id", "document_id", "page_start", "text")} WHERE page_start IS NOT NULL),
k AS (SELECT doc, w, min(page) AS page FROM (SELECT doc, page, unnest(list_transform(range(1, length(s) - {WINDOW - 2}), lambda i: substr(s, CAST(i AS INTEGER), {WINDOW}))) AS w FROM b WHERE length(s) >= {WINDOW}) GROUP BY doc, w HAVING min(page) = max(page)),
p AS (SELECT c.id AS row_id, f.document_id AS doc, {_SK.format("c.chunk_content")} AS s FROM {current_sql("chunks", "id", "file_path", "chunk_content")} c JOIN {current_sql("files", "path", "document_id")} f ON c.file_path = f.path),
a AS (SELECT DISTINCT row_id, doc, unnest(list_transform(range(1, length(s) - {WINDOW - 2}, {STEP}), lambda i: substr(s, CAST(i AS INTEGER), {WINDOW}))) AS w FROM p WHERE length(s) >= {WINDOW}),
v AS (SELECT row_id, page, count(*) AS hits FROM a JOIN k USING (doc, w) GROUP BY ALL HAVING count(*) >= {LEAST})
SELECT row_id, min(page) AS page_start, max(page) AS page_end, CAST(sum(hits) AS BIGINT) AS hits FROM v GROUP BY row_id""",
    "apply_fixes": f"SELECT block_id, md5({_FIXED}) AS digest FROM {current_sql('blocks', 'block_id', 'text')} WHERE {_FIXED} <> text AND regexp_matches(text, '\\S') AND regexp_matches({_FIXED}, '\\S')",
}
