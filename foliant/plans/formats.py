"""Queries of parsing: blocks are rendered in a format by Spark and parsed again, so work grows with the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import squeeze
from foliant.operators import formats as P
from foliant.plans.views import current, current_sql


def _escaped(text: Column) -> Column:
    t = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")
    return F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _rendered(spark: SparkSession, d: str, part: Column, head: str, tail: str) -> DataFrame:
    """One document a row: the parts of its blocks in order."""
    b = current(spark, d, "blocks", "block_id", "document_id", "block_ord", "text", "section", "page_start", "page_end", "kind").filter(F.col("text").rlike(r"[^\t\n\f\r ]"))
    rows = F.sort_array(F.collect_list(F.struct("block_ord", part.alias("p"))))  # the blocks of one document
    return b.groupBy("document_id").agg(rows.alias("r")).select("document_id", F.concat(F.lit(head), F.array_join(F.transform("r", lambda x: x["p"]), ""), F.lit(tail)).alias("source"))


def _compared(df: DataFrame) -> DataFrame:
    return df.select("document_id", "block_ord", F.md5(squeeze(F.col("text"))).alias("digest"), F.coalesce("section", F.lit("")).alias("section"))


def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    part = F.concat(F.lit("<h1>"), _escaped(F.coalesce("section", F.lit(""))), F.lit("</h1><p>"), _escaped(F.col("text")), F.lit("</p>"))
    return _compared(P.parsed(_rendered(spark, d, part, "<html><body><nav>menu</nav><main>", "</main><footer>end</footer></body></html>"), "document_id", "source", "html"))


def tei_blocks(spark: SparkSession, d: str) -> DataFrame:
    part = F.concat(F.lit("<div><head>"), _escaped(F.coalesce("section", F.lit(""))), F.lit("</head><p>"), _escaped(F.col("text")), F.lit("</p></div>"))
    return _compared(P.parsed(_rendered(spark, d, part, '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>', "</body></text></TEI>"), "document_id", "source", "grobid-tei"))


def jats_blocks(spark: SparkSession, d: str) -> DataFrame:
    part = F.concat(F.lit("<sec><title>"), _escaped(F.coalesce("section", F.lit(""))), F.lit("</title><p>"), _escaped(F.col("text")), F.lit("</p></sec>"))
    return _compared(P.parsed(_rendered(spark, d, part, "<article><body>", "</body></article>"), "document_id", "source", "jats"))


def paged_json_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = current(spark, d, "blocks", "block_id", "document_id", "block_ord", "text", "section", "page_start", "page_end", "kind")
    one = F.struct("block_ord", F.struct("text", "section", F.col("page_start").alias("pageStart"), F.col("page_end").alias("pageEnd"), "kind").alias("b"))
    rows = F.transform(F.sort_array(F.collect_list(one)), lambda x: x["b"])
    docs = b.groupBy("document_id").agg(F.to_json(F.struct(F.lit(1).alias("version"), rows.alias("blocks"))).alias("source"))
    got = docs.select("document_id", F.explode(P.paged_blocks(F.col("source"))).alias("b"))
    return got.groupBy("document_id").agg(F.count("*").alias("blocks"), F.sum(F.length("b.text")).alias("chars"), F.min("b.pageStart").alias("first_page"), F.max("b.pageEnd").alias("last_page"))


def content_list_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = current(spark, d, "blocks", "block_id", "document_id", "block_ord", "text", "section", "page_start", "kind")
    level = F.when(F.col("text") == F.col("section"), 1)
    one = F.struct("block_ord", F.struct(F.lit("text").alias("type"), "text", level.alias("text_level"), (F.col("page_start") - 1).alias("page_idx")).alias("b"))
    docs = b.groupBy("document_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["b"])).alias("source"))
    got = P.listed_blocks(docs, "document_id", "source")
    return got.groupBy("document_id").agg(F.count("*").alias("blocks"), F.count_if("is_heading").alias("headings"), F.max("page").alias("last_page"))


def format_detection(spark: SparkSession, d: str) -> DataFrame:
    """Formats by path, against those the index claims."""
    f = current(spark, d, "files", "path", "file_format")
    start = F.when(F.col("file_format") == "grobid-tei", "<TEI>").when(F.col("file_format") == "jats", "<article>").otherwise("")
    return f.groupBy("file_format", P.detected(F.col("path"), start).alias("detected")).agg(F.count("*").alias("files"))


QUERIES = {"html_blocks": html_blocks, "tei_blocks": tei_blocks, "jats_blocks": jats_blocks, "paged_json_blocks": paged_json_blocks, "content_list_blocks": content_list_blocks, "format_detection": format_detection}

_SQUEEZE = "trim(regexp_replace({0}, '[\\t\\n\\f\\r ]+', ' ', 'g'))"
_BLOCKS = f"""SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY block_ord) - 1 AS block_ord, md5({_SQUEEZE.format("regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g')")}) AS digest,
{_SQUEEZE.format("coalesce(section, '')")} AS section FROM {current_sql("blocks", "block_id", "document_id", "block_ord", "text", "section")} WHERE regexp_matches(text, '[^\\t\\n\\f\\r ]')"""
SQL = {
    "html_blocks": _BLOCKS,
    "tei_blocks": _BLOCKS,
    "jats_blocks": _BLOCKS,
    "paged_json_blocks": f"""SELECT document_id, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars, min(page_start) AS first_page, max(page_end) AS last_page
FROM {current_sql("blocks", "block_id", "document_id", "block_ord", "text", "page_start", "page_end")} WHERE trim(text) <> '' AND (page_start IS NULL) = (page_end IS NULL) AND (page_start IS NULL OR (page_start >= 1 AND page_end >= page_start)) GROUP BY document_id""",
    "content_list_blocks": f"""SELECT document_id, count(*) AS blocks, count_if(coalesce(text = section, false)) AS headings, max(page_start) AS last_page
FROM {current_sql("blocks", "block_id", "document_id", "block_ord", "text", "section", "page_start")} WHERE trim(text) <> '' GROUP BY document_id""",
    "format_detection": f"""SELECT file_format, CASE WHEN regexp_matches(lower(path), '\\.(md|markdown)$') THEN 'markdown' WHEN regexp_matches(lower(path), '\\.html?$') THEN 'html' WHEN regexp_matches(lower(path), '\\.docx$') THEN 'docx'
 WHEN regexp_matches(lower(path), 'content_list(_v2)?\\.json$|\\.mineru\\.json$') THEN 'mineru' WHEN regexp_matches(lower(path), 'scan\\.json$') THEN 'paged-text' WHEN file_format = 'grobid-tei' THEN 'grobid-tei' WHEN file_format = 'jats' THEN 'jats' ELSE 'text' END AS detected, count(*) AS files
FROM {current_sql("files", "path", "file_format")} GROUP BY ALL""",
}
