"""Queries of block merging, Markdown sections, outlines and bounded reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import heading, token_estimate
from foliant.operators import blocks as B
from foliant.operators import navigation as N
from foliant.plans.views import current, current_sql
from foliant.sources.tables import table


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Estimated against claimed tokens of every chunk."""
    return current(spark, d, "chunks", "id", "chunk_content", "tokens").select("id", token_estimate(F.col("chunk_content")).alias("estimate"), F.col("tokens").alias("claimed"))


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return B.reading_order(current(spark, d, "blocks")).select("document_id", "block_id", "place", "run")


def merge_blocks(spark: SparkSession, d: str) -> DataFrame:
    m = B.merged(current(spark, d, "blocks"))
    return m.select("document_id", "group_no", "blocks", F.md5("text").alias("digest"), "kind", "section", "page_start", "page_end", "line_start", "line_end")


def paragraph_spans(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs (split at blank lines) of every block: number and longest."""
    p = F.filter(F.split("text", r"\n{2,}"), lambda s: s != "")
    b = current(spark, d, "blocks", "block_id", "text").filter("text IS NOT NULL")
    return b.select("block_id", F.size(p).alias("paragraphs"), F.coalesce(F.array_max(F.transform(p, F.length)), F.lit(0)).alias("longest"))


def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    s = B.markdown_sections(table(spark, d, "documents").select("doc_id", "text").dropDuplicates(["doc_id"]))
    return s.select("doc_id", "section", "line_start", "line_end", F.md5("text").alias("digest"))


def chunk_headings(spark: SparkSession, d: str) -> DataFrame:
    """What is embedded of a chunk: heading and content, its estimate and short hash."""
    c, f = current(spark, d, "chunks", "id", "file_path", "chunk_content", "section"), current(spark, d, "files", "path", "title")
    x = c.join(f, c["file_path"] == f["path"], "left").withColumn("heading", heading(F.col("title"), F.col("section")))
    text = F.concat_ws("\n\n", F.nullif("heading", F.lit("")), "chunk_content")
    return x.select("id", "heading", token_estimate(text).alias("tokens"), F.substring(F.sha2(text, 256), 1, 12).alias("hash"))


def _passages(spark: SparkSession, d: str) -> DataFrame:
    c = current(spark, d, "chunks", "id", "file_path", "chunk_content", "chunk_index", "section", "page_start", "page_end")
    return c.select(F.col("file_path").alias("doc"), F.col("chunk_index").alias("idx"), "id", "section", "page_start", "page_end", token_estimate(F.coalesce("chunk_content", F.lit(""))).alias("tokens"))


def outline(spark: SparkSession, d: str) -> DataFrame:
    return N.outline(_passages(spark, d))


def title_prefix(spark: SparkSession, d: str) -> DataFrame:
    return N.without_common_head(N.outline(_passages(spark, d)).select("doc", "run", "section"))


def read_around(spark: SparkSession, d: str) -> DataFrame:
    """Two passages before and after the middle one of each document."""
    p = _passages(spark, d)
    return N.around(p, p.groupBy("doc").agg(F.floor(F.max("idx") / 2).alias("center"))).select("doc", "idx", "id")


def read_pages(spark: SparkSession, d: str) -> DataFrame:
    return N.pages(_passages(spark, d), 2, 3).select("doc", "idx", "id")


def read_budget(spark: SparkSession, d: str) -> DataFrame:
    return N.budget(_passages(spark, d), 1000).select("doc", "idx", "upto", "next", "shown")


QUERIES = {
    "token_estimates": token_estimates,
    "reading_order": reading_order,
    "merge_blocks": merge_blocks,
    "paragraph_spans": paragraph_spans,
    "markdown_sections": markdown_sections,
    "chunk_headings": chunk_headings,
    "outline": outline,
    "title_prefix": title_prefix,
    "read_around": read_around,
    "read_pages": read_pages,
    "read_budget": read_budget,
}

_WIDE = "\\x{3400}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}"


def _est(x: str) -> str:
    return f"CAST(greatest(1, length(regexp_replace({x}, '[^{_WIDE}]', '', 'g')) + (length(regexp_replace({x}, '[{_WIDE}]', '', 'g')) + 3) // 4) AS INTEGER)"


_JOIN = """(b.kind = x.kind AND b.section IS NOT DISTINCT FROM x.section AND b.page_start IS NOT DISTINCT FROM x.page_start AND b.page_end IS NOT DISTINCT FROM x.page_end
 AND ((b.line_start IS NULL AND x.line_start IS NULL) OR coalesce(b.line_end + 2 = x.line_start AND b.line_end - b.line_start = length(b.text) - length(replace(b.text, chr(10), '')), false)))"""
_ORDER = f"""blk AS (SELECT * REPLACE (coalesce(kind, '') AS kind), coalesce(kind, '') IN ('figure', 'table') AS floats FROM {current_sql("blocks")} WHERE regexp_matches(text, '\\S')),
n1 AS (SELECT *, row_number() OVER (PARTITION BY document_id, floats ORDER BY block_ord) AS k FROM blk),
s1 AS (SELECT x.*, CASE WHEN x.floats THEN 0 WHEN b.block_id IS NULL OR NOT {_JOIN} THEN 1 ELSE 0 END AS starts FROM n1 x LEFT JOIN n1 b ON b.document_id = x.document_id AND b.floats = x.floats AND b.k = x.k - 1),
r1 AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY document_id ORDER BY block_ord) AS BIGINT) AS run FROM s1),
o1 AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY run, floats, block_ord) AS place FROM r1)"""
_PASS = f"""p AS (SELECT file_path AS doc, chunk_index AS idx, id, section, page_start, page_end, {_est("coalesce(chunk_content, '')")} AS tokens
 FROM {current_sql("chunks", "id", "file_path", "chunk_content", "chunk_index", "section", "page_start", "page_end")})"""
_OUT = f"""{_PASS}, l AS (SELECT *, coalesce(section, '') AS s, lag(coalesce(section, '')) OVER (PARTITION BY doc ORDER BY idx) AS b FROM p),
g AS (SELECT *, CAST(sum(CASE WHEN b IS NULL OR b <> s THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY idx) AS BIGINT) AS run FROM l),
runs AS (SELECT doc, run, s AS section, min(idx) AS first, max(idx) AS last, count(*) AS passages, min(page_start) AS page_start, max(page_end) AS page_end FROM g GROUP BY doc, run, s)"""

SQL = {
    "token_estimates": f"SELECT id, {_est('chunk_content')} AS estimate, tokens AS claimed FROM {current_sql('chunks', 'id', 'chunk_content', 'tokens')}",
    "reading_order": f"WITH {_ORDER} SELECT document_id, block_id, place, run FROM o1",
    "merge_blocks": f"""WITH {_ORDER}, g1 AS (SELECT x.*, CASE WHEN b.block_id IS NULL OR NOT {_JOIN} THEN 1 ELSE 0 END AS g FROM o1 x LEFT JOIN o1 b ON b.document_id = x.document_id AND b.place = x.place - 1),
g2 AS (SELECT *, CAST(sum(g) OVER (PARTITION BY document_id ORDER BY place) AS BIGINT) AS group_no FROM g1)
SELECT document_id, group_no, count(*) AS blocks, md5(string_agg(text, chr(10) || chr(10) ORDER BY place)) AS digest, arg_min(kind, place) AS kind,
 first(section ORDER BY place) AS section, first(page_start ORDER BY place) AS page_start, first(page_end ORDER BY place) AS page_end, first(line_start ORDER BY place) AS line_start, last(line_end ORDER BY place) AS line_end
FROM g2 GROUP BY document_id, group_no""",
    "paragraph_spans": f"""SELECT block_id, len(p) AS paragraphs, coalesce(list_max(list_transform(p, lambda s: length(s))), 0) AS longest
FROM (SELECT block_id, list_filter(regexp_split_to_array(text, '\\n{{2,}}'), lambda s: s <> '') AS p FROM {current_sql("blocks", "block_id", "text")} WHERE text IS NOT NULL)""",
    "chunk_headings": f"""WITH x AS (SELECT c.id, concat_ws(' > ', nullif(f.title, ''), nullif(c.section, '')) AS heading, c.chunk_content
 FROM {current_sql("chunks", "id", "file_path", "chunk_content", "section")} c LEFT JOIN {current_sql("files", "path", "title")} f ON c.file_path = f.path),
y AS (SELECT id, heading, concat_ws(chr(10) || chr(10), nullif(heading, ''), chunk_content) AS t FROM x)
SELECT id, heading, {_est('t')} AS tokens, substr(sha256(t), 1, 12) AS hash FROM y""",
    "outline": f"WITH {_OUT} SELECT *, row_number() OVER (PARTITION BY doc, section ORDER BY run) AS nth FROM runs",
    "title_prefix": f"""WITH {_OUT}, h AS (SELECT doc, run, section, CASE WHEN section <> '' THEN split_part(section, ' / ', 1) END AS head FROM runs),
w AS (SELECT *, min(head) OVER d = max(head) OVER d AND max(CASE WHEN contains(section, ' / ') THEN 1 ELSE 0 END) OVER d = 1 AS common FROM h WINDOW d AS (PARTITION BY doc))
SELECT doc, run, section, CASE WHEN coalesce(common, false) AND contains(section, ' / ') THEN substr(section, strpos(section, ' / ') + 3) ELSE section END AS short FROM w""",
    "read_around": f"WITH {_PASS}, c AS (SELECT doc, max(idx) // 2 AS center FROM p GROUP BY doc) SELECT p.doc, idx, id FROM p JOIN c ON p.doc = c.doc WHERE idx BETWEEN center - 2 AND center + 2",
    "read_pages": f"""WITH {_PASS}, r AS (SELECT doc, min(idx) AS a, max(idx) AS b FROM p WHERE page_start <= 3 AND page_end >= 2 GROUP BY doc) SELECT p.doc, idx, id FROM p JOIN r ON p.doc = r.doc WHERE idx BETWEEN a AND b""",
    "read_budget": f"""WITH {_PASS}, u AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY doc ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, row_number() OVER (PARTITION BY doc ORDER BY idx) AS rn FROM p),
f AS (SELECT *, upto <= 1000 OR rn = 1 AS fits FROM u), n AS (SELECT *, min(CASE WHEN NOT fits THEN idx END) OVER (PARTITION BY doc) AS nxt FROM f)
SELECT doc, idx, upto, nxt AS next, CASE WHEN rn = 1 OR lag(section) OVER (PARTITION BY doc ORDER BY idx) IS DISTINCT FROM section THEN section END AS shown FROM n WHERE fits""",
}
