"""Queries of page converters' exports, of pages taken from them, and of chunks by route.

Exports are rendered by Spark from the library's blocks in each dialect, then read back, so work grows with the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.text import squeeze
from foliant.operators import blocks as B
from foliant.operators import chunking as C
from foliant.operators import exports as X
from foliant.operators import formats as P
from foliant.operators import paging as G
from foliant.operators.alignment import LEAST, STEP, WINDOW
from foliant.operators.models import HashedWords, embedding
from foliant.plans.reading import _JOIN, _ORDER
from foliant.plans.views import current, current_sql

_COLUMNS = ("block_id", "document_id", "block_ord", "text", "section", "page_start", "page_end")


def _said(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("content")))


def _spans(text: Column, crossing: Column | None = None) -> Column:
    lines = F.split(text, "\n")
    marked = lambda i: [(crossing & (i == F.size(lines) - 1)).alias("cross_page")] if crossing is not None else []
    return F.transform(lines, lambda t, i: F.struct(F.array(F.struct(F.lit("text").alias("type"), t.alias("content"), *marked(i))).alias("spans")))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _rendered(spark: SparkSession, d: str) -> DataFrame:
    """(dialect, document_id, source): every document in all dialects, sections as headings before their blocks."""
    text, lit = F.col("text"), F.lit
    b = current(spark, d, "blocks", *_COLUMNS).filter(text.rlike(r"[^\t\n\f\r ]"))
    head = F.when(F.col("section").rlike(r"[^\t\n\f\r ]") & ~F.col("section").rlike(r"[.。]\s*$"), F.col("section"))
    b = b.withColumn("head", head).withColumn("at", F.when(F.col("page_start") >= 1, F.col("page_start") - 1))
    b = b.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy("block_ord", "block_id")) - 1)
    t, h, at = text, F.col("head"), F.col("at")
    pairs = {
        "flat": (_json(type=lit("text"), text=h, text_level=lit(1), page_idx=at), _json(type=lit("text"), text=t, page_idx=at)),
        "nested": (_json(type=lit("title"), content=F.struct(_said(h).alias("title_content"), lit(1).alias("level"))), _json(type=lit("paragraph"), content=F.struct(_said(t).alias("paragraph_content")))),
        "paged": (_json(type=lit("title"), text=h, level=lit(1)), _json(type=lit("text"), content=_said(t))),
        "lines": (_json(type=lit("title"), lines=_spans(h)), _json(type=lit("text"), lines=_spans(t))),
    }
    parts = {k: F.concat_ws(",", F.when(F.col("head").isNotNull(), a), z) for k, (a, z) in pairs.items()}
    for k, name in (("paged", "blocks"), ("lines", "para_blocks")):
        parts[k] = F.concat(lit('{"page_idx":'), F.col("n"), lit(f',"{name}":['), parts[k], lit("]}"))
    around = {"flat": ("[", "]"), "nested": ("[[", "]]"), "paged": (f'{{"schema":"{X.SCHEMA}","schema_version":"{X.VERSION}","pages":[', "]}"), "lines": ('{"pdf_info":[', "]}")}
    each = b.select("document_id", "n", F.explode(F.array(*[F.struct(lit(k).alias("dialect"), p.alias("p")) for k, p in parts.items()])).alias("x")).select("document_id", "n", "x.*")
    rows = F.sort_array(F.collect_list(F.struct("n", "p")))  # the blocks of one document
    whole = each.groupBy("dialect", "document_id").agg(F.array_join(F.transform(rows, lambda r: r["p"]), ",").alias("s"))
    first, last = (F.create_map(*[lit(v) for k, a in around.items() for v in (k, a[i])]) for i in (0, 1))
    return whole.select("dialect", "document_id", F.concat(first[F.col("dialect")], "s", last[F.col("dialect")]).alias("source"))


def export_dialects(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of every document from each dialect of an export; headings are blocks too."""
    x = _rendered(spark, d).withColumn("key", F.struct("dialect", "document_id"))
    got = P.parsed(x, "key", "source", "mineru")
    return got.select("key.dialect", "key.document_id", "block_ord", F.md5(squeeze(F.col("text"))).alias("digest"), F.coalesce("section", F.lit("")).alias("section"), F.col("page_start").alias("page"))


def cross_page_text(spark: SparkSession, d: str) -> DataFrame:
    """The text of each page by spans; the last line of a block that ends on a later page stands on the next one."""
    b = current(spark, d, "blocks", *_COLUMNS).filter("page_start >= 1 AND text IS NOT NULL")
    one = F.struct("block_ord", "block_id", F.col("page_start").alias("p"), _spans(F.col("text"), F.coalesce(F.col("page_end") > F.col("page_start"), F.lit(False))).alias("l"))
    pages = F.transform(F.sort_array(F.collect_list(one)), lambda r: F.struct((r["p"] - 1).alias("page_idx"), F.array(F.struct(r["l"].alias("lines"))).alias("para_blocks")))
    docs = b.groupBy("document_id").agg(F.to_json(F.struct(pages.alias("pdf_info"))).alias("source"))
    rows = F.sort_array(F.collect_list(F.struct("at", "text")))  # the spans of one page
    g = X.spans(docs, "document_id", "source").groupBy("document_id", "page").agg(rows.alias("r"))
    return g.select("document_id", "page", F.size("r").alias("spans"), F.md5(F.array_join(F.transform("r", lambda r: r["text"]), "\n")).alias("digest"))


def paged_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of every block with the pages of its document's export."""
    b = current(spark, d, "blocks", *_COLUMNS).withColumnRenamed("document_id", "doc")
    paged = b.select("doc", F.col("page_start").alias("page"), "text")
    got, _ = G.paged_paragraphs(b.select("doc", "block_ord", "text", F.lit(1).alias("line_start")), paged)
    return got.select("doc", "block_ord", "part", "line_start", "line_end", "page_start", "page_end", F.md5("text").alias("digest"))


def figure_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunk that each figure belongs to."""
    images = F.when(F.col("kind") == "figure", F.array("block_id")).otherwise(F.array().cast("array<string>"))
    b = current(spark, d, "blocks", "block_id", "document_id", "block_ord", "text", "kind")
    b = b.select(F.col("block_id").alias("row_id"), F.col("document_id").alias("doc"), F.col("block_ord").alias("place"), "text", images.alias("images"))
    f = current(spark, d, "files", "path", "document_id")
    c = current(spark, d, "chunks", "id", "file_path", "chunk_content", "chunk_index").join(f, F.col("file_path") == F.col("path"))
    return G.figure_places(b, c.select(F.col("document_id").alias("doc"), "chunk_index", F.col("chunk_content").alias("text"))).select("doc", "chunk_index", "image")


def _routed(spark: SparkSession, d: str) -> DataFrame:
    about = current(spark, d, "files", "path", "document_id", "file_format")
    return C.routed(B.merged(current(spark, d, "blocks")).join(about, "document_id"), embedding(HashedWords()))


def chunk_routes(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of every document by its format's route."""
    return _routed(spark, d).withColumn("digest", F.md5("content")).drop("content")


_BLANK = r"[\s\p{Z}]+"


def chunk_cover(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by meaning, put together again: nothing of a block is lost or twice."""
    rows = F.sort_array(F.collect_list(F.struct("chunk_index", "content")))  # the chunks of one block
    g = _routed(spark, d).filter("route = 'meaning'").groupBy("document_id", "group_no").agg(rows.alias("r"))
    return g.select("document_id", "group_no", F.md5(F.regexp_replace(F.array_join(F.transform("r", lambda r: r["content"]), ""), _BLANK, "")).alias("digest"))


def unit_cover(spark: SparkSession, d: str) -> DataFrame:
    """Units of each block, put together again: nothing is lost or twice."""
    u = C.unit_rows(current(spark, d, "blocks", "block_id", "text"), ["block_id"])
    g = u.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("unit_no", "unit"))).alias("r"))
    return g.select("block_id", F.md5(F.regexp_replace(F.array_join(F.transform("r", lambda r: r["unit"]), ""), _BLANK, "")).alias("digest"))


QUERIES = {
    "export_dialects": export_dialects,
    "cross_page_text": cross_page_text,
    "paged_paragraphs": paged_paragraphs,
    "figure_chunks": figure_chunks,
    "chunk_routes": chunk_routes,
    "chunk_cover": chunk_cover,
    "unit_cover": unit_cover,
}

_SQUEEZE = "trim(regexp_replace({0}, '[\\t\\n\\f\\r ]+', ' ', 'g'))"
_SK = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')"
_BARE = "md5(regexp_replace({0}, '[\\s\\x0B\\p{{Z}}]+', '', 'g'))"
# From pas (row_id, doc, text) and ref (doc, page, text): loc (row_id, doc, long, page_start, page_end) of the documents that match.
_ALIGN = f"""rs AS (SELECT doc, page, {_SK.format("text")} AS s FROM ref WHERE page IS NOT NULL),
rk AS (SELECT doc, w, min(page) AS page FROM (SELECT doc, page, unnest(list_transform(range(1, length(s) - {WINDOW - 2}), lambda i: substr(s, CAST(i AS INTEGER), {WINDOW}))) AS w FROM rs WHERE length(s) >= {WINDOW}) GROUP BY doc, w HAVING min(page) = max(page)),
ps AS (SELECT row_id, doc, {_SK.format("text")} AS s FROM pas),
pw AS (SELECT DISTINCT row_id, doc, unnest(list_transform(range(1, length(s) - {WINDOW - 2}, {STEP}), lambda i: substr(s, CAST(i AS INTEGER), {WINDOW}))) AS w FROM ps WHERE length(s) >= {WINDOW}),
pv AS (SELECT row_id, page, count(*) AS hits FROM pw JOIN rk USING (doc, w) GROUP BY ALL HAVING count(*) >= {LEAST}),
pf AS (SELECT row_id, min(page) AS page_start, max(page) AS page_end FROM pv GROUP BY row_id),
pl AS (SELECT ps.row_id, doc, coalesce(length(s) >= {WINDOW}, false) AS long, page_start, page_end FROM ps LEFT JOIN pf ON ps.row_id = pf.row_id),
loc AS (SELECT * FROM pl WHERE doc IN (SELECT doc FROM pl GROUP BY doc HAVING count_if(long AND page_start IS NOT NULL) >= {G.SHARE} * count_if(long)))"""
_HEAD = "CASE WHEN regexp_matches(section, '[^\\t\\n\\f\\r ]') AND NOT regexp_matches(section, '[.。]\\s*$') THEN section END"
SQL = {
    "export_dialects": f"""WITH b AS (SELECT *, {_HEAD} AS head, row_number() OVER (PARTITION BY document_id ORDER BY block_ord, block_id) AS n FROM {current_sql("blocks", *_COLUMNS)} WHERE regexp_matches(text, '[^\\t\\n\\f\\r ]')),
i AS (SELECT document_id, n, 0 AS body, {_SQUEEZE.format("head")} AS t, {_SQUEEZE.format("head")} AS h, page_start FROM b WHERE head IS NOT NULL UNION ALL SELECT document_id, n, 1, {_SQUEEZE.format("text")}, NULL, page_start FROM b),
s AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY n, body ROWS UNBOUNDED PRECEDING) AS section FROM i),
k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n, body) - 1 AS block_ord FROM s WHERE coalesce(lower(section) NOT IN ('references', 'bibliography', '参考文献'), true))
SELECT dialect, document_id, block_ord, md5(t) AS digest, coalesce(section, '') AS section, CASE dialect WHEN 'flat' THEN CASE WHEN page_start >= 1 THEN page_start END WHEN 'nested' THEN NULL ELSE n END AS page FROM k, (VALUES ('flat'), ('nested'), ('paged'), ('lines')) v(dialect)""",
    "cross_page_text": f"""WITH b AS (SELECT *, string_split(text, chr(10)) AS l FROM {current_sql("blocks", *_COLUMNS)} WHERE page_start >= 1 AND text IS NOT NULL),
u AS (SELECT document_id, block_ord, block_id, page_start, page_end, len(l) AS n, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM b),
p AS (SELECT *, page_start + CASE WHEN i = n AND coalesce(page_end > page_start, false) THEN 1 ELSE 0 END AS page FROM u WHERE regexp_matches(t, '\\S'))
SELECT document_id, page, count(*) AS spans, md5(string_agg(t, chr(10) ORDER BY block_ord, block_id, i)) AS digest FROM p GROUP BY document_id, page""",
    "paged_paragraphs": f"""WITH b AS (SELECT *, string_split(text, chr(10)) AS l FROM {current_sql("blocks", *_COLUMNS)} WHERE regexp_matches(text, '\\S')),
u AS (SELECT document_id AS doc, block_ord, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM b),
e AS (SELECT *, regexp_matches(t, '\\S') AS full_ FROM u), z AS (SELECT *, CASE WHEN full_ AND NOT coalesce(lag(full_) OVER (PARTITION BY doc, block_ord ORDER BY i), false) THEN 1 ELSE 0 END AS st FROM e),
y AS (SELECT *, CAST(sum(st) OVER (PARTITION BY doc, block_ord ORDER BY i) AS INTEGER) AS part FROM z),
g AS (SELECT doc, block_ord, part, min(i) AS line_start, max(i) AS line_end, string_agg(t, chr(10) ORDER BY i) AS text FROM y WHERE full_ GROUP BY doc, block_ord, part),
pas AS (SELECT concat_ws(':', doc, block_ord, part) AS row_id, * FROM g), ref AS (SELECT document_id AS doc, page_start AS page, text FROM b), {_ALIGN},
j AS (SELECT pas.*, page_start AS a, page_end AS z, last_value(page_end IGNORE NULLS) OVER (PARTITION BY pas.doc ORDER BY block_ord, part ROWS UNBOUNDED PRECEDING) AS pv_, last_value(page_start IGNORE NULLS) OVER (PARTITION BY pas.doc ORDER BY block_ord DESC, part DESC ROWS UNBOUNDED PRECEDING) AS nx FROM pas JOIN loc ON pas.row_id = loc.row_id)
SELECT doc, block_ord, part, line_start, line_end, coalesce(a, pv_, nx) AS page_start, coalesce(z, greatest(coalesce(nx, pv_), coalesce(pv_, nx))) AS page_end, md5(text) AS digest FROM j""",
    "figure_chunks": f"""WITH b AS (SELECT * FROM {current_sql("blocks", "block_id", "document_id", "block_ord", "text", "kind")}), pas AS (SELECT block_id AS row_id, document_id AS doc, text FROM b),
ref AS (SELECT f.document_id AS doc, chunk_index AS page, chunk_content AS text FROM {current_sql("chunks", "id", "file_path", "chunk_content", "chunk_index")} c JOIN {current_sql("files", "path", "document_id")} f ON c.file_path = f.path), {_ALIGN},
x AS (SELECT b.*, last_value(loc.page_end IGNORE NULLS) OVER (PARTITION BY b.document_id ORDER BY block_ord ROWS UNBOUNDED PRECEDING) AS chunk_index FROM b JOIN loc ON b.block_id = loc.row_id)
SELECT document_id AS doc, chunk_index, block_id AS image FROM x WHERE kind = 'figure' AND chunk_index IS NOT NULL""",
    "chunk_cover": f"""WITH {_ORDER}, g1 AS (SELECT x.*, CASE WHEN b.block_id IS NULL OR NOT {_JOIN} THEN 1 ELSE 0 END AS g FROM o1 x LEFT JOIN o1 b ON b.document_id = x.document_id AND b.place = x.place - 1),
g2 AS (SELECT *, CAST(sum(g) OVER (PARTITION BY document_id ORDER BY place) AS BIGINT) AS group_no FROM g1), m AS (SELECT document_id, group_no, string_agg(text, '' ORDER BY place) AS t FROM g2 GROUP BY ALL)
SELECT m.document_id, group_no, {_BARE.format("t")} AS digest FROM m JOIN {current_sql("files", "path", "document_id", "file_format")} f ON m.document_id = f.document_id WHERE coalesce(file_format, 'text') <> 'text' OR regexp_matches(path, '(?i)(\\.txt$|(^|/)rag-source\\.json$)')""",
    "unit_cover": f"SELECT block_id, {_BARE.format('text')} AS digest FROM {current_sql('blocks', 'block_id', 'text')} WHERE regexp_matches(text, '\\S')",
}
