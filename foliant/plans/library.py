"""Queries of the catalog, of synchronisation and of evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.text import normal_doi, year_of
from foliant.operators import catalog as C
from foliant.operators import evaluation as E
from foliant.operators import sync as S
from foliant.operators.inputs import folder_of, input_files, json_hash, stale
from foliant.operators.literal import containing
from foliant.operators.lexical import bm25, documents_of
from foliant.plans.reading import _est
from foliant.plans.retrieval import _bm25_sql, _tok
from foliant.plans.views import current, current_sql
from foliant.sources.tables import newest, staged, table

ROOT = "/library/"


def list_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every file with its preferred title (its own, else that of its linked item), path below the root, and version."""
    f = current(spark, d, "files", "path", "document_id", "title", "hash")
    titles = _links(spark, d).join(current(spark, d, "zotero_items", "item_key", "title").withColumnRenamed("title", "item_title"), "item_key").select(F.col("document").alias("document_id"), "item_title")
    x = f.join(titles.groupBy("document_id").agg(F.min("item_title").alias("item_title")), "document_id", "left")
    rel = F.expr(f"if(startswith(path, '{ROOT}'), substring(path, {len(ROOT) + 1}), path)")
    return x.select("document_id", F.coalesce(F.nullif("title", F.lit("")), F.nullif("item_title", F.lit("")), rel).alias("title"), rel.alias("rel"), F.substring("hash", 1, 12).alias("version"))


def resolve_document(spark: SparkSession, d: str) -> DataFrame:
    """Item titles as references to files: exact title or else the unique file whose title holds it; otherwise an error."""
    f = current(spark, d, "files", "path", "title").filter("title <> ''").select("path", F.lower("title").alias("t"))
    refs = current(spark, d, "zotero_items", "item_key", "title", "item_type").filter("item_type <> 'attachment' AND length(title) >= 12").select("item_key", F.lower("title").alias("r"))
    ids = refs.select("r").distinct().withColumn("query_id", F.xxhash64("r"))
    within = containing(f.select(F.col("path").alias("row_id"), F.col("t").alias("text")), ids.select("query_id", F.col("r").alias("pattern")))
    counted = within.groupBy("query_id").agg(F.count("*").alias("n"), F.min("row_id").alias("path"))
    x = refs.join(ids, "r").join(counted, "query_id", "left")
    state = F.when(F.coalesce("n", F.lit(0)) == 0, "missing").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return x.select("item_key", state.alias("state"), F.when(state == "found", F.col("path")).alias("path"))


def index_status(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the index: files, embedded files, chunks, missing chunks, newest time."""
    f = current(spark, d, "files", "path", "chunks", "embedded", "indexed")
    c = current(spark, d, "chunks", "id", "file_path").groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("have"))
    x = f.join(c, "path", "left")
    return x.agg(F.count("*").alias("files"), F.count_if("embedded").alias("embedded"), F.sum(F.coalesce("have", F.lit(0))).alias("chunks"), F.count_if(F.coalesce("have", F.lit(0)) != F.coalesce("chunks", F.lit(0))).alias("off"), F.max("indexed").alias("newest"))


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d, "files", "path", "hash", "file_format", "parser_version").select("path", S.fingerprint("path", "hash", "file_format", "parser_version").alias("fingerprint"))


def _oldest(spark: SparkSession, d: str) -> DataFrame:
    """The first state of each path, and every seventh path by digest left out: an earlier snapshot."""
    f = table(spark, d, "files").filter("path IS NOT NULL")
    first = newest(f.select("path", "hash", "document_id", "embedded", (-F.unix_micros(F.col("indexed").cast("timestamp"))).alias("age")), ["path"], "age")
    return first.filter(F.substring(F.md5("path"), 1, 1) != "7")


def sync_diff(spark: SparkSession, d: str) -> DataFrame:
    now = current(spark, d, "files", "path", "hash").filter(F.substring(F.md5("path"), 1, 1) != "e")
    return S.difference(_oldest(spark, d).select("path", F.col("hash").alias("mark")), now.select("path", F.col("hash").alias("mark")))


def incremental_skip(spark: SparkSession, d: str) -> DataFrame:
    return S.pending(current(spark, d, "files", "path", "hash"), _oldest(spark, d)).select("path")


def replace_document(spark: SparkSession, d: str) -> DataFrame:
    index = _oldest(spark, d).select("path", "document_id", "hash")
    now = current(spark, d, "files", "path", "document_id", "hash")
    diff = S.difference(index.withColumnRenamed("hash", "mark"), now.withColumnRenamed("hash", "mark"))
    incoming = now.join(diff.filter("state IN ('added', 'changed')"), "path", "left_semi")
    gone = diff.filter("state = 'removed'").select("path")
    return S.replaced(index, incoming, gone)


def generation_retention(spark: SparkSession, d: str) -> DataFrame:
    """Parser versions as generations of the index: the active one and the newest others are kept."""
    g = current(spark, d, "files", "path", "parser_version", "indexed").filter("parser_version IS NOT NULL").groupBy(F.col("parser_version").alias("generation")).agg(F.max("indexed").alias("created"))
    return S.retained(g, "v3", 2)


def canonical_files(spark: SparkSession, d: str) -> DataFrame:
    return S.canonical(current(spark, d, "files", "path"))


def snapshot_signature(spark: SparkSession, d: str) -> DataFrame:
    """One signature of all current paths and hashes."""
    return S.signature(current(spark, d, "files", "path", "hash"), "path", "hash")


def content_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key of every document, by content."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text").dropDuplicates(["doc_id"])
    return docs.select("doc_id", S.content_key(F.col("text")).alias("key"))


def snapshot_apply(spark: SparkSession, d: str) -> DataFrame:
    """The first states of all items as the catalog, their newest as the snapshot: what happens to each."""
    i = table(spark, d, "zotero_items").filter("item_key IS NOT NULL").select("item_key", "item_version", "content_hash", "deleted")
    old = newest(i.withColumn("age", -F.col("item_version")), ["item_key"], "age").filter(F.substring(F.md5("item_key"), 1, 1) != "3")
    new = newest(i, ["item_key"], "item_version").filter(F.substring(F.md5("item_key"), 1, 1) != "9")
    return C.apply_snapshot(old, new)


def _items(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d, "zotero_items", "library_type", "library_id", "item_key", "item_version", "item_type", "title", "doi", "item_year", "parent_key", "filename", "attachment_path", "deleted")


def _links(spark: SparkSession, d: str) -> DataFrame:
    f = current(spark, d, "files", "path", "document_id", "source_path", "doi")
    f = f.select(F.col("document_id").alias("document"), F.coalesce("source_path", F.lit("")).alias("place"), F.regexp_extract(F.coalesce("source_path", F.lit("")), r"([^/]*)$", 1).alias("name"), normal_doi(F.col("doi")).alias("doi"))
    works = _items(spark, d).filter("item_type <> 'attachment'").filter(~F.coalesce("deleted", F.lit(False)))
    return C.linked(f, works.select("item_key", normal_doi(F.col("doi")).alias("doi"), F.lower(F.trim("title")).alias("title")), C.attachments(_items(spark, d)))


def attachment_match(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d)


def links_export(spark: SparkSession, d: str) -> DataFrame:
    """Links as they are handed out: document and path, the item's full reference, and how it was found."""
    f = current(spark, d, "files", "path", "document_id").withColumnRenamed("document_id", "document")
    i = _items(spark, d).select("item_key", "library_type", "library_id")
    x = _links(spark, d).join(f, "document").join(i, "item_key")
    return x.select("document", "path", "library_type", "library_id", "item_key", F.col("how").alias("match_method"))


def item_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Content hashes of items' JSON, without their versions; keys stand in the table's order, which doesn't count."""
    i = current(spark, d, "zotero_items", "item_key", "item_version", "title", "doi", "item_type")
    text = F.to_json(F.struct(F.coalesce("title", F.lit("")).alias("title"), F.col("item_version").alias("version"), F.col("item_type").alias("type"), F.coalesce("doi", F.lit("")).alias("doi")))
    return i.select("item_key", json_hash(text, ("version",)).alias("hash"))


def input_sets(spark: SparkSession, d: str) -> DataFrame:
    """The files that each document is made of; a manifest a folder and a layout beside each export are rendered from the paths."""
    f = current(spark, d, "files", "path", "hash", "size").withColumn("folder", folder_of(F.col("path")))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    one = f.groupBy("folder").agg(F.min(name).alias("name"), F.max(name == "content_list.json").alias("export"))
    path = lambda n: F.concat("folder", F.lit("/" + n)).alias("path")
    manifest = F.to_json(F.struct(F.lit(1).alias("version"), F.concat(F.lit("./x/../"), F.col("name")).alias("contentPath"))).alias("content")
    text = f.select("path", "size", F.coalesce("hash", F.lit("")).alias("content"))
    listing = text.unionByName(one.select(path("rag-source.json"), F.lit(100).alias("size"), manifest)).unionByName(one.filter("export").select(path("layout.json"), F.lit(100).alias("size"), F.lit("{}").alias("content")))
    return input_files(listing.withColumn("content", F.to_binary("content", F.lit("utf-8"))))


def stale_versions(spark: SparkSession, d: str) -> DataFrame:
    """Documents as an earlier state of the library knew them, where they have changed since."""
    version = F.substring(F.coalesce("hash", F.lit("")), 1, 12).alias("version")
    return stale(_oldest(spark, d).select("document_id", version), current(spark, d, "files", "path", "document_id", "hash").select("document_id", version))


def title_candidates(spark: SparkSession, d: str) -> DataFrame:
    f = current(spark, d, "files", "path", "document_id", "title").select(F.col("document_id").alias("document"), "title")
    return C.title_candidates(f, _items(spark, d).filter("item_type <> 'attachment'").select("item_key", "title"))


def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    return C.allowed(_links(spark, d), _items(spark, d), 2005, 2015, ("user", "4410021"))


def library_alias(spark: SparkSession, d: str) -> DataFrame:
    """The library id of each type that was synchronised last."""
    return table(spark, d, "zotero_items").groupBy("library_type").agg(F.max_by("library_id", F.struct("synced_at", "library_id")).alias("library_id"), F.max("synced_at").alias("synced_at"))


def catalog_status(spark: SparkSession, d: str) -> DataFrame:
    """Items, attachments, deleted items, items without parent, by library."""
    i = _items(spark, d)
    living = i.filter("NOT coalesce(deleted, false)").select(F.col("item_key").alias("parent_key"), F.lit(1).alias("has"))
    x = i.join(living, "parent_key", "left")
    attached = F.col("item_type") == "attachment"
    gone = F.coalesce("deleted", F.lit(False))
    return x.groupBy("library_type", "library_id").agg(F.count_if(~attached & ~gone).alias("items"), F.count_if(attached & ~gone).alias("attachments"), F.count_if(gone).alias("deleted"), F.count_if(attached & ~gone & F.col("has").isNull()).alias("orphans"))


def item_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Each living item with its creators in order."""
    c = table(spark, d, "zotero_creators").select("item_key", "creator_pos", F.coalesce(F.nullif("full_name", F.lit("")), F.concat_ws(", ", F.nullif("family", F.lit("")), F.nullif("given", F.lit("")))).alias("name")).distinct()
    names = c.groupBy("item_key").agg(F.sort_array(F.collect_list(F.struct("creator_pos", "name"))).alias("c"))  # the people of one item
    i = _items(spark, d).filter("item_type <> 'attachment' AND NOT coalesce(deleted, false)")
    return i.join(names, "item_key", "left").select("item_key", "title", F.array_join(F.transform("c", lambda r: r["name"]), "; ").alias("creators"))


def doi_year(spark: SparkSession, d: str) -> DataFrame:
    i = current(spark, d, "zotero_items", "item_key", "doi", "date_raw", "item_year").filter("doi IS NOT NULL OR date_raw IS NOT NULL")
    return i.select("item_key", normal_doi(F.col("doi")).alias("doi"), F.coalesce("item_year", year_of(F.col("date_raw"))).alias("year"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a case's passage literally."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("row_id"), "text").dropDuplicates(["row_id"])
    return containing(docs, table(spark, d, "eval_cases").select(F.col("case_id").alias("query_id"), F.col("passage").alias("pattern")))


def _hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Documents ranked for the first words of each passage."""
    docs = table(spark, d, "documents").select("doc_id", "text").dropDuplicates(["doc_id"])
    asked = table(spark, d, "eval_cases").filter("passage IS NOT NULL").select(F.col("case_id").alias("query_id"), F.array_join(F.slice(F.split("passage", r"\s+"), 1, 6), " ").alias("query")).distinct()
    return bm25(documents_of(docs, "doc_id", ["text"]), asked, k).withColumn("row_id", F.col("row_id").cast("string"))


def eval_recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    return E.scored(_labels(spark, d), _hits(spark, d, 30), 5)


def eval_modes(spark: SparkSession, d: str) -> DataFrame:
    """Mean recall and reciprocal rank at several depths."""
    labels, hits = staged(_labels(spark, d), "labels"), staged(_hits(spark, d, 30), "hits")
    parts = [E.scored(labels, hits, k).agg(F.lit(k).alias("k"), F.count("*").alias("cases"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr")) for k in (1, 5, 30)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def eval_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles of text lengths by source."""
    docs = table(spark, d, "documents").select(F.lower(F.trim("source")).alias("source"), F.length("text").alias("chars"))
    return E.nearest_rank(docs, ["source"], "chars", {"p50": 0.5, "p95": 0.95})


def eval_cost(spark: SparkSession, d: str) -> DataFrame:
    """What embedding the chunks of each format costs; code has no rate."""
    from foliant.functions.text import token_estimate

    c, f = current(spark, d, "chunks", "id", "file_path", "chunk_content"), current(spark, d, "files", "path", "file_format")
    x = c.join(f, c["file_path"] == f["path"], "left").groupBy("file_format").agg(F.count("*").alias("calls"), F.sum(token_estimate(F.col("chunk_content"))).alias("tokens"))
    return x.select("file_format", "calls", "tokens", F.when(F.col("file_format") == "text", E.cost(F.col("calls"), F.col("tokens"), None)).otherwise(E.cost(F.col("calls"), F.col("tokens"), 0.02)).alias("cost"))


QUERIES = {
    "list_documents": list_documents,
    "resolve_document": resolve_document,
    "index_status": index_status,
    "fingerprints": fingerprints,
    "sync_diff": sync_diff,
    "incremental_skip": incremental_skip,
    "replace_document": replace_document,
    "generation_retention": generation_retention,
    "canonical_files": canonical_files,
    "snapshot_signature": snapshot_signature,
    "content_keys": content_keys,
    "snapshot_apply": snapshot_apply,
    "attachment_match": attachment_match,
    "title_candidates": title_candidates,
    "links_export": links_export,
    "item_hashes": item_hashes,
    "input_sets": input_sets,
    "stale_versions": stale_versions,
    "metadata_filter": metadata_filter,
    "library_alias": library_alias,
    "catalog_status": catalog_status,
    "item_metadata": item_metadata,
    "doi_year": doi_year,
    "eval_recall_mrr": eval_recall_mrr,
    "eval_modes": eval_modes,
    "eval_percentile": eval_percentile,
    "eval_cost": eval_cost,
}

_OLD = """old AS (SELECT path, hash, document_id, embedded FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed ASC NULLS LAST, hash DESC, document_id DESC, embedded DESC) AS rn_ FROM files WHERE path IS NOT NULL) WHERE rn_ = 1 AND substr(md5(path), 1, 1) <> '7')"""
_DOI = "nullif(regexp_replace(regexp_extract(lower(trim({0})), '(10\\.\\d{{4,9}}/\\S+)', 1), '[\\s.,;]+$', ''), '')"
_ITEMS = f"it AS {current_sql('zotero_items', 'library_type', 'library_id', 'item_key', 'item_version', 'item_type', 'title', 'doi', 'item_year', 'parent_key', 'filename', 'attachment_path', 'deleted')}"
_LINKS = f"""{_ITEMS}, live AS (SELECT * FROM it WHERE NOT coalesce(deleted, false)),
works AS (SELECT item_key, {_DOI.format('doi')} AS doi, lower(trim(title)) AS title FROM live WHERE item_type <> 'attachment'),
places AS (SELECT DISTINCT parent_key AS item_key, place FROM (SELECT parent_key, unnest([attachment_path, filename]) AS place FROM live WHERE item_type = 'attachment') WHERE place <> '' AND parent_key IN (SELECT item_key FROM works)),
fl AS (SELECT document_id AS document, coalesce(source_path, '') AS place, regexp_extract(coalesce(source_path, ''), '([^/]*)$', 1) AS name, {_DOI.format('doi')} AS doi FROM {current_sql("files", "path", "document_id", "source_path", "doi")}),
cand1 AS (SELECT DISTINCT f.document, w.item_key, w.doi, w.title FROM (SELECT document, unnest([place, name]) AS place FROM fl) f JOIN places p ON f.place = p.place AND f.place <> '' JOIN works w ON w.item_key = p.item_key),
att AS (SELECT document, min(item_key) AS item_key FROM cand1 GROUP BY document HAVING count(DISTINCT item_key) = 1 OR (count(DISTINCT concat(coalesce(doi, ''), chr(1), coalesce(title, ''))) = 1 AND min(CASE WHEN coalesce(doi, '') <> '' AND coalesce(title, '') <> '' THEN 1 ELSE 0 END) = 1)),
cand2 AS (SELECT DISTINCT f.document, w.item_key, w.doi, w.title FROM fl f JOIN works w ON f.doi = w.doi WHERE f.document NOT IN (SELECT document FROM att)),
bydoi AS (SELECT document, min(item_key) AS item_key FROM cand2 GROUP BY document HAVING count(DISTINCT item_key) = 1 OR (count(DISTINCT concat(coalesce(doi, ''), chr(1), coalesce(title, ''))) = 1 AND min(CASE WHEN coalesce(doi, '') <> '' AND coalesce(title, '') <> '' THEN 1 ELSE 0 END) = 1)),
links AS (SELECT document, item_key, 'attachment' AS how FROM att UNION ALL SELECT document, item_key, 'doi' FROM bydoi)"""


def _states(old: str, new: str) -> str:
    return f"SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.hash IS NOT DISTINCT FROM n.hash THEN 'unchanged' ELSE 'changed' END AS state FROM {old} o FULL JOIN {new} n ON o.path = n.path"


_WORDS = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{Nd}}]+'))"
_REL = f"CASE WHEN starts_with(path, '{ROOT}') THEN substr(path, {len(ROOT) + 1}) ELSE path END"

SQL = {
    "list_documents": f"""WITH {_LINKS}, t AS (SELECT l.document, min(i.title) AS item_title FROM links l JOIN it i USING (item_key) GROUP BY l.document)
SELECT document_id, coalesce(nullif(title, ''), nullif(item_title, ''), {_REL}) AS title, {_REL} AS rel, substr(hash, 1, 12) AS version
FROM {current_sql("files", "path", "document_id", "title", "hash")} f LEFT JOIN t ON t.document = f.document_id""",
    "resolve_document": f"""WITH f AS (SELECT path, translate(lower(title), ' ' || chr(10) || chr(9) || chr(13), '') AS t FROM {current_sql("files", "path", "title")} WHERE title <> ''),
r AS (SELECT item_key, translate(lower(title), ' ' || chr(10) || chr(9) || chr(13), '') AS r FROM {current_sql("zotero_items", "item_key", "title", "item_type")} WHERE item_type <> 'attachment' AND length(title) >= 12),
m AS (SELECT item_key, count(path) AS n, min(path) AS path FROM r LEFT JOIN f ON contains(t, r) GROUP BY item_key)
SELECT item_key, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS state, CASE WHEN n = 1 THEN path END AS path FROM m""",
    "index_status": f"""WITH c AS (SELECT file_path AS path, count(*) AS have FROM {current_sql("chunks", "id", "file_path")} GROUP BY 1)
SELECT count(*) AS files, count_if(embedded) AS embedded, CAST(sum(coalesce(have, 0)) AS BIGINT) AS chunks, count_if(coalesce(have, 0) <> coalesce(f.chunks, 0)) AS off, max(indexed) AS newest
FROM {current_sql("files", "path", "chunks", "embedded", "indexed")} f LEFT JOIN c ON c.path = f.path""",
    "fingerprints": f"SELECT path, substr(sha256(coalesce(path, '') || chr(0) || coalesce(hash, '') || chr(0) || coalesce(file_format, '') || chr(0) || coalesce(parser_version, '')), 1, 12) AS fingerprint FROM {current_sql('files', 'path', 'hash', 'file_format', 'parser_version')}",
    "sync_diff": f"WITH {_OLD}, new AS (SELECT path, hash FROM {current_sql('files', 'path', 'hash')} WHERE substr(md5(path), 1, 1) <> 'e') {_states('old', 'new')}",
    "incremental_skip": f"WITH {_OLD} SELECT path FROM {current_sql('files', 'path', 'hash')} n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.path = n.path AND o.hash = n.hash AND o.embedded)",
    "replace_document": f"""WITH {_OLD}, new AS (SELECT path, document_id, hash FROM {current_sql("files", "path", "document_id", "hash")}), s AS ({_states('old', 'new')}),
inc AS (SELECT * FROM new WHERE path IN (SELECT path FROM s WHERE state IN ('added', 'changed')))
SELECT path, document_id, hash FROM old WHERE path NOT IN (SELECT path FROM s WHERE state = 'removed') AND path NOT IN (SELECT path FROM inc) AND document_id NOT IN (SELECT document_id FROM inc) UNION ALL SELECT path, document_id, hash FROM inc""",
    "generation_retention": f"""WITH g AS (SELECT parser_version AS generation, max(indexed) AS created FROM {current_sql("files", "path", "parser_version", "indexed")} WHERE parser_version IS NOT NULL GROUP BY 1)
SELECT generation, created, generation = 'v3' OR row_number() OVER (PARTITION BY generation = 'v3' ORDER BY created DESC, generation DESC) <= 1 AS kept FROM g""",
    "snapshot_apply": """WITH o AS (SELECT item_key, content_hash, coalesce(deleted, false) AS d FROM (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY item_version ASC NULLS LAST, content_hash DESC NULLS LAST, deleted DESC NULLS LAST) AS r FROM zotero_items WHERE item_key IS NOT NULL) WHERE r = 1 AND substr(md5(item_key), 1, 1) <> '3'),
n AS (SELECT item_key, content_hash, coalesce(deleted, false) AS d FROM (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY item_version DESC NULLS LAST, content_hash DESC NULLS LAST, deleted DESC NULLS LAST) AS r FROM zotero_items WHERE item_key IS NOT NULL) WHERE r = 1 AND substr(md5(item_key), 1, 1) <> '9')
SELECT coalesce(o.item_key, n.item_key) AS item_key, CASE WHEN o.item_key IS NULL THEN 'inserted' WHEN n.item_key IS NULL THEN CASE WHEN o.d THEN 'gone' ELSE 'deleted' END WHEN n.d AND NOT o.d THEN 'deleted'
 WHEN o.d AND NOT n.d THEN 'restored' WHEN o.content_hash IS NOT DISTINCT FROM n.content_hash THEN 'unchanged' ELSE 'updated' END AS action FROM o FULL JOIN n ON o.item_key = n.item_key""",
    "attachment_match": f"WITH {_LINKS} SELECT document, item_key, how FROM links",
    "title_candidates": f"""WITH d AS (SELECT document_id AS document, {_WORDS.format('title')} AS dw FROM {current_sql("files", "path", "document_id", "title")}),
{_ITEMS}, i AS (SELECT item_key, {_WORDS.format('title')} AS iw FROM it WHERE item_type <> 'attachment')
SELECT document, item_key, round(len(list_intersect(dw, iw)) / greatest(len(dw), len(iw)), 6) AS overlap FROM d, i WHERE len(dw) >= 3 AND len(iw) > 0 AND len(list_intersect(dw, iw)) / greatest(len(dw), len(iw)) >= 0.8""",
    "metadata_filter": f"WITH {_LINKS} SELECT DISTINCT document FROM links WHERE item_key IN (SELECT item_key FROM live WHERE item_year BETWEEN 2005 AND 2015 AND library_type = 'user' AND library_id = '4410021')",
    "library_alias": "SELECT library_type, library_id, synced_at FROM (SELECT *, row_number() OVER (PARTITION BY library_type ORDER BY synced_at DESC NULLS LAST, library_id DESC) AS r FROM zotero_items) WHERE r = 1",
    "catalog_status": f"""WITH {_ITEMS}, p AS (SELECT DISTINCT item_key FROM it WHERE NOT coalesce(deleted, false))
SELECT library_type, library_id, count_if(item_type <> 'attachment' AND NOT coalesce(deleted, false)) AS items, count_if(item_type = 'attachment' AND NOT coalesce(deleted, false)) AS attachments, count_if(coalesce(deleted, false)) AS deleted,
 count_if(item_type = 'attachment' AND NOT coalesce(deleted, false) AND p.item_key IS NULL) AS orphans FROM it LEFT JOIN p ON it.parent_key = p.item_key GROUP BY ALL""",
    "item_metadata": f"""WITH {_ITEMS}, c AS (SELECT DISTINCT item_key, creator_pos, coalesce(nullif(full_name, ''), concat_ws(', ', nullif(family, ''), nullif(given, ''))) AS name FROM zotero_creators),
n AS (SELECT item_key, string_agg(name, '; ' ORDER BY creator_pos, name) AS creators FROM c GROUP BY item_key)
SELECT it.item_key, it.title, n.creators FROM it LEFT JOIN n ON n.item_key = it.item_key WHERE item_type <> 'attachment' AND NOT coalesce(deleted, false)""",
    "doi_year": f"""SELECT item_key, {_DOI.format('doi')} AS doi, coalesce(item_year, try_cast(nullif(regexp_extract(date_raw, '(?:^|\\D)([12][0-9]{{3}})(?:\\D|$)', 1), '') AS INTEGER)) AS year
FROM {current_sql("zotero_items", "item_key", "doi", "date_raw", "item_year")} WHERE doi IS NOT NULL OR date_raw IS NOT NULL""",
    "eval_percentile": """WITH d AS (SELECT lower(trim(source)) AS source, length(text) AS chars FROM documents WHERE text IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY chars) AS k, count(*) OVER (PARTITION BY source) AS n FROM d)
SELECT source, max(n) AS n, min(CASE WHEN k >= ceil(0.5 * n) THEN chars END) AS p50, min(CASE WHEN k >= ceil(0.95 * n) THEN chars END) AS p95 FROM r GROUP BY source""",
}

_STRIP = "translate({0}, ' ' || chr(10) || chr(9) || chr(13), '')"
_EVAL = f"""WITH labels AS (SELECT DISTINCT case_id AS query_id, CAST(doc_id AS VARCHAR) AS row_id FROM (SELECT case_id, {_STRIP.format("passage")} AS p FROM eval_cases WHERE passage IS NOT NULL) q
 JOIN (SELECT doc_id, {_STRIP.format("text")} AS t FROM documents WHERE text IS NOT NULL) d ON p <> '' AND contains(t, p)),
docs AS (SELECT DISTINCT doc_id AS row_id, {_tok("text")} AS toks FROM documents),
asked AS (SELECT DISTINCT case_id AS query_id, array_to_string(regexp_split_to_array(passage, '\\s+')[1:6], ' ') AS query FROM eval_cases WHERE passage IS NOT NULL),
{_bm25_sql(30)}, n AS (SELECT query_id, count(DISTINCT row_id) AS labels FROM labels GROUP BY 1)"""


def _scored_sql(k: int) -> str:
    return f"""SELECT n.query_id, n.labels, coalesce(m.found, 0) AS found, round(coalesce(m.found, 0) / n.labels, 6) AS recall, round(coalesce(1.0 / m.best, 0), 6) AS rr
FROM n LEFT JOIN (SELECT l.query_id, count(DISTINCT l.row_id) AS found, min(r.rank) AS best FROM ranked r JOIN labels l ON l.query_id = r.query_id AND l.row_id = CAST(r.row_id AS VARCHAR) WHERE r.rank <= {k} GROUP BY 1) m ON m.query_id = n.query_id"""


SQL |= {
    "eval_recall_mrr": f"{_EVAL} {_scored_sql(5)}",
    "eval_modes": f"{_EVAL} " + " UNION ALL ".join(f"SELECT {k} AS k, count(*) AS cases, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr FROM ({_scored_sql(k)})" for k in (1, 5, 30)),
    "eval_cost": f"""SELECT file_format, calls, tokens, CASE WHEN file_format = 'text' THEN NULL ELSE round(tokens / 1e6 * 0.02, 6) END AS cost FROM (SELECT f.file_format, count(*) AS calls, CAST(sum({_est("c.chunk_content")}) AS BIGINT) AS tokens
 FROM {current_sql("chunks", "id", "file_path", "chunk_content")} c LEFT JOIN {current_sql("files", "path", "file_format")} f ON c.file_path = f.path GROUP BY 1)""",
}

_FOLDER = "regexp_replace(path, '/[^/]*$', '')"
_NAME = "lower(regexp_extract(path, '([^/]*)$', 1))"
SQL |= {
    "snapshot_signature": f"""SELECT n AS rows, md5(concat(n, ':', x)) AS signature FROM (SELECT count(*) AS n, coalesce(bit_xor(CAST('0x' || substr(md5(coalesce(path, '') || chr(0) || coalesce(hash, '')), 1, 15) AS BIGINT)), 0) AS x FROM {current_sql("files", "path", "hash")})""",
    "content_keys": "SELECT DISTINCT doc_id, 'content:sha256:' || sha256(text) AS key FROM documents WHERE text IS NOT NULL",
    "canonical_files": f"""WITH x AS (SELECT path, {_FOLDER} AS folder, CASE WHEN regexp_matches({_NAME}, '(\\.mineru\\.json|structured_content\\.json)$') THEN 4 WHEN regexp_matches({_NAME}, 'content_list\\.json$') THEN 3 WHEN regexp_matches({_NAME}, 'middle\\.json$') THEN 2 WHEN regexp_matches({_NAME}, 'content_list_v2\\.json$') THEN 1 ELSE 0 END AS priority FROM {current_sql("files", "path")}),
best AS (SELECT path, folder, priority FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY priority DESC, path) AS k FROM x WHERE priority > 0) WHERE k = 1),
chosen AS (SELECT * FROM best UNION ALL SELECT path, folder, priority FROM x WHERE priority = 0 AND folder NOT IN (SELECT folder FROM best))
SELECT path, folder, priority FROM chosen c WHERE NOT EXISTS (SELECT 1 FROM best b WHERE starts_with(c.folder, b.folder || '/'))""",
}
SQL |= {
    "links_export": f"""WITH {_LINKS} SELECT l.document, f.path, i.library_type, i.library_id, l.item_key, l.how AS match_method
FROM links l JOIN {current_sql("files", "path", "document_id")} f ON f.document_id = l.document JOIN it i ON i.item_key = l.item_key""",
    "item_hashes": f"""SELECT item_key, sha256(CAST(to_json({{'doi': coalesce(doi, ''), 'title': coalesce(title, ''), 'type': item_type}}) AS VARCHAR)) AS hash FROM {current_sql("zotero_items", "item_key", "item_version", "title", "doi", "item_type")}""",
    "input_sets": f"""WITH f AS (SELECT path, {_FOLDER} AS folder, regexp_extract(path, '([^/]*)$', 1) AS name FROM {current_sql("files", "path")}),
one AS (SELECT folder, min(name) AS name, max(CASE WHEN name = 'content_list.json' THEN 1 ELSE 0 END) AS export FROM f GROUP BY folder),
own AS (SELECT path FROM f UNION ALL SELECT folder || '/rag-source.json' FROM one UNION ALL SELECT folder || '/layout.json' FROM one WHERE export = 1),
beside AS (SELECT {_FOLDER} AS folder, min(CASE WHEN regexp_matches(path, '/layout\\.json$') THEN '0' ELSE '1' END || path) AS best FROM own WHERE regexp_matches(path, '/layout\\.json$|(/|_)middle\\.json$') GROUP BY 1)
SELECT path, 0 AS place, path AS input FROM own UNION ALL SELECT folder || '/rag-source.json', 1, folder || '/' || name FROM one
UNION ALL SELECT path, 1, substr(best, 2) FROM own JOIN beside ON {_FOLDER.replace("path", "own.path")} = beside.folder WHERE regexp_matches(lower(path), '(\\.mineru\\.json|_content_list\\.json|_content_list_v2\\.json|_middle\\.json|/content_list\\.json|/content_list_v2\\.json|/middle\\.json|/middle_json\\.json|/structured_content\\.json)$')""",
    "stale_versions": f"""WITH {_OLD} SELECT o.document_id, substr(coalesce(o.hash, ''), 1, 12) AS version, substr(coalesce(n.hash, ''), 1, 12) AS now FROM old o LEFT JOIN {current_sql("files", "path", "document_id", "hash")} n ON n.document_id = o.document_id
WHERE n.document_id IS NULL OR substr(coalesce(n.hash, ''), 1, 12) <> substr(coalesce(o.hash, ''), 1, 12)""",
}
