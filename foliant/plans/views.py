"""The current state of the library's tables, for Spark and as SQL.

Tables hold repeated rows and older states that arrive late. The current row of a key is the one with the largest
order column, ties broken by the other columns from left to right, so both engines pick the same row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.tables import newest, table

COLUMNS = {
    "files": "path hash chunks indexed size embedded document_id title document_key source_path zotero_ref doi file_format parser_version",
    "chunks": "id file_path chunk_content line_start line_end chunk_hash indexed_at tokens page_start page_end section chunk_index",
    "blocks": "block_id document_id block_ord text section page_start page_end line_start line_end kind",
    "zotero_items": "library_type library_id item_key item_version item_type title abstract date_raw item_year publication doi citation_key parent_key link_mode filename attachment_path content_hash synced_at deleted",
}
KEYS = {"files": ("path", "indexed"), "chunks": ("id", "indexed_at"), "blocks": ("block_id", "block_ord"), "zotero_items": ("item_key", "item_version")}


def current(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The current rows of a table; only `columns` (the key among them) are read if given."""
    key, order = KEYS[name]
    df = table(spark, sf_dir, name).filter(F.col(key).isNotNull())
    names = COLUMNS[name].split() if not columns else [c for c in COLUMNS[name].split() if c in {*columns, key, order}]
    rows = newest(df.select(*names), [key], order)
    return rows.select(*columns) if columns else rows


def current_sql(name: str, *columns: str) -> str:
    """The same as a subquery."""
    key, order = KEYS[name]
    names = COLUMNS[name].split() if not columns else [c for c in COLUMNS[name].split() if c in {*columns, key, order}]
    by = ", ".join(f"{c} DESC NULLS LAST" for c in [order, *[c for c in names if c != key]])
    return f"(SELECT {', '.join(columns or names)} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {by}) AS rn_ FROM {name} WHERE {key} IS NOT NULL) WHERE rn_ = 1)"
