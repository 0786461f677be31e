"""The bibliographic catalog as joins: applying snapshots, linking files to items, filters, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def apply_snapshot(old: DataFrame, new: DataFrame, key: str = "item_key") -> DataFrame:
    """Old and new states (key, content_hash, deleted) -> (key, action): inserted, updated, restored, unchanged, deleted (seen no more), gone (was deleted before)."""
    o = old.select(key, F.col("content_hash").alias("oh"), F.coalesce("deleted", F.lit(False)).alias("od"), F.lit(True).alias("o"))
    n = new.select(key, F.col("content_hash").alias("nh"), F.coalesce("deleted", F.lit(False)).alias("nd"), F.lit(True).alias("n"))
    x = o.join(n, key, "full_outer")
    action = (
        F.when(F.col("o").isNull(), "inserted")
        .when(F.col("n").isNull(), F.when(F.col("od"), "gone").otherwise("deleted"))
        .when(F.col("nd") & ~F.col("od"), "deleted")
        .when(F.col("od") & ~F.col("nd"), "restored")
        .when(F.col("oh").eqNullSafe(F.col("nh")), "unchanged")
        .otherwise("updated")
    )
    return x.select(key, action.alias("action"))


def attachments(items: DataFrame) -> DataFrame:
    """(item_key, place) of living attachments whose parent lives, by path and by file name."""
    living = items.filter(~F.coalesce("deleted", F.lit(False)))
    parents = living.filter("item_type <> 'attachment'").select(F.col("item_key").alias("parent_key"))
    kids = living.filter("item_type = 'attachment'").select("parent_key", F.explode(F.array("attachment_path", "filename")).alias("place")).filter("place <> ''")
    return kids.join(parents, "parent_key", "left_semi").select(F.col("parent_key").alias("item_key"), "place").distinct()


def same_work(candidates: DataFrame) -> DataFrame:
    """(document, item_key, doi, title) -> the first item where there is one, or where all share DOI and title."""
    whole = F.concat_ws("\x00", F.coalesce("doi", F.lit("")), F.coalesce("title", F.lit("")))
    full = (F.coalesce("doi", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")
    g = candidates.groupBy("document").agg(F.count_distinct("item_key").alias("n"), F.count_distinct(whole).alias("kinds"), F.min(full).alias("full"), F.min("item_key").alias("item_key"))
    return g.filter((F.col("n") == 1) | ((F.col("kinds") == 1) & F.col("full"))).select("document", "item_key")


def linked(files: DataFrame, items: DataFrame, places: DataFrame) -> DataFrame:
    """(document, item_key, how): by attachment first, then by DOI; files (document, place, name, doi), items (item_key, doi, title)."""
    by_place = files.select("document", F.explode(F.array("place", "name")).alias("place")).filter("place <> ''").join(places, "place").join(items, "item_key").select("document", "item_key", "doi", "title").distinct()
    attached = same_work(by_place).withColumn("how", F.lit("attachment"))
    rest = files.join(attached, "document", "left_anti").filter("doi IS NOT NULL")
    by_doi = rest.select("document", "doi").join(items, "doi").select("document", "item_key", "doi", "title").distinct()
    return attached.unionByName(same_work(by_doi).withColumn("how", F.lit("doi")))


def title_words(title: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)))


def title_candidates(documents: DataFrame, items: DataFrame, least: float = 0.8, words: int = 3) -> DataFrame:
    """(document, item_key, overlap): shared distinct words over the larger set of at least `least`; document titles of `words` distinct words or more.

    Every pair with that overlap shares one of the document's rarest words beyond the share it may lack, so only those
    words meet the items' words; equal word sets are compared once.
    """
    d = documents.select("document", F.array_sort(title_words(F.col("title"))).alias("dw")).filter(F.size("dw") >= words)
    i = items.select("item_key", F.array_sort(title_words(F.col("title"))).alias("iw")).filter(F.size("iw") > 0)
    ds, is_ = d.select("dw").distinct(), i.select("iw").distinct()
    freq = is_.select(F.explode("iw").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    probes = ds.select("dw", F.explode("dw").alias("w")).join(freq, "w", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("dw").orderBy("df", "w"))
    probes = probes.withColumn("k", rank).filter(F.col("k") <= F.size("dw") - F.ceil(F.size("dw") * least) + 1).select("dw", "w")
    met = probes.join(is_.select("iw", F.explode("iw").alias("w")), "w").select("dw", "iw").distinct()
    overlap = F.size(F.array_intersect("dw", "iw")) / F.greatest(F.size("dw"), F.size("iw"))
    good = met.withColumn("overlap", overlap).filter(F.col("overlap") >= least)
    return good.join(d, "dw").join(i, "iw").select("document", "item_key", F.round("overlap", 6).alias("overlap"))


def allowed(links: DataFrame, items: DataFrame, year_from: int | None = None, year_to: int | None = None, library: tuple[str, str] | None = None) -> DataFrame:
    """Linked documents whose item meets every condition; an unknown year meets no bound."""
    x = items.filter(~F.coalesce("deleted", F.lit(False)))
    if year_from is not None:
        x = x.filter(F.col("item_year") >= year_from)
    if year_to is not None:
        x = x.filter(F.col("item_year") <= year_to)
    if library is not None:
        x = x.filter((F.col("library_type") == library[0]) & (F.col("library_id") == library[1]))
    return links.join(x.select("item_key"), "item_key", "left_semi").select("document").distinct()


def relinked(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links (document, item_key, how, locked): a new link replaces the old one, unless only the old one is locked."""
    o, n = (df.select("document", F.struct("item_key", "how", F.coalesce("locked", F.lit(False)).alias("locked")).alias(c)) for df, c in ((old, "o"), (new, "n")))
    keep = F.col("n").isNull() | (F.col("o").isNotNull() & F.col("o.locked") & ~F.col("n.locked"))
    return o.join(n, "document", "full_outer").select("document", F.when(keep, F.col("o")).otherwise(F.col("n")).alias("l")).select("document", "l.*")


def matched(files: DataFrame, items: DataFrame, places: DataFrame, explicit: DataFrame, old: DataFrame) -> DataFrame:
    """(document, item_key, how, locked): a document's own reference (document, item_key) first, then its locked link, then
    attachments, then DOIs. Old links that nothing supports any more are gone unless locked."""
    live = items.select("item_key").distinct()
    own = explicit.join(live, "item_key", "left_semi").select("document", "item_key", F.lit("reference").alias("how"), F.lit(False).alias("locked"), F.lit(0).alias("place"))
    kept = old.filter("locked").select("document", "item_key", "how", "locked", F.lit(1).alias("place"))
    found = linked(files, items, places).select("document", "item_key", "how", F.lit(False).alias("locked"), F.lit(2).alias("place"))
    every = own.unionByName(kept).unionByName(found)
    return every.groupBy("document").agg(F.min(F.struct("place", "item_key", "how", "locked")).alias("l")).select("document", "l.item_key", "l.how", "l.locked")


def converted_from(path: Column) -> Column:
    """The source file's name in a converter's folder name, `name.pdf-<uuid>`; the deepest such folder counts."""
    return F.nullif(F.regexp_extract(path, r"^.*/([^/]+?)-[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?:/|$)", 1), F.lit(""))
