"""What a document is made of: manifests, the files that belong together, and when their hashes can be used again.

A file is a row (path, size, modified, content). Files that belong together are found by joins on their folder.

Defined results: a manifest that is malformed, has unknown fields, another version, or a content path that is absolute,
leaves its folder, names a manifest or no file of the listing, is a row with an error. Links between folders aren't
followed here; the folder source lists files by the paths below its root.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.sources.files import LIMIT

# The manifest's name, its fields, and the seconds within which a changed file may change again unseen.
MANIFEST = "rag-source.json"
MANIFEST_FIELDS = {"version": "int", "format": "string", "contentPath": "string", "sourcePath": "string", "sourceHash": "string", "title": "string", "doi": "string", "zotero": "string", "pagesFrom": "string"}
RACY = 3.0
# Names of exports, and of the documents of lines and spans beside them, whose marks put pages right.
EXPORT = r"(\.mineru\.json|_content_list\.json|_content_list_v2\.json|_middle\.json|/content_list\.json|/content_list_v2\.json|/middle\.json|/middle_json\.json|/structured_content\.json)$"
LAYOUT, MIDDLE = r"/layout\.json$", r"(/|_)middle\.json$"


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def below(folder: Column, relative: Column) -> Column:
    """The path of a relative one within a folder; null where it is empty, absolute, or leaves the folder."""
    state = F.struct(F.array().cast("array<string>").alias("p"), F.lit(False).alias("out"))

    def step(s: Column, part: Column) -> Column:
        up, stay = part == "..", (part == ".") | (part == "")
        kept = F.when(up, F.slice(s["p"], 1, F.greatest(F.size(s["p"]) - 1, F.lit(0)))).when(stay, s["p"]).otherwise(F.concat(s["p"], F.array(part)))
        return F.struct(kept.alias("p"), (s["out"] | (up & (F.size(s["p"]) == 0))).alias("out"))

    end = F.aggregate(F.split(relative, "/"), state, step)
    good = relative.isNotNull() & (relative != "") & ~relative.startswith("/") & ~end["out"] & (F.size(end["p"]) > 0)
    return F.when(good, F.concat(folder, F.lit("/"), F.array_join(end["p"], "/")))


def manifests(files: DataFrame) -> DataFrame:
    """The manifests of a listing: path, their fields, content, pages (paths of the listing), error."""
    kind = "struct<" + ",".join(f"{k}:{t}" for k, t in MANIFEST_FIELDS.items()) + ">"
    text = F.col("content").cast("string")
    m = files.filter(F.col("path").endswith("/" + MANIFEST)).select("path", F.from_json(text, kind).alias("m"), F.json_object_keys(text).alias("k"))
    at = folder_of(F.col("path"))
    m = m.withColumn("content", below(at, F.col("m.contentPath"))).withColumn("pages", below(at, F.col("m.pagesFrom")))
    there = files.select(F.col("path").alias("there"))
    for c in ("content", "pages"):
        m = m.join(there, F.col(c) == F.col("there"), "left").withColumn(f"{c}_there", F.col("there").isNotNull()).drop("there")
    paged = F.coalesce(F.col("m.pagesFrom") != "", F.lit(False))
    error = (
        F.when(F.col("k").isNull(), "malformed")
        .when(F.exists("k", lambda k: ~k.isin(*MANIFEST_FIELDS)), "unknown field")
        .when(~F.col("m.version").eqNullSafe(F.lit(1)), "unknown version")
        .when(F.col("content").isNull() | (paged & F.col("pages").isNull()), "no path within the folder")
        .when(F.col("content").endswith("/" + MANIFEST), "names a manifest")
        .when(~F.col("content_there") | (paged & ~F.col("pages_there")), "no such file")
    )
    return m.select("path", "m.*", "content", "pages", error.alias("error"))


def input_files(files: DataFrame) -> DataFrame:
    """(path, place, input): each file; a manifest's content and pages after it; after an export the document of lines
    and spans of its folder, `layout.json` before others by name, none over the size limit."""
    own = files.select("path", F.lit(0).alias("place"), F.col("path").alias("input"))
    good = manifests(files).filter("error IS NULL")
    named = good.select("path", F.posexplode(F.array("content", "pages")).alias("place", "input")).filter("input IS NOT NULL").withColumn("place", F.col("place") + 1)
    low = F.lower("path")
    layout = F.when(F.col("path").rlike(LAYOUT), 0).when(F.col("path").rlike(MIDDLE), 1)
    beside = files.filter(F.coalesce("size", F.lit(0)) <= LIMIT).select(folder_of(F.col("path")).alias("folder"), layout.alias("rank"), F.col("path").alias("input")).filter("rank IS NOT NULL")
    beside = beside.groupBy("folder").agg(F.min(F.struct("rank", "input"))["input"].alias("input"))
    exports = files.filter(low.rlike(EXPORT)).select("path", folder_of(F.col("path")).alias("folder"))
    return own.unionByName(named).unionByName(exports.join(beside, "folder").select("path", F.lit(1).alias("place"), "input"))


def input_marks(files: DataFrame) -> DataFrame:
    """(path, hash, stamp, newest): 12 digits of SHA-256 over the contents of a document's inputs in order, and a stamp of
    their paths, sizes and times, for which no content is read."""
    facts = files.select(F.col("path").alias("input"), "size", "modified", F.sha2("content", 256).alias("sha"))
    one = F.sort_array(F.collect_list(F.struct("place", "input", "size", "modified", "sha")))  # at most three inputs
    g = input_files(files).join(facts, "input").groupBy("path").agg(one.alias("i"), F.max("modified").alias("newest"))
    said = F.array_join(F.transform("i", lambda x: F.concat_ws("\x00", x["input"], x["size"].cast("string"), x["modified"].cast("string"))), "\x00")
    return g.select("path", F.substring(F.sha2(F.array_join(F.transform("i", lambda x: x["sha"]), "\x00"), 256), 1, 12).alias("hash"), F.md5(said).alias("stamp"), "newest")


def remembered(stamps: DataFrame, cached: DataFrame) -> DataFrame:
    """stamps (path, stamp, …) with the `hash` of cached (path, stamp, hash) where nothing changed; null ones are to be hashed."""
    return stamps.join(cached.select("path", "stamp", "hash"), ["path", "stamp"], "left")


def worth_keeping(marks: DataFrame, started: float) -> DataFrame:
    """The marks (path, hash, stamp, newest) that may be cached: a file changed within RACY seconds of the start may change
    again without another stamp."""
    return marks.filter(F.lit(started) - F.col("newest") > RACY).select("path", "stamp", "hash")


def json_hash(text: Column, ignored: tuple[str, ...] = (), unordered: tuple[str, ...] = ()) -> Column:
    """SHA-256 of a JSON object whatever the order of its keys, without some fields, and with others as sets; null for
    null, malformed and other JSON."""

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                doc = json.loads(t) if t else None
            except ValueError:
                return None
            if not isinstance(doc, dict):
                return None
            kept = {k: v for k, v in doc.items() if k not in ignored}
            for k in unordered:
                if isinstance(kept.get(k), list):
                    kept[k] = sorted(kept[k], key=lambda v: json.dumps(v, sort_keys=True))
            return json.dumps(kept, sort_keys=True, ensure_ascii=False, separators=(",", ":"))

        return pd.Series([one(t) for t in texts], dtype=object)

    return F.sha2(canonical(text), 256)


def stale(asked: DataFrame, current: DataFrame) -> DataFrame:
    """asked (document_id, version), current (document_id, version) -> (document_id, version, now) where a document has
    changed or is gone since it was read; rows without a version ask for whatever is there."""
    now = current.select("document_id", F.col("version").alias("now"))
    return asked.filter("version IS NOT NULL").join(now, "document_id", "left").filter("now IS NULL OR now <> version").select("document_id", "version", "now")
