"""Incremental synchronisation as joins of snapshots: fingerprints, differences, replacement, generations."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(*parts: str) -> Column:
    """12 hex digits of SHA-256 over the NUL-joined parts, nulls as empty."""
    return F.substring(F.sha2(F.concat_ws("\x00", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256), 1, 12)


def difference(before: DataFrame, after: DataFrame, key: str = "path", mark: str = "mark") -> DataFrame:
    """(key, state): added, removed, changed, unchanged."""
    b, a = before.select(key, F.col(mark).alias("b"), F.lit(True).alias("in_b")), after.select(key, F.col(mark).alias("a"), F.lit(True).alias("in_a"))
    state = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("changed")
    return b.join(a, key, "full_outer").select(key, state.alias("state"))


def pending(source: DataFrame, index: DataFrame) -> DataFrame:
    """Source rows (path, hash) that aren't in the index with the same hash and embedded."""
    done = index.filter("embedded").select("path", "hash")
    return source.join(done, ["path", "hash"], "left_anti")


def replaced(index: DataFrame, incoming: DataFrame, obsolete: DataFrame) -> DataFrame:
    """The index without rows of incoming or obsolete paths or of an incoming document, and the incoming rows."""
    out = index.join(obsolete.select("path").unionByName(incoming.select("path")).distinct(), "path", "left_anti")
    return out.join(incoming.select("document_id").distinct(), "document_id", "left_anti").unionByName(incoming).select(*index.columns)


def retained(generations: DataFrame, active: str, keep: int = 2) -> DataFrame:
    """(generation, created) with `kept`: the active one and the newest others up to `keep` in all."""
    if not 1 <= keep <= 1000:
        raise ValueError("keep must be within 1 and 1000")
    others = Window.partitionBy(F.col("generation") == active).orderBy(F.col("created").desc(), F.col("generation").desc())
    return generations.withColumn("kept", (F.col("generation") == active) | (F.row_number().over(others) <= keep - 1))


def canonical(paths: DataFrame) -> DataFrame:
    """One representation of each folder's package: the one of highest priority, ties by name.

    Priorities fall from structured exports to listings, intermediate and second-version listings; other files stand
    for themselves. A folder below another folder's package is covered by the shallowest one.
    """
    name, folder = F.regexp_extract("path", r"([^/]*)$", 1), F.regexp_replace("path", r"/[^/]*$", "")
    low = F.lower(name)
    rank = F.when(low.rlike(r"(\.mineru\.json|structured_content\.json)$"), 4).when(low.rlike(r"content_list\.json$"), 3).when(low.rlike(r"middle\.json$"), 2).when(low.rlike(r"content_list_v2\.json$"), 1).otherwise(0)
    x = paths.select("path", folder.alias("folder"), rank.alias("priority"))
    packs = x.filter("priority > 0")
    best = packs.withColumn("k", F.row_number().over(Window.partitionBy("folder").orderBy(F.col("priority").desc(), "path"))).filter("k = 1")
    parts = F.split("folder", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    above = x.select("path", "folder", F.explode(ancestors).alias("up")).filter("up <> folder").join(best.select(F.col("folder").alias("up")).distinct(), "up", "left_semi").select("path").distinct()
    plain = x.filter("priority = 0").join(best.select("folder").distinct(), "folder", "left_anti")
    return best.select("path", "folder", "priority").unionByName(plain.select("path", "folder", "priority")).join(above, "path", "left_anti")


def signature(snapshot: DataFrame, *columns: str) -> DataFrame:
    """(rows, signature) of a set of rows, whatever their order: equal snapshots have equal signatures. Map-side sums, one row out."""
    digest = F.md5(F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    each = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    x = snapshot.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(each), F.lit(0)).alias("x"))
    return x.select("rows", F.md5(F.concat_ws(":", "rows", "x")).alias("signature"))


def content_key(content: Column) -> Column:
    """The key of a document without a source of its own."""
    return F.concat(F.lit("content:sha256:"), F.sha2(content, 256))


def source_key(digest: Column, content: Column) -> Column:
    """The key by the source's digest where it is one (SHA-256 or MD5 in hex), else by content."""
    low = F.lower(F.trim(digest))
    return F.when(low.rlike("^[0-9a-f]{64}$"), F.concat(F.lit("sha256:"), low)).when(low.rlike("^[0-9a-f]{32}$"), F.concat(F.lit("md5:"), low)).otherwise(content_key(content))


def reconciled(index: DataFrame, seen: DataFrame, failures: DataFrame) -> DataFrame:
    """The index without paths that are gone; none is taken for gone after a scan with failures."""
    return index.join(seen.select("path").distinct(), "path", "left_semi") if failures.isEmpty() else index


def obsolete(index: DataFrame, incoming: DataFrame) -> DataFrame:
    """(path) of the index that another representation of its package now stands for."""
    paths = index.select("path").unionByName(incoming.select("path")).distinct()
    return index.select("path").join(canonical(paths).select("path"), "path", "left_anti")


def compatibility(**parts: object) -> str:
    """What an index was built with (model, dimensions, chunking, parser, root): a different one calls for a rebuild."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:12]
