"""Ranked retrieval of a batch of queries in one call: analyzers, path boost, gate, fusion, fallback, reranking.

index: (row_id, content, rel, heading, v); queries: (query_id, query, v). A query's vector is null where its embedding
failed or can't be used: in hybrid mode the query then falls back to the lexical list, in vector mode the call fails.
Defined results: null and blank queries have no lexical hit; rows without a usable vector no vector hit; an empty
`allowed` admits nothing, none at all everything.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.search import han_bigrams, han_index_terms, han_query_terms, tokens
from foliant.functions.text import heading
from foliant.operators.evaluation import scored
from foliant.operators.fusion import boosted, first_word, fused
from foliant.operators.lexical import bm25, documents_of
from foliant.operators.literal import containing
from foliant.operators.models import reranked
from foliant.operators.vectors import knn, usable
from foliant.sources.tables import staged

HAN = r"\p{IsHan}"
LEXICAL = 200  # length of the lexical list


@dataclass(frozen=True)
class Options:
    """How a batch is answered; bounds are checked."""

    mode: str = "hybrid"
    top_k: int = 5
    candidates: int = 30
    alpha: float = 0.3
    rerank: bool = False

    def __post_init__(self) -> None:
        if self.mode not in ("hybrid", "vector", "bm25", "literal"):
            raise ValueError(f"no mode {self.mode!r}")
        if not 1 <= self.top_k <= 200:
            raise ValueError("top_k must be within 1 and 200")
        if not self.top_k <= self.candidates <= 200:
            raise ValueError("candidates must be within top_k and 200")
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha must be within 0 and 1")
        if self.rerank and self.mode != "hybrid":
            raise ValueError("only hybrid lists are reranked")

    @property
    def recall(self) -> int:
        return self.candidates if self.rerank else self.top_k


def lexical(index: DataFrame, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, row_id, score, rank): queries with a Han character over characters and pairs, others over words."""
    has = F.coalesce(F.col("query").rlike(HAN), F.lit(False))
    text = F.concat_ws(" ", "content", "rel", "heading")
    han = index.select("row_id", F.concat(tokens(text), han_index_terms(text)).alias("toks"))
    words = bm25(documents_of(index, "row_id", ["content", "rel", "heading"]), queries.filter(~has), k, allowed)
    return words.unionByName(bm25(han, queries.filter(has), k, allowed, han_query_terms(F.col("query"))))


def ungated(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id) of the queries with pairs of Han characters, none of which occurs anywhere: their lexical list says nothing."""
    pairs = staged(queries.select("query_id", F.explode(F.array_distinct(han_bigrams(F.col("query")))).alias("term")), "asked-pairs")
    text = F.concat_ws(" ", "content", "rel", "heading")
    there = index.select(F.explode(F.array_distinct(han_bigrams(text))).alias("term")).join(pairs.select("term").distinct(), "term", "left_semi").distinct()
    return pairs.join(there.withColumn("hit", F.lit(1)), "term", "left").groupBy("query_id").agg(F.count("hit").alias("hits")).filter("hits = 0").select("query_id")


def retrieve(index: DataFrame, queries: DataFrame, options: Options, dim: int, reranker: Callable[[str, list[str]], list[float]] | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, row_id, rank, bm25, cosine, hybrid, rerank, method); literal mode has no scores and ranks by path and place in the index (`rel`, row_id)."""
    if options.rerank and reranker is None:
        raise ValueError("no reranker")
    if options.mode == "literal":
        rows = index if allowed is None else index.join(allowed, "row_id", "left_semi")
        from pyspark.sql import Window

        met = containing(rows.select("row_id", F.col("content").alias("text")), queries.select("query_id", F.col("query").alias("pattern"))).join(rows.select("row_id", "rel"), "row_id")
        ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rel", "row_id"))).filter(F.col("rank") <= options.top_k)
        none = F.lit(None).cast("double")
        return ranked.select("query_id", "row_id", "rank", none.alias("bm25"), none.alias("cosine"), none.alias("hybrid"), none.alias("rerank"), F.lit("literal").alias("method"))
    queries = staged(queries.select("query_id", "query", "v", usable(F.col("v"), dim).alias("can")), "asked")
    if options.mode == "vector" and (off := queries.filter("NOT can").count()):
        raise ValueError(f"{off} queries have no vector")
    lex = lexical(index, queries, LEXICAL, allowed) if options.mode != "vector" else bm25(documents_of(index, "row_id", ["content"]), queries.limit(0), 1)
    if options.mode == "hybrid" and not options.rerank:
        lex = lex.join(ungated(index, queries), "query_id", "left_anti")
    place = lex.join(index.select("row_id", "rel"), "row_id").join(queries.select("query_id", "query"), "query_id")
    lex = place.withColumn("score", boosted(F.col("score"), F.col("rel"), first_word(F.col("query")))).select("query_id", "row_id", "score", "rank")
    rows = index.select("row_id", "v") if allowed is None else index.select("row_id", "v").join(allowed, "row_id", "left_semi")
    vec = knn(rows, queries.select("query_id", "v") if options.mode != "bm25" else queries.select("query_id", "v").limit(0), min(200, max(10 * options.recall, 100)), dim)
    out = fused(lex, vec, options.alpha if options.mode == "hybrid" else 0.0 if options.mode == "vector" else 1.0, options.recall)
    fallback = F.lit("bm25-fallback") if options.mode == "hybrid" else F.lit(options.mode)
    out = out.join(queries.select("query_id", "query", F.when(F.col("can"), F.lit(options.mode)).otherwise(fallback).alias("method")), "query_id")
    if not options.rerank:
        return out.select("query_id", "row_id", "rank", "bm25", "cosine", "hybrid", F.lit(None).cast("double").alias("rerank"), "method")
    out = staged(out, "reranked-candidates")
    text = F.concat_ws("\n\n", F.nullif("heading", F.lit("")), "content")
    asked = out.join(index.select("row_id", text.alias("text")), "row_id").select("query_id", "query", "row_id", "text", "rank")
    best = reranked(asked, reranker, options.top_k)
    method = F.when(F.col("method") != "hybrid", F.col("method")).when(F.col("rerank").isNull(), "rerank-fallback").otherwise(F.lit("rerank"))
    return out.drop("rank").join(best, ["query_id", "row_id"]).select("query_id", "row_id", "rank", "bm25", "cosine", "hybrid", "rerank", method.alias("method"))


MODES = ("bm25", "literal", "vector", "hybrid", "rerank")


def by_mode(index: DataFrame, queries: DataFrame, labels: DataFrame, dim: int, k: int = 5, reranker: Callable[[str, list[str]], list[float]] | None = None, modes: tuple[str, ...] = MODES) -> DataFrame:
    """(mode, cases, recall, mrr, candidate_recall): each mode's mean over the labels (query_id, row_id) of all cases.

    Cases that a mode can't answer (no usable vector in vector mode) count 0. The candidates' recall, at depth 30 or k if
    that is more, is given for reranking, whose upper bound it is, and null elsewhere. `queries` and `index` are tables,
    written ones by preference, for every mode reads them.
    """
    depth = max(30, k)
    labels, can = staged(labels.select("query_id", "row_id").distinct(), "labels"), usable(F.col("v"), dim)
    parts = []
    for mode in modes:
        options = Options("hybrid", k, depth, rerank=True) if mode == "rerank" else Options(mode, k, depth)
        asked = queries.filter(F.coalesce(can, F.lit(False))) if mode == "vector" else queries
        got = scored(labels, retrieve(index, asked, options, dim, reranker), k)
        none = F.lit(None).cast("double")
        parts.append(got.agg(F.lit(mode).alias("mode"), F.count("*").alias("cases"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), none.alias("candidate_recall")))
        if mode == "rerank":
            whole = scored(labels, retrieve(index, queries, Options("hybrid", depth, depth), dim), depth)
            parts.append(whole.agg(F.lit(mode).alias("mode"), F.count("*").alias("cases"), none.alias("recall"), none.alias("mrr"), F.round(F.avg("recall"), 6).alias("candidate_recall")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("mode").agg(*[F.max(c).alias(c) for c in ("cases", "recall", "mrr", "candidate_recall")])  # at most two rows a mode


def described(hits: DataFrame, files: DataFrame) -> DataFrame:
    """hits (row_id, …, path), files (path, document_id, title, hash): each document of the hits once, with its version and number of hits."""
    n = hits.groupBy("path").agg(F.count("*").alias("hits"))
    return n.join(files, "path").select("document_id", "path", F.coalesce("title", F.lit("")).alias("title"), F.substring("hash", 1, 12).alias("version"), "hits")


def heading_once(title, section):
    """The heading of a text to rerank: a section that repeats the title, but for case, isn't said twice."""
    return F.when(F.lower(F.trim(title)) == F.lower(F.trim(section)), F.nullif(title, F.lit(""))).otherwise(heading(title, section))
