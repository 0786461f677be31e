"""Queries of ranked and literal retrieval over the library's chunks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.search import MARKED, PLAIN, han_bigrams, han_index_terms, han_query_terms, tokens
from foliant.functions.text import heading, token_estimate
from foliant.operators.fusion import boosted, first_word, fused
from foliant.operators.lexical import bm25, documents_of, top
from foliant.operators.literal import containing
from foliant.operators.retrieve import Options, by_mode, described, retrieve
from foliant.operators.vectors import knn, usable
from foliant.plans.views import current, current_sql
from foliant.sources.tables import staged, table

K, RECALL, ALPHA, DIM = 10, 200, 0.3, 128
ROOT = "/library/"
HAN = r"\p{IsHan}"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, content, path below the root, heading): what is indexed of a chunk."""
    c = current(spark, d, "chunks", "id", "file_path", "chunk_content", "section")
    f = current(spark, d, "files", "path", "title")
    c = c.join(f, c["file_path"] == f["path"], "left")
    rel = F.expr(f"if(startswith(file_path, '{ROOT}'), substring(file_path, {len(ROOT) + 1}), file_path)")
    return c.select(F.col("id").alias("row_id"), F.col("chunk_content").alias("content"), rel.alias("rel"), heading(F.col("title"), F.col("section")).alias("heading"))


def _asked(spark: SparkSession, d: str, han: bool | None = None) -> DataFrame:
    q = table(spark, d, "eval_cases").select(F.col("case_id").alias("query_id"), "query").filter("query IS NOT NULL").distinct()
    return q if han is None else q.filter(F.col("query").rlike(HAN) == F.lit(han))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Best chunks of each held-out query without Han characters."""
    docs = documents_of(_chunks(spark, d), "row_id", ["content", "rel", "heading"])
    return bm25(docs, _asked(spark, d, False), K)


def bm25_han_topk(spark: SparkSession, d: str) -> DataFrame:
    """Best chunks of each held-out query with Han characters, over characters and pairs."""
    text = F.concat_ws(" ", "content", "rel", "heading")
    docs = _chunks(spark, d).select("row_id", F.concat(tokens(text), han_index_terms(text)).alias("toks"))
    return bm25(docs, _asked(spark, d, True), K, terms=han_query_terms(F.col("query")))


def bm25_prefilter(spark: SparkSession, d: str) -> DataFrame:
    """The same within files of Markdown format indexed in 2024: filtered before the cut, statistics of all rows."""
    f = current(spark, d, "files", "path", "file_format", "indexed").filter("file_format = 'markdown' AND year(indexed) = 2024")
    c = current(spark, d, "chunks", "id", "file_path")
    allowed = c.join(f, c["file_path"] == f["path"], "left_semi").select(F.col("id").alias("row_id"))
    docs = documents_of(_chunks(spark, d), "row_id", ["content", "rel", "heading"])
    return bm25(docs, _asked(spark, d, False), K, allowed)


def path_boost(spark: SparkSession, d: str) -> DataFrame:
    """The recalled chunks again with the boost of paths that begin with the query's first word."""
    found = bm25(documents_of(_chunks(spark, d), "row_id", ["content", "rel", "heading"]), _asked(spark, d, False), 50)
    x = found.join(_chunks(spark, d).select("row_id", "rel"), "row_id").join(_asked(spark, d, False), "query_id")
    x = x.withColumn("boosted", boosted(F.col("score"), F.col("rel"), first_word(F.col("query"))))
    return top(x.select("query_id", "row_id", F.round("boosted", 2).alias("boosted")), K, "boosted")


def tokenize_stats(spark: SparkSession, d: str) -> DataFrame:
    """Number of chunks, tokens, and mean length by file format."""
    c = current(spark, d, "chunks", "id", "file_path", "chunk_content")
    f = current(spark, d, "files", "path", "file_format")
    x = c.join(f, c["file_path"] == f["path"], "left").select("file_format", F.size(tokens(F.col("chunk_content"))).alias("n"))
    return x.groupBy("file_format").agg(F.count("*").alias("chunks"), F.sum("n").alias("tokens"), F.round(F.avg("n"), 6).alias("avg_tokens"), F.max("n").alias("most_tokens"))


def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Document and collection frequency of every token of the chunks."""
    c = current(spark, d, "chunks", "id", "chunk_content").select("id", F.explode(tokens(F.col("chunk_content"))).alias("token"))
    return c.groupBy("token", "id").agg(F.count("*").alias("tf")).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def han_index_terms_q(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies of Han characters and pairs over the chunks."""
    c = current(spark, d, "chunks", "id", "chunk_content").select("id", F.explode(han_index_terms(F.col("chunk_content"))).alias("term"))
    return c.groupBy("term", "id").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def han_query_terms_q(spark: SparkSession, d: str) -> DataFrame:
    """The rewritten terms of every held-out query."""
    q = _asked(spark, d)
    return q.select("query_id", F.array_join(han_query_terms(F.col("query")), " OR ").alias("terms"), F.array_join(han_bigrams(F.col("query")), " OR ").alias("pairs"), F.col("query").rlike(HAN).alias("has_han"))


def han_gate(spark: SparkSession, d: str) -> DataFrame:
    """Which Han queries have a pair that occurs anywhere: without, the lexical list is dropped."""
    pairs = _asked(spark, d, True).select("query_id", F.explode(F.array_distinct(han_bigrams(F.col("query")))).alias("term"))
    text = F.concat_ws(" ", "content", "rel", "heading")
    there = _chunks(spark, d).select(F.explode(F.array_distinct(han_bigrams(text))).alias("term")).join(pairs.select("term").distinct(), "term", "left_semi").distinct()
    return pairs.join(there.withColumn("hit", F.lit(1)), "term", "left").groupBy("query_id").agg(F.count("*").alias("pairs"), F.count("hit").alias("found")).withColumn("keep_lexical", F.col("found") > 0)


def literal_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a held-out passage literally, in order of id, the first ten of each."""
    from pyspark.sql import Window

    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("row_id"), "text").dropDuplicates(["row_id"])
    asked = table(spark, d, "eval_cases").select(F.col("case_id").alias("query_id"), F.col("passage").alias("pattern"))
    by = Window.partitionBy("query_id").orderBy(F.col("row_id").cast("long"))
    return containing(docs, asked).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= K)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_vectors").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v"), "chunk_id").dropDuplicates(["row_id"])


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Exact nearest vectors of the query set (ids divisible by 100) among all vectors."""
    v = _vectors(spark, d)
    return knn(v, v.filter(F.col("row_id") % 100 == 0).select(F.col("row_id").alias("query_id"), "v"), K, DIM).withColumn("cosine", F.round("cosine", 4))


def vector_prefilter(spark: SparkSession, d: str) -> DataFrame:
    """The same among the vectors of chunks of Markdown files only: filtered before the cut."""
    v = _vectors(spark, d)
    f = current(spark, d, "files", "path", "file_format").filter("file_format = 'markdown'")
    c = current(spark, d, "chunks", "id", "file_path").join(f, F.col("file_path") == F.col("path"), "left_semi")
    return knn(v.join(c, v["chunk_id"] == c["id"], "left_semi"), v.filter(F.col("row_id") % 100 == 0).select(F.col("row_id").alias("query_id"), "v"), K, DIM).withColumn("cosine", F.round("cosine", 4))


def _hybrid_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lexical and vector lists of the query set: a query is a vector and the first eight words of its chunk."""
    v = _vectors(spark, d).join(current(spark, d, "chunks", "id", "chunk_content").withColumnRenamed("id", "chunk_id"), "chunk_id")
    asked = v.filter(F.col("row_id") % 100 == 0)
    text = asked.select(F.col("row_id").alias("query_id"), F.array_join(F.slice(F.split("chunk_content", r"\s+"), 1, 8), " ").alias("query"))
    docs = documents_of(v.select("row_id", "chunk_content"), "row_id", ["chunk_content"])
    return bm25(docs, text, 50), knn(v.select("row_id", "v"), asked.select(F.col("row_id").alias("query_id"), "v"), 50, DIM)


def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Weighted fusion of both lists."""
    out = fused(*_hybrid_lists(spark, d), ALPHA, K)
    return out.select("query_id", "row_id", "rank", F.round("bm25", 4).alias("bm25"), F.round("cosine", 4).alias("cosine"), F.round("hybrid", 3).alias("hybrid"))


def hybrid_alpha_sweep(spark: SparkSession, d: str) -> DataFrame:
    """How many of the best ten are shared with the vector list, for several weights."""
    lex, vec = (staged(x, "ranked-lists") for x in _hybrid_lists(spark, d))
    near = vec.filter(F.col("rank") <= K).select("query_id", "row_id", F.lit(1).alias("near"))
    parts = [fused(lex, vec, a, K).join(near, ["query_id", "row_id"], "left").agg(F.lit(a).alias("alpha"), F.count("*").alias("hits"), F.count("near").alias("shared")) for a in (0.0, 0.3, 0.5, 1.0)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def bm25_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Queries whose vector can't be used fall back to the lexical list alone: method and number of hits."""
    v = table(spark, d, "chunk_vectors").dropDuplicates(["vec_id"]).join(current(spark, d, "chunks", "id", "chunk_content").withColumnRenamed("id", "chunk_id"), "chunk_id")
    asked = v.select(F.col("vec_id").alias("query_id"), F.when(usable(F.col("embedding"), DIM), "hybrid").otherwise("bm25-fallback").alias("method"))
    return asked.groupBy("method").agg(F.count("*").alias("queries"), F.min("query_id").alias("first"))


def _library(spark: SparkSession, d: str) -> DataFrame:
    """The index of the chunks that have a vector: (row_id, content, rel, heading, v)."""
    v = _vectors(spark, d)
    c = _chunks(spark, d).withColumnRenamed("row_id", "chunk_id")
    return staged(v.join(c, "chunk_id").select("row_id", "content", "rel", "heading", "v"), "library")


def _asked_of(library: DataFrame) -> DataFrame:
    """The query set: every vector whose id is divisible by 100, with the first eight words of its chunk."""
    words = F.array_join(F.slice(F.split("content", r"\s+"), 1, 8), " ")
    return library.filter(F.col("row_id") % 100 == 0).select(F.col("row_id").alias("query_id"), words.alias("query"), "v")


def hybrid_query(spark: SparkSession, d: str) -> DataFrame:
    """Whole retrieval of the query set: both analyzers, boost, gate, fusion, and the lexical fallback where a vector can't be used."""
    index = _library(spark, d)
    out = retrieve(index, _asked_of(index), Options(top_k=K, alpha=ALPHA), DIM)
    return out.select("query_id", "row_id", "rank", "method", F.round("hybrid", 3).alias("hybrid"))


def fallback_query(spark: SparkSession, d: str) -> DataFrame:
    """The hits of the queries without a usable vector: by the lexical list alone."""
    index = _library(spark, d)
    asked = _asked_of(index).filter(~F.coalesce(usable(F.col("v"), DIM), F.lit(False)))
    return retrieve(index, asked, Options(top_k=K, alpha=ALPHA), DIM).select("query_id", "row_id", "rank", "method", F.round("hybrid", 3).alias("hybrid"))


def shared_words(query: str, texts: list[str]) -> list[float]:
    """A stand-in for a reranking model: the share of the query's words that a text has."""
    words = set(re.findall(r"\w+", query.lower()))
    return [len(words & set(re.findall(r"\w+", t.lower()))) / max(1, len(words)) for t in texts]


def rerank_query(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid candidates of the query set, ranked anew by a provider, one call a query."""
    index = _library(spark, d)
    out = retrieve(index, _asked_of(index), Options(top_k=K, candidates=30, alpha=ALPHA, rerank=True), DIM, shared_words)
    return out.select("query_id", "row_id", "rank", "method", F.round("rerank", 4).alias("rerank"))


def eval_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Every mode on known items: a case of the query set is answered by the chunk that its words and vector are of."""
    index = _library(spark, d)
    asked = staged(_asked_of(index), "cases")
    return by_mode(index, asked, asked.select("query_id", F.col("query_id").alias("row_id")), DIM, K, shared_words)


def literal_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that hold the first 60 characters, white space left out, of the query set's chunks, by path and place, the first ten of each."""
    from pyspark.sql import Window

    c = current(spark, d, "chunks", "id", "file_path", "chunk_content", "chunk_index")
    v = _vectors(spark, d).filter(F.col("row_id") % 100 == 0).select(F.col("row_id").alias("query_id"), F.col("chunk_id").alias("id"))
    asked = v.join(c, "id").select("query_id", F.substring(F.translate("chunk_content", " \n\t\r", ""), 1, 60).alias("pattern"))
    met = containing(c.select(F.col("id").alias("row_id"), F.col("chunk_content").alias("text")), asked)
    by = Window.partitionBy("query_id").orderBy("file_path", "chunk_index", "row_id")
    return met.join(c.select(F.col("id").alias("row_id"), "file_path", "chunk_index"), "row_id").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= K).select("query_id", "row_id", "rank")


def hit_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents of all lexical hits, each once, with version and number of hits."""
    hits = bm25_topk(spark, d).join(current(spark, d, "chunks", "id", "file_path").select(F.col("id").alias("row_id"), F.col("file_path").alias("path")), "row_id")
    return described(hits, current(spark, d, "files", "path", "document_id", "title", "hash"))


def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each query ranked anew by the share of query words that heading and content hold."""
    found = bm25(documents_of(_chunks(spark, d), "row_id", ["content", "rel", "heading"]), _asked(spark, d, False), 30)
    x = found.select("query_id", "row_id").join(_chunks(spark, d), "row_id").join(_asked(spark, d, False), "query_id")
    words = F.array_distinct(tokens(F.col("query")))
    text = tokens(F.concat_ws("\n\n", F.nullif("heading", F.lit("")), "content"))
    return top(x.select("query_id", "row_id", (F.size(F.array_intersect(words, text)) / F.greatest(F.size(words), F.lit(1))).alias("rerank")), K, "rerank")


def query_usage(spark: SparkSession, d: str) -> DataFrame:
    """Calls and estimated tokens that embedding each query and reranking its candidates cost."""
    found = bm25(documents_of(_chunks(spark, d), "row_id", ["content", "rel", "heading"]), _asked(spark, d, False), 30)
    x = found.select("query_id", "row_id").join(_chunks(spark, d).select("row_id", token_estimate(F.concat_ws("\n\n", F.nullif("heading", F.lit("")), "content")).alias("t")), "row_id")
    per = x.groupBy("query_id").agg(F.sum("t").alias("rerank_tokens"), F.count("*").alias("candidates"))
    q = _asked(spark, d, False).select("query_id", token_estimate(F.col("query")).alias("embedding_tokens"))
    return q.join(per, "query_id", "left").fillna(0)


QUERIES = {
    "bm25_topk": bm25_topk,
    "bm25_han_topk": bm25_han_topk,
    "bm25_prefilter": bm25_prefilter,
    "path_boost": path_boost,
    "tokenize_stats": tokenize_stats,
    "term_statistics": term_statistics,
    "han_index_terms": han_index_terms_q,
    "han_query_terms": han_query_terms_q,
    "han_gate": han_gate,
    "literal_search": literal_search,
    "vector_topk": vector_topk,
    "vector_prefilter": vector_prefilter,
    "hybrid_fusion": hybrid_fusion,
    "hybrid_alpha_sweep": hybrid_alpha_sweep,
    "bm25_fallback": bm25_fallback,
    "rerank_overlap": rerank_overlap,
    "query_usage": query_usage,
    "hybrid_query": hybrid_query,
    "fallback_query": fallback_query,
    "rerank_query": rerank_query,
    "literal_chunks": literal_chunks,
    "eval_retrieval": eval_retrieval,
    "hit_documents": hit_documents,
}

# --- the same in SQL ---


def _tok(x: str) -> str:
    return f"regexp_extract_all(translate(lower(coalesce({x}, '')), '{MARKED}', '{PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"


_HEAD = "concat_ws(' > ', nullif(f.title, ''), nullif(c.section, ''))"
_REL = f"CASE WHEN starts_with(c.file_path, '{ROOT}') THEN substr(c.file_path, {len(ROOT) + 1}) ELSE c.file_path END"
_CHUNKS = f"""ch AS (SELECT c.id AS row_id, c.chunk_content AS content, {_REL} AS rel, {_HEAD} AS heading
  FROM {current_sql("chunks", "id", "file_path", "chunk_content", "section")} c LEFT JOIN {current_sql("files", "path", "title")} f ON c.file_path = f.path)"""
_LATIN = "asked AS (SELECT DISTINCT case_id AS query_id, query FROM eval_cases WHERE query IS NOT NULL AND NOT regexp_matches(query, '\\p{Han}'))"
_HANQ = "asked AS (SELECT DISTINCT case_id AS query_id, query FROM eval_cases WHERE query IS NOT NULL AND regexp_matches(query, '\\p{Han}'))"
_DOCS = f"docs AS (SELECT row_id, list_concat({_tok('content')}, [''], {_tok('rel')}, [''], {_tok('heading')}) AS toks FROM ch)"
_TERMS = "list_filter(string_split(trim(regexp_replace(query, '[\\t\\n\\f\\r ]+', ' ', 'g')), ' '), lambda t: t <> '')"


def _grams(run: str, n: int) -> str:
    return f"list_transform(range(1, length({run}) - {n - 2}), lambda i: substr({run}, CAST(i AS INTEGER), {n}))"


_RUNS = "regexp_extract_all(coalesce({0}, ''), '\\p{{Han}}+')"


def _han_terms(x: str, pairs_only: bool = False) -> str:
    one = _grams("r", 2) if pairs_only else f"list_concat({_grams('r', 1)}, {_grams('r', 2)})"
    return f"flatten(list_transform({_RUNS.format(x)}, lambda r: {one}))"


_HAN_QUERY = "flatten(list_transform(regexp_extract_all(replace(regexp_replace(query, '(\\p{Han}+)', ' \\1 ', 'g'), '_', '_'), '[\\p{L}\\p{N}_]+'), lambda r: CASE WHEN regexp_matches(r, '^\\p{Han}') AND length(r) > 1 THEN " + _grams("r", 2) + " ELSE [r] END))"


def _bm25_sql(k: int, name: str = "ranked", terms: str = _TERMS, allowed: str = "") -> str:
    """CTEs from docs (row_id, toks) and asked (query_id, query) to `name` (query_id, row_id, score, rank)."""
    return f"""sized AS (SELECT row_id, toks, len(list_filter(toks, lambda t: t <> '')) AS dl FROM docs),
whole AS (SELECT count(*) AS n_all, avg(dl) AS avgdl FROM sized),
term AS (SELECT query_id, unnest(range(len(ts))) AS phrase_no, unnest(ts) AS term FROM (SELECT query_id, {terms} AS ts FROM asked)),
ph AS (SELECT query_id, phrase_no, len(p) AS m, unnest(range(len(p))) AS pos, unnest(p) AS token FROM (SELECT query_id, phrase_no, {_tok('term')} AS p FROM term)),
posting AS (SELECT row_id, dl, unnest(range(len(toks))) AS place, unnest(toks) AS token FROM sized),
hits AS (SELECT p.row_id, p.dl, p.place, h.query_id, h.phrase_no, h.m, h.pos FROM posting p JOIN ph h USING (token)),
occ0 AS (SELECT query_id, phrase_no, row_id, dl, m, place - pos AS start FROM hits GROUP BY ALL HAVING count(*) = m),
occ AS (SELECT query_id, phrase_no, row_id, dl, count(*) AS tf FROM occ0 GROUP BY ALL),
w AS (SELECT query_id, phrase_no, CASE WHEN ln((n_all - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_all - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf
  FROM (SELECT query_id, phrase_no, count(*) AS df FROM occ GROUP BY ALL), whole),
scored AS (SELECT o.query_id, o.row_id, round(sum(w.idf * o.tf * 2.2 / (o.tf + 1.2 * (0.25 + 0.75 * o.dl / avgdl))), 6) AS score
  FROM occ o JOIN w USING (query_id, phrase_no), whole {allowed} GROUP BY o.query_id, o.row_id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM scored) WHERE rank <= {k})"""


_VEC = f"""vecs AS (SELECT DISTINCT vec_id AS row_id, chunk_id, embedding FROM chunk_vectors WHERE len(embedding) = {DIM}
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
unit AS (SELECT row_id, chunk_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM vecs)"""


def _knn_sql(k: int, rows: str = "unit") -> str:
    return f"""cosines AS (SELECT q.row_id AS query_id, r.row_id, round(list_dot_product(q.v, r.v), 6) AS cosine FROM unit q, {rows} r WHERE q.row_id % 100 = 0),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, row_id) AS rank FROM cosines) WHERE rank <= {k})"""


_HYBRID = f"""WITH {_VEC}, cv AS (SELECT u.row_id, u.v, c.chunk_content FROM (SELECT DISTINCT vec_id, chunk_id FROM chunk_vectors) x
  JOIN {current_sql("chunks", "id", "chunk_content")} c ON x.chunk_id = c.id LEFT JOIN unit u ON u.row_id = x.vec_id),
cv_all AS (SELECT x.vec_id AS row_id, c.chunk_content FROM (SELECT DISTINCT vec_id, chunk_id FROM chunk_vectors) x JOIN {current_sql("chunks", "id", "chunk_content")} c ON x.chunk_id = c.id),
docs AS (SELECT row_id, {_tok('chunk_content')} AS toks FROM cv_all),
asked AS (SELECT row_id AS query_id, array_to_string(regexp_split_to_array(chunk_content, '\\s+')[1:8], ' ') AS query FROM cv_all WHERE row_id % 100 = 0),
{_bm25_sql(50)},
uv AS (SELECT row_id, v FROM cv WHERE v IS NOT NULL),
cosines AS (SELECT q.row_id AS query_id, r.row_id, round(list_dot_product(q.v, r.v), 6) AS cosine FROM uv q, uv r WHERE q.row_id % 100 = 0),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, row_id) AS rank FROM cosines) WHERE rank <= 50),
a AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM ranked WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT *, CASE WHEN max(cosine) OVER w = min(cosine) OVER w THEN 1.0 ELSE (cosine - min(cosine) OVER w) / (max(cosine) OVER w - min(cosine) OVER w) END AS s FROM near WINDOW w AS (PARTITION BY query_id)),
u AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.row_id, b.row_id) AS row_id, a.score, b.cosine, a.rank AS lr, b.rank AS vr, a.s AS sa, b.s AS sb FROM a FULL JOIN b ON a.query_id = b.query_id AND a.row_id = b.row_id),
uw AS (SELECT *, max(CASE WHEN vr IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY query_id) AS anyv FROM u)"""

_WIDE = "\\x{{3400}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}\\x{{3040}}-\\x{{30FF}}\\x{{AC00}}-\\x{{D7AF}}"
_ESTIMATE = f"greatest(1, length(regexp_replace({{0}}, '[^{_WIDE}]', '', 'g')) + (length(regexp_replace({{0}}, '[{_WIDE}]', '', 'g')) + 3) // 4)"

SQL = {
    "bm25_topk": f"WITH {_CHUNKS}, {_LATIN}, {_DOCS}, {_bm25_sql(K)} SELECT query_id, row_id, score, rank FROM ranked",
    "bm25_han_topk": f"""WITH {_CHUNKS}, {_HANQ}, docs AS (SELECT row_id, list_concat({_tok('t')}, {_han_terms('t')}) AS toks FROM (SELECT row_id, concat_ws(' ', content, rel, heading) AS t FROM ch)),
{_bm25_sql(K, terms=_HAN_QUERY)} SELECT query_id, row_id, score, rank FROM ranked""",
    "bm25_prefilter": f"""WITH {_CHUNKS}, {_LATIN}, {_DOCS}, ok AS (SELECT c.id FROM {current_sql("chunks", "id", "file_path")} c JOIN {current_sql("files", "path", "file_format", "indexed")} f
  ON c.file_path = f.path WHERE f.file_format = 'markdown' AND year(f.indexed) = 2024), {_bm25_sql(K, allowed="WHERE o.row_id IN (SELECT id FROM ok)")} SELECT query_id, row_id, score, rank FROM ranked""",
    "path_boost": f"""WITH {_CHUNKS}, {_LATIN}, {_DOCS}, {_bm25_sql(50)},
x AS (SELECT r.query_id, r.row_id, round(CASE WHEN len(list_filter(regexp_extract_all(lower(ch.rel), '[\\p{{L}}\\p{{Nd}}]+'), lambda w: starts_with(w, list_filter(regexp_extract_all(lower(q.query), '[\\p{{L}}\\p{{Nd}}]+'), lambda v: length(v) > 1)[1]))) > 0 THEN r.score * 1.5 ELSE r.score END, 2) AS boosted
  FROM ranked r JOIN ch USING (row_id) JOIN asked q USING (query_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, row_id) AS rank FROM x) WHERE rank <= {K}""",
    "tokenize_stats": f"""SELECT file_format, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS tokens, round(avg(n), 6) AS avg_tokens, max(n) AS most_tokens
FROM (SELECT f.file_format, len({_tok('c.chunk_content')}) AS n FROM {current_sql("chunks", "id", "file_path", "chunk_content")} c LEFT JOIN {current_sql("files", "path", "file_format")} f ON c.file_path = f.path) GROUP BY file_format""",
    "term_statistics": f"""SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT token, id, count(*) AS tf FROM (SELECT id, unnest({_tok('chunk_content')}) AS token FROM {current_sql("chunks", "id", "chunk_content")}) GROUP BY ALL) GROUP BY token""",
    "han_index_terms": f"""SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest({_han_terms('chunk_content')}) AS term FROM {current_sql("chunks", "id", "chunk_content")}) GROUP BY ALL) GROUP BY term""",
    "han_query_terms": f"""SELECT query_id, array_to_string({_HAN_QUERY}, ' OR ') AS terms, array_to_string({_han_terms('query', True)}, ' OR ') AS pairs, regexp_matches(query, '\\p{{Han}}') AS has_han FROM (SELECT DISTINCT case_id AS query_id, query FROM eval_cases WHERE query IS NOT NULL)""",
    "han_gate": f"""WITH {_CHUNKS}, {_HANQ}, p AS (SELECT query_id, unnest(list_distinct({_han_terms('query', True)})) AS term FROM asked),
t AS (SELECT DISTINCT unnest({_han_terms('t', True)}) AS term FROM (SELECT concat_ws(' ', content, rel, heading) AS t FROM ch))
SELECT query_id, count(*) AS pairs, count(t.term) AS found, count(t.term) > 0 AS keep_lexical FROM p LEFT JOIN t USING (term) GROUP BY query_id""",
    "literal_search": f"""WITH q AS (SELECT DISTINCT case_id AS query_id, translate(passage, ' ' || chr(10) || chr(9) || chr(13), '') AS p FROM eval_cases WHERE passage IS NOT NULL),
c AS (SELECT DISTINCT doc_id, translate(text, ' ' || chr(10) || chr(9) || chr(13), '') AS t FROM documents WHERE text IS NOT NULL)
SELECT query_id, row_id, rank FROM (SELECT query_id, CAST(doc_id AS VARCHAR) AS row_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM q JOIN c ON p <> '' AND contains(t, p)) WHERE rank <= {K}""",
    "vector_topk": f"WITH {_VEC}, {_knn_sql(K)} SELECT query_id, row_id, round(cosine, 4) AS cosine, rank FROM near",
    "vector_prefilter": f"""WITH {_VEC}, ok AS (SELECT c.id FROM {current_sql("chunks", "id", "file_path")} c JOIN {current_sql("files", "path", "file_format")} f ON c.file_path = f.path WHERE f.file_format = 'markdown'),
rows_ AS (SELECT * FROM unit WHERE chunk_id IN (SELECT id FROM ok)), {_knn_sql(K, "rows_")} SELECT query_id, row_id, round(cosine, 4) AS cosine, rank FROM near""",
    "hybrid_fusion": f"""{_HYBRID}, f AS (SELECT *, round((CASE WHEN anyv = 1 THEN {ALPHA} ELSE 1.0 END) * coalesce(sa, 0) + (1 - (CASE WHEN anyv = 1 THEN {ALPHA} ELSE 1.0 END)) * coalesce(sb, 0), 6) AS hybrid FROM uw)
SELECT query_id, row_id, rank, round(coalesce(score, 0), 4) AS bm25, round(coalesce(cosine, 0), 4) AS cosine, round(hybrid, 3) AS hybrid
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, lr NULLS LAST, vr NULLS LAST) AS rank FROM f) WHERE rank <= {K}""",
    "hybrid_alpha_sweep": f"""{_HYBRID}, al AS (SELECT unnest([0.0, 0.3, 0.5, 1.0]::DOUBLE[]) AS alpha),
f AS (SELECT *, round((CASE WHEN anyv = 1 THEN alpha ELSE 1.0 END) * coalesce(sa, 0) + (1 - (CASE WHEN anyv = 1 THEN alpha ELSE 1.0 END)) * coalesce(sb, 0), 6) AS hybrid FROM uw, al)
SELECT alpha, count(*) AS hits, count(CASE WHEN vr <= {K} THEN 1 END) AS shared
FROM (SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY hybrid DESC, lr NULLS LAST, vr NULLS LAST) AS rank FROM f) WHERE rank <= {K} GROUP BY alpha""",
    "bm25_fallback": f"""WITH {_VEC}, x AS (SELECT DISTINCT vec_id, chunk_id FROM chunk_vectors)
SELECT CASE WHEN u.row_id IS NULL THEN 'bm25-fallback' ELSE 'hybrid' END AS method, count(*) AS queries, min(x.vec_id) AS first
FROM x JOIN {current_sql("chunks", "id", "chunk_content")} c ON x.chunk_id = c.id LEFT JOIN unit u ON u.row_id = x.vec_id GROUP BY 1""",
    "rerank_overlap": f"""WITH {_CHUNKS}, {_LATIN}, {_DOCS}, {_bm25_sql(30)},
x AS (SELECT r.query_id, r.row_id, list_distinct({_tok('q.query')}) AS ws, {_tok("concat_ws(chr(10) || chr(10), nullif(ch.heading, ''), ch.content)")} AS ts FROM ranked r JOIN ch USING (row_id) JOIN asked q USING (query_id)),
y AS (SELECT query_id, row_id, round(len(list_intersect(ws, ts)) / greatest(len(ws), 1), 6) AS rerank FROM x)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, row_id) AS rank FROM y) WHERE rank <= {K}""",
    "query_usage": f"""WITH {_CHUNKS}, {_LATIN}, {_DOCS}, {_bm25_sql(30)},
x AS (SELECT r.query_id, CAST(sum({_ESTIMATE.format("concat_ws(chr(10) || chr(10), nullif(ch.heading, ''), ch.content)")}) AS BIGINT) AS rerank_tokens, count(*) AS candidates FROM ranked r JOIN ch USING (row_id) GROUP BY 1)
SELECT q.query_id, {_ESTIMATE.format("q.query")} AS embedding_tokens, coalesce(x.rerank_tokens, 0) AS rerank_tokens, coalesce(x.candidates, 0) AS candidates FROM asked q LEFT JOIN x ON x.query_id = q.query_id""",
}


_HANS = "regexp_matches(query, '\\p{Han}')"
_BASE = f"""WITH {_CHUNKS}, {_VEC},
base AS (SELECT x.vec_id AS row_id, ch.content, ch.rel, ch.heading FROM (SELECT DISTINCT vec_id, chunk_id FROM chunk_vectors) x JOIN ch ON x.chunk_id = ch.row_id),
ask AS (SELECT row_id AS query_id, array_to_string(regexp_split_to_array(content, '\\s+')[1:8], ' ') AS query FROM base WHERE row_id % 100 = 0),
lat AS (WITH docs AS (SELECT row_id, list_concat({_tok('content')}, [''], {_tok('rel')}, [''], {_tok('heading')}) AS toks FROM base), asked AS (SELECT * FROM ask WHERE NOT {_HANS}), {_bm25_sql(200)} SELECT query_id, row_id, score, rank FROM ranked),
hans AS (WITH docs AS (SELECT row_id, list_concat({_tok('t')}, {_han_terms('t')}) AS toks FROM (SELECT row_id, concat_ws(' ', content, rel, heading) AS t FROM base)), asked AS (SELECT * FROM ask WHERE {_HANS}), {_bm25_sql(200, terms=_HAN_QUERY)} SELECT query_id, row_id, score, rank FROM ranked),
pairs AS (SELECT query_id, unnest(list_distinct({_han_terms('query', True)})) AS term FROM ask),
there AS (SELECT DISTINCT unnest({_han_terms('t', True)}) AS term FROM (SELECT concat_ws(' ', content, rel, heading) AS t FROM base)),
shut AS (SELECT query_id FROM pairs LEFT JOIN there USING (term) GROUP BY query_id HAVING count(there.term) = 0),
lex0 AS (SELECT * FROM lat UNION ALL SELECT * FROM hans),
lex AS (SELECT l.query_id, l.row_id, l.rank, CASE WHEN len(list_filter(regexp_extract_all(lower(b.rel), '[\\p{{L}}\\p{{Nd}}]+'), lambda w: starts_with(w, list_filter(regexp_extract_all(lower(q.query), '[\\p{{L}}\\p{{Nd}}]+'), lambda v: length(v) > 1)[1]))) > 0 THEN l.score * 1.5 ELSE l.score END AS score
  FROM lex0 l JOIN base b USING (row_id) JOIN ask q USING (query_id) WHERE l.query_id NOT IN (SELECT query_id FROM shut)),
rows_ AS (SELECT * FROM unit WHERE row_id IN (SELECT row_id FROM base)),
cosines AS (SELECT q.row_id AS query_id, r.row_id, round(list_dot_product(q.v, r.v), 6) AS cosine FROM rows_ q, rows_ r WHERE q.row_id % 100 = 0),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, row_id) AS rank FROM cosines) WHERE rank <= 100),
a AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM lex WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT *, CASE WHEN max(cosine) OVER w = min(cosine) OVER w THEN 1.0 ELSE (cosine - min(cosine) OVER w) / (max(cosine) OVER w - min(cosine) OVER w) END AS s FROM near WINDOW w AS (PARTITION BY query_id)),
u AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.row_id, b.row_id) AS row_id, a.rank AS lr, b.rank AS vr, a.s AS sa, b.s AS sb FROM a FULL JOIN b ON a.query_id = b.query_id AND a.row_id = b.row_id),
uw AS (SELECT *, max(CASE WHEN vr IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY query_id) AS anyv FROM u),
f AS (SELECT *, round((CASE WHEN anyv = 1 THEN {ALPHA} ELSE 1.0 END) * coalesce(sa, 0) + (1 - (CASE WHEN anyv = 1 THEN {ALPHA} ELSE 1.0 END)) * coalesce(sb, 0), 6) AS hybrid FROM uw),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, lr NULLS LAST, vr NULLS LAST) AS rank FROM f)"""
_OUT = f"SELECT query_id, row_id, rank, CASE WHEN query_id IN (SELECT row_id FROM unit) THEN 'hybrid' ELSE 'bm25-fallback' END AS method, round(hybrid, 3) AS hybrid FROM o WHERE rank <= {K}"
SQL |= {
    "hybrid_query": f"{_BASE} {_OUT}",
    "fallback_query": f"{_BASE} SELECT * FROM ({_OUT}) WHERE method = 'bm25-fallback'",
    "literal_chunks": f"""WITH c AS (SELECT *, translate(chunk_content, ' ' || chr(10) || chr(9) || chr(13), '') AS t FROM {current_sql("chunks", "id", "file_path", "chunk_content", "chunk_index")}),
q AS (SELECT DISTINCT x.vec_id AS query_id, substr(c.t, 1, 60) AS p FROM (SELECT DISTINCT vec_id, chunk_id FROM chunk_vectors WHERE vec_id % 100 = 0) x JOIN c ON c.id = x.chunk_id)
SELECT query_id, id AS row_id, rank FROM (SELECT q.query_id, c.id, row_number() OVER (PARTITION BY q.query_id ORDER BY c.file_path, c.chunk_index, c.id) AS rank FROM q JOIN c ON p <> '' AND contains(c.t, p)) WHERE rank <= {K}""",
    "hit_documents": f"""WITH {_CHUNKS}, {_LATIN}, {_DOCS}, {_bm25_sql(K)}, h AS (SELECT c.file_path AS path, count(*) AS hits FROM ranked r JOIN {current_sql("chunks", "id", "file_path")} c ON c.id = r.row_id GROUP BY 1)
SELECT f.document_id, h.path, coalesce(f.title, '') AS title, substr(f.hash, 1, 12) AS version, h.hits FROM h JOIN {current_sql("files", "path", "document_id", "title", "hash")} f ON f.path = h.path""",
}
