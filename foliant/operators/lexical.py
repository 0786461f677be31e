"""Ranked lexical retrieval in batches of queries.

A row has all that its scores need but the terms' weights: its tokens and its length. So the queries' terms are counted
in one scan of the rows, and weighed; in a second scan each task scores its rows for all queries and keeps the best of
each; only those lists are shuffled. No posting is, so a common token is no hot key, and the shuffle doesn't grow with
queries times rows. Token arrays are made in the JVM, written once and read by both scans in Arrow batches.

Queries are the small side. They go with the tasks in blocks of at most MOST_ASKED tokens, so their size is bounded; more
queries are more blocks, each with its two scans.

Scores follow the usual Okapi form with k1 = 1.2 and b = 0.75; an inverse frequency that is not positive counts 1e-6. A
term of several tokens is a phrase: its tokens one after the other.
Defined results: null and blank queries and texts match nothing; terms without a token match nothing; a term that
stands twice in a query counts twice; ties are broken by row id; rows of one id count as several rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.search import query_terms, tokens
from foliant.operators.best import NONE, Best
from foliant.sources.tables import staged

K1, B, FLOOR = 1.2, 0.75, 1e-6
MOST_ASKED = 100_000  # tokens of the queries that are answered in one pair of scans
CELLS = 4_000_000  # scores that a task holds at once
UNIT = 1e6  # scores are compared in millionths


def documents_of(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(row_id, toks): the tokens of all indexed columns, an empty token between columns, so no phrase spans two."""
    parts = []
    for c in columns:
        parts += [tokens(F.col(c)), F.array(F.lit(""))]
    return df.select(F.col(key).alias("row_id"), F.concat(*parts[:-1]).alias("toks"))


class Terms:
    """The phrases of a block of queries, and which query asks for which."""

    def __init__(self, asked: list[tuple[object, list[list[str]]]]):
        ids: dict[str, int] = {}
        phrases: dict[tuple[int, ...], int] = {}
        times: dict[tuple[int, int], int] = {}
        self.queries = [q for q, _ in asked]
        for q, (_, listed) in enumerate(asked):
            for phrase in listed:
                p = phrases.setdefault(tuple(ids.setdefault(t, len(ids)) for t in phrase), len(phrases))
                times[p, q] = times.get((p, q), 0) + 1
        self.vocabulary, self.size = list(ids), len(phrases)
        self.single = np.full(len(ids) + 1, -1)  # the last is for tokens that nobody asks for
        self.pairs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # longer phrases by their first two tokens
        for phrase, p in phrases.items():
            if len(phrase) == 1:
                self.single[phrase[0]] = p
            else:
                self.pairs.setdefault(phrase[0] * len(ids) + phrase[1], []).append((p, phrase))
        self.codes = np.array(sorted(self.pairs), np.int64)
        listed = sorted(times)
        self.asking, self.times = np.array([q for _, q in listed], np.int64), np.array([times[x] for x in listed], float)
        self.begin = np.searchsorted(np.array([p for p, _ in listed], np.int64), np.arange(self.size + 1))

    def frequencies(self, toks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, phrase, number of places) of the phrases in an array of token lists."""
        sizes = toks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(toks)), sizes)
        at = pc.index_in(toks.flatten(), value_set=pa.array(self.vocabulary, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        phrase = self.single[at]
        found = phrase >= 0
        rows, hits = [row[found]], [phrase[found]]
        if len(self.codes) and len(at) > 1:
            code = np.where((at[:-1] >= 0) & (at[1:] >= 0), at[:-1] * len(self.vocabulary) + at[1:], -1)
            place = np.searchsorted(self.codes, code)
            starts = np.flatnonzero((place < len(self.codes)) & (self.codes[np.minimum(place, len(self.codes) - 1)] == code) & (code >= 0))
            for c in np.unique(code[starts]):
                for p, phrase in self.pairs[int(c)]:
                    s = starts[(code[starts] == c) & (starts + len(phrase) <= len(at))]
                    for j in range(2, len(phrase)):
                        s = s[at[s + j] == phrase[j]]
                    s = s[row[s] == row[s + len(phrase) - 1]]
                    rows.append(row[s])
                    hits.append(np.full(len(s), p))
        key, tf = np.unique(np.concatenate(rows) * max(1, self.size) + np.concatenate(hits), return_counts=True)
        return key // max(1, self.size), key % max(1, self.size), tf

    def scores(self, toks: pa.Array, lengths: np.ndarray, idf: np.ndarray, average: float) -> np.ndarray:
        """(rows, queries) scores in millionths, NONE where no phrase occurs."""
        row, phrase, tf = self.frequencies(toks)
        gain = idf[phrase] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / average))
        many = self.begin[phrase + 1] - self.begin[phrase]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.begin[phrase], many)
        cell = np.repeat(row, many) * len(self.queries) + self.asking[place]
        shape = len(toks), len(self.queries)
        score = np.bincount(cell, np.repeat(gain, many) * self.times[place], shape[0] * shape[1])
        return np.where(score > 0, np.rint(score * UNIT), float(NONE)).astype(np.int64).reshape(shape)


def _blocks(queries: DataFrame, terms: Column | None) -> Iterator[Terms]:
    """The queries in blocks of bounded size."""
    phrases = F.filter(F.transform(query_terms(F.col("query")) if terms is None else terms, tokens), lambda p: F.size(p) > 0)
    asked = queries.select("query_id", phrases.alias("p")).filter(F.size("p") > 0)
    size = asked.agg(F.sum(F.aggregate("p", F.lit(0), lambda n, p: n + F.size(p)))).first()[0] or 0
    parts = 1 if size <= MOST_ASKED else 2 * -(-size // MOST_ASKED)
    for i in range(parts):
        some = asked if parts == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)
        if rows := [(r["query_id"], r["p"]) for r in some.collect()]:
            yield Terms(rows)


def bm25(docs: DataFrame, queries: DataFrame, k: int, allowed: DataFrame | None = None, terms: Column | None = None) -> DataFrame:
    """(query_id, row_id, score, rank): the k best rows of each query. `allowed` (row_id, and query_id or not) filters before the cut; statistics stay those of all rows."""
    kinds = [queries.schema["query_id"].dataType.simpleString(), docs.schema["row_id"].dataType.simpleString()]
    blocks = list(_blocks(queries, terms))
    if not blocks:
        return queries.sparkSession.createDataFrame([], f"query_id {kinds[0]}, row_id {kinds[1]}, score double, rank int")
    length = F.size(F.filter("toks", lambda t: t != ""))
    docs = staged(docs.select("row_id", "toks", length.alias("dl")), "tokens")  # texts are cut into tokens once, for all that follows
    by_query = allowed is not None and "query_id" in allowed.columns
    rows = docs if allowed is None or by_query else docs.join(allowed.select("row_id"), "row_id", "left_semi")
    scored = reduce(DataFrame.unionByName, [_scored(docs, rows, block, None if by_query else k, kinds) for block in blocks])
    return top(scored.join(allowed, ["query_id", "row_id"], "left_semi") if by_query else scored, k)


def _scored(docs: DataFrame, rows: DataFrame, terms: Terms, k: int | None, kinds: list[str]) -> DataFrame:
    """(query_id, row_id, score) of the k best rows of each query in each task, or of all rows with a hit."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, rows, length = sent.value, 0, 0
        df = np.zeros(terms.size, np.int64)
        for batch in batches:
            rows, length = rows + batch.num_rows, length + (pc.sum(batch.column(1)).as_py() or 0)
            df += np.bincount(terms.frequencies(batch.column(0))[1], minlength=terms.size)
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([there, [-1, -2]])), pa.array(np.concatenate([df[there], [rows, length]]))], ["phrase", "n"])

    counted = docs.select("toks", "dl").mapInArrow(count, "phrase long, n long").groupBy("phrase").agg(F.sum("n").alias("n")).collect()  # at most a row a phrase asked for
    n = {r["phrase"]: r["n"] for r in counted}
    df = np.array([n.get(p, 0) for p in range(terms.size)], float)
    idf = np.log((n.get(-1, 0) - df + 0.5) / (df + 0.5))
    weights = docs.sparkSession.sparkContext.broadcast((np.where(idf > 0, idf, FLOOR), max(n.get(-2, 0), 1) / max(n.get(-1, 0), 1)))
    row_kind = pa.string() if kinds[1] == "string" else pa.int64()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, (idf, average) = sent.value, weights.value
        best, queries = Best(len(terms.queries), k or 1), pa.array(terms.queries)
        step = max(1, min(2048, CELLS // len(terms.queries)))

        def listed(query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([queries.take(pa.array(query)), pa.array(ids.tolist(), row_kind), pa.array(score / UNIT)], ["query_id", "row_id", "score"])

        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                got = terms.scores(part.column(1), part.column(2).to_numpy(zero_copy_only=False), idf, average)
                if k is None:
                    row, query = np.nonzero(got != NONE)
                    yield listed(query, got[row, query], ids[row])
                else:
                    best.add(got, ids)
        if k is not None:
            yield listed(*best.listed())

    return rows.select("row_id", "toks", "dl").mapInArrow(score, f"query_id {kinds[0]}, row_id {kinds[1]}, score double")


def top(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best rows of each query, scores rounded so that the order of summands doesn't matter; ties by row id."""
    by = Window.partitionBy("query_id").orderBy(F.col(score).desc(), "row_id")
    return scored.withColumn(score, F.round(score, 6)).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
