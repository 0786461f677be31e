"""Embedding and reranking as columns. Providers are injected; nothing here calls a network.

A provider embeds a list of texts; the stage batches Arrow rows for it, checks the answer, and retries what it calls
transient. Use it as a stage of its own, written out once, so that a retried task is the only repeated call.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Transient(Exception):
    """A failure that a later try may mend (rate limits, server errors, transport)."""


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashedWords:
    """A stand-in without a model: words hashed into signed dimensions."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dimensions] += 1.0 if h >> 63 else -1.0
            if not out[i].any():
                out[i, 0] = 1.0
        return out.tolist()


def normalised(vectors: list[list[float]], dim: int, expected: int) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    if x.shape != (expected, dim):
        raise ValueError("the model returned another number or length of vectors")
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    if not np.isfinite(x).all() or (norm == 0).any():
        raise ValueError("the model returned a vector that can't be scaled")
    return (x / norm).astype(np.float32)


def embedding(provider: Embedder, batch: int = 64, tries: int = 3, wait: Callable[[float], None] = time.sleep) -> Callable[[Column], Column]:
    """A column function that embeds texts in batches."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts, rows = part.fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                some = texts[i : i + batch]
                for t in range(tries + 1):
                    try:
                        rows.extend(normalised(provider.embed(some), provider.dimensions, len(some)).tolist())
                        break
                    except Transient:
                        if t == tries:
                            raise
                        wait(min(2.0**t, 8.0) / 2)
            yield pd.Series(rows)

    return run


def reranked(candidates: DataFrame, score: Callable[[str, list[str]], list[float]], k: int, most: int = 200) -> DataFrame:
    """candidates (query_id, query, row_id, text, rank) -> (query_id, row_id, rerank, rank): one call of the provider a query.

    At most `most` candidates of a query are sent, the best by rank, which is the feature. A query whose call stays
    Transient keeps its order, with null scores. Scores must be finite, one for each text; ties go by row id.
    """
    if not 1 <= k <= most:
        raise ValueError(f"k must be within 1 and {most}")
    first = candidates.withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "row_id"))).filter(F.col("__n") <= most)
    one = F.sort_array(F.collect_list(F.struct("__n", "row_id", "text")))  # at most `most`
    asked = first.groupBy("query_id").agg(F.first("query").alias("query"), one.alias("c"))

    @F.pandas_udf("array<double>")
    def run(queries: pd.Series, listed: pd.Series) -> pd.Series:
        out = []
        for q, c in zip(queries, listed):
            try:
                got = [float(x) for x in score(q, [x["text"] for x in c])]
            except Transient:
                out.append(None)
                continue
            if len(got) != len(c) or not np.isfinite(got).all():
                raise ValueError("the reranker returned another number of scores, or one that isn't finite")
            out.append(got)
        return pd.Series(out)

    scored = asked.withColumn("s", run("query", "c")).select("query_id", F.posexplode("c").alias("at", "c"), "s")
    x = scored.select("query_id", F.col("c.row_id").alias("row_id"), F.get("s", F.col("at")).alias("rerank"), "at")
    by = Window.partitionBy("query_id").orderBy(F.col("rerank").desc_nulls_last(), F.when(F.col("rerank").isNull(), F.col("at")), "row_id")
    return x.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).drop("at")
