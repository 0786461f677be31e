"""Exact nearest vectors for a stated set of query vectors.

Every row is looked at, nothing is sampled. The query set goes with the tasks in blocks of at most MOST_SENT bytes; each
task multiplies its Arrow batches with a block, row slice by query slice, keeps the K best of each query, and only those
lists are shuffled. A block is one scan of the rows, so a scan answers tens of thousands of queries. Vectors of another
length, with a null, NaN or infinite number, or all zero take no part, as rows or as queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.best import Best
from foliant.operators.lexical import UNIT, top

MOST_SENT = 64 << 20  # bytes of the query vectors of a block
SLICE = 2048  # rows, and queries, of one product


def usable(vector: Column, dim: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0)


def unit(vector: Column) -> Column:
    """The vector scaled to length 1, in doubles."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(wide, lambda x: x / norm)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    na, nb = (F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)) for v in (a, b))
    return F.when((na > 0) & (nb > 0), dot / (na * nb)).otherwise(F.lit(0.0))


def knn(rows: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """rows (row_id, v), queries (query_id, v) -> (query_id, row_id, cosine, rank), by distance of unit vectors."""
    rows, queries = rows.filter(usable(F.col("v"), dim)).select("row_id", "v"), queries.filter(usable(F.col("v"), dim)).select("query_id", "v")
    size = queries.count() * 8 * dim
    parts = 1 if size <= MOST_SENT else 2 * -(-size // MOST_SENT)
    blocks = [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) if parts > 1 else queries for i in range(parts)]
    return top(reduce(DataFrame.unionByName, [_against(rows, block.toArrow(), k, dim) for block in blocks]), k, "cosine")


def _units(vectors: pa.Array, dim: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _against(rows: DataFrame, block: pa.Table, k: int, dim: int) -> DataFrame:
    block = block.combine_chunks()
    asked = np.concatenate([_units(c, dim) for c in block.column("v").chunks] or [np.zeros((0, dim))])
    sent = rows.sparkSession.sparkContext.broadcast((block.column("query_id").to_numpy(), asked))
    kinds = [rows.schema["row_id"].dataType.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = sent.value
        best = [Best(len(asked[q : q + SLICE]), k) for q in range(0, len(asked), SLICE)]
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                x, names = _units(part.column(1), dim), part.column(0).to_numpy(zero_copy_only=False)
                for i, b in enumerate(best):
                    b.add(np.rint((x @ asked[i * SLICE : (i + 1) * SLICE].T) * UNIT).astype(np.int64), names)
        for i, b in enumerate(best):
            query, score, names = b.listed()
            yield pa.RecordBatch.from_arrays([pa.array(ids[query + i * SLICE]), pa.array(names.tolist(), pa.string() if kinds[0] == "string" else pa.int64()), pa.array(score / UNIT)], ["query_id", "row_id", "cosine"])

    return rows.mapInArrow(run, f"query_id long, row_id {kinds[0]}, cosine double")
