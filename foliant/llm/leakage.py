"""Evaluation texts leaking into training text, by greedy string tiling.

Texts become token sequences; every `run` consecutive tokens of a held-out passage have a Karp-Rabin hash. Documents
roll the same hash over their tokens in Arrow batches and look each window up among the hashes of the passages;
each hit is checked token by token. Hits on one diagonal join into maximal matches, and for each pair of document and
item the longest match that overlaps no earlier one is marked, again and again, down to `run` tokens. The covered part
of the passage, in whatever order its pieces stand, is the coverage.

The passages are the small side: their windows are sent to all tasks only while there are at most `MOST_WINDOWS` of
them; beyond, documents and passages meet in a shuffled join on the window hash, with the same rows. Documents are
scanned once and never shuffled in the first way; only pairs with a hit leave the scan. A group of matches belongs to
one document and one item, so no key gathers more than one text's matches.

Defined results: null and empty texts and passages, and passages of fewer than `run` tokens, have no row; repeated
rows count once; items that share a text each get their row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.tables import table

RUN, MOST_WINDOWS = 16, 2_000_000
# Code points that are a token each.
SINGLE = "㐀-鿿豈-﫿぀-ヿ"
TOKEN = re.compile(f"[{SINGLE}]|[^\\W_{SINGLE}]+")
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def rolled(ids: np.ndarray, run: int) -> np.ndarray:
    """Karp-Rabin hashes (mod 2^64) of all windows of `run` ids."""
    n = len(ids) - run + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        with np.errstate(over="ignore"):
            for j in range(run):
                out = out * BASE + x[j : j + n]
    return out


class Passages:
    """Token ids of the passages and the sorted hashes of their windows."""

    def __init__(self, rows: list[tuple[int, str | None]], run: int):
        self.run, self.ids, self.case, seqs = run, {}, [], []
        hashes, owner, place = [], [], []
        for case, text in rows:
            seq = np.array([self.ids.setdefault(t, len(self.ids)) for t in tokens(text)], np.int64)
            h = rolled(seq, run)
            if len(h):
                hashes.append(h)
                owner.append(np.full(len(h), len(seqs)))
                place.append(np.arange(len(h)))
                seqs.append(seq)
                self.case.append(case)
        self.seqs = seqs
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.owner = (np.concatenate(owner) if owner else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int64))[order]

    def hits(self, text: str | None) -> list[tuple[int, int, int]]:
        """(index of the passage, start in the text, start in the passage) of every equal window."""
        got = [self.ids.get(t, -1) for t in tokens(text)]
        if len(got) < self.run or not len(self.hash):
            return []
        seq = np.array(got, np.int64)
        unknown = np.concatenate([[0], np.cumsum(seq < 0)])
        starts = np.flatnonzero(unknown[self.run :] == unknown[: -self.run])  # windows of known tokens only
        if not len(starts):
            return []
        h = rolled(seq, self.run)[starts]
        low, high = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        out = []
        for i in np.flatnonzero(high > low):
            window = seq[starts[i] : starts[i] + self.run]
            for k in range(low[i], high[i]):
                o, p = int(self.owner[k]), int(self.place[k])
                if np.array_equal(self.seqs[o][p : p + self.run], window):
                    out.append((o, int(starts[i]), p))
        return out


def maximal(hits: list[tuple[int, int, int]], run: int) -> list[tuple[int, int, int, int]]:
    """Joins hits that follow each other on a diagonal: (passage, start in the text, start in the passage, length)."""
    out: list[list[int]] = []
    for o, d, p in sorted(hits, key=lambda x: (x[0], x[1] - x[2], x[1])):
        last = out[-1] if out else None
        if last and last[0] == o and last[1] - last[2] == d - p and d <= last[1] + last[3] - run + 1:
            last[3] = d + run - last[1]
        else:
            out.append([o, d, p, run])
    return [tuple(x) for x in out]


def tile(matches: list[tuple[int, int, int]], run: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: the longest match clear of marked tokens first; what a mark cuts off goes on as a shorter match."""
    import heapq

    heap = [(-n, d, p) for d, p, n in matches if n >= run]
    heapq.heapify(heap)
    text_marks: set[int] = set()
    passage_marks: set[int] = set()
    out = []
    while heap:
        n, d, p = heapq.heappop(heap)
        n = -n
        free = [i for i in range(n) if d + i not in text_marks and p + i not in passage_marks]
        if len(free) == n:
            out.append((d, p, n))
            text_marks.update(range(d, d + n))
            passage_marks.update(range(p, p + n))
            continue
        begin = 0
        for j in range(1, len(free) + 1):  # the clear runs that are left
            if j == len(free) or free[j] != free[j - 1] + 1:
                if j - begin >= run:
                    heapq.heappush(heap, (-(j - begin), d + free[begin], p + free[begin]))
                begin = j
    return out


MATCHES = "doc_id long, case_id long, at_doc int, at_case int, n int"


def _matches_by_lookup(documents: DataFrame, rows: list[tuple[int, str | None]], run: int) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(Passages(rows, run))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for o, d, p, n in maximal(known.hits(text), run):
                    for c, v in zip(cols, (doc, known.case[o], d, p, n)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "case_id", "at_doc", "at_case", "n"])

    return documents.select("doc_id", "text").mapInArrow(scan, MATCHES)


def _windows(df: DataFrame, key: str, text: str, at: str, run: int) -> DataFrame:
    """Each window of a text: (key, at, window), the window as its tokens' 128-bit digest."""
    spaced = F.regexp_replace(F.lower(text), f"([{SINGLE}])", " $1 ")
    listed = df.select(key, F.regexp_extract_all(spaced, F.lit(rf"[\p{{L}}\p{{N}}぀-ヿ]+"), F.lit(0)).alias("__t")).filter(F.size("__t") >= run)
    return listed.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.size("__t") - run), lambda i: F.md5(F.array_join(F.slice("__t", i + 1, run), " ")))).alias(at, "window"))


def _matches_by_join(documents: DataFrame, cases: DataFrame, run: int) -> DataFrame:
    hits = _windows(documents, "doc_id", "text", "d", run).join(_windows(cases, "case_id", "passage", "p", run), "window")
    from pyspark.sql import Window

    diagonal = Window.partitionBy("doc_id", "case_id", F.col("d") - F.col("p")).orderBy("d")
    island = hits.select("doc_id", "case_id", "d", "p", (F.col("d") - F.row_number().over(diagonal)).alias("i"))
    return island.groupBy("doc_id", "case_id", (F.col("d") - F.col("p")).alias("g"), "i").agg(F.min("d").alias("at_doc"), F.min("p").alias("at_case"), (F.count("*") + run - 1).cast("int").alias("n")).select("doc_id", "case_id", "at_doc", "at_case", "n")


def leaked(documents: DataFrame, cases: DataFrame, run: int = RUN, least_coverage: float = 0.0, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """(doc_id, case_id, longest, tiles, covered, coverage) of every pair with a common run of at least `run` tokens."""
    cases = cases.select("case_id", "passage").filter("passage IS NOT NULL AND case_id IS NOT NULL").distinct()
    documents = documents.select("doc_id", "text").filter("text IS NOT NULL AND doc_id IS NOT NULL")
    bound = cases.agg(F.sum(F.length("passage"))).first()[0] or 0  # code points bound the windows
    matches = _matches_by_lookup(documents, [tuple(r) for r in cases.collect()], run) if bound <= most_windows else _matches_by_join(documents, cases, run)
    lists = matches.distinct().groupBy("doc_id", "case_id").agg(F.collect_list(F.struct("at_doc", "at_case", "n")).alias("m"))

    @F.pandas_udf("longest int, tiles int, covered int")
    def tiled(found: pd.Series) -> pd.DataFrame:
        rows = []
        for m in found:
            got = tile([(x["at_doc"], x["at_case"], x["n"]) for x in m], run)
            rows.append((max(n for _, _, n in got), len(got), sum(n for _, _, n in got)))
        return pd.DataFrame(rows, columns=["longest", "tiles", "covered"])

    length = F.regexp_count(F.regexp_replace(F.lower("passage"), f"([{SINGLE}])", " $1 "), F.lit(r"[\p{L}\p{N}぀-ヿ]+"))
    sizes = cases.groupBy("case_id").agg(F.max(length).alias("size"))
    out = lists.select("doc_id", "case_id", tiled("m").alias("t")).select("doc_id", "case_id", "t.*").join(sizes, "case_id")
    return out.select("doc_id", "case_id", "longest", "tiles", "covered", F.round(F.col("covered") / F.col("size"), 6).alias("coverage")).filter(F.col("coverage") >= least_coverage)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items they leak."""
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_cases")).select("doc_id", "case_id")


def p6_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each item's passage each document has."""
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_cases"))


def p6_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of an item's passage in tiles of 8 tokens or more, in whatever order these stand: passages that were cut up and put together anew leak too."""
    got = leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_cases"), run=8, least_coverage=0.5)
    return got.select("doc_id", "case_id", "longest", "tiles", "coverage")


_TOK = "regexp_extract_all(regexp_replace(lower({0}), '([\\x{{3400}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}\\x{{3040}}-\\x{{30ff}}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}\\x{{3040}}-\\x{{30ff}}]+')"
SQL = {
    "p6_found": f"""
WITH d AS (SELECT DISTINCT doc_id, {_TOK.format("text")} AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT DISTINCT case_id, {_TOK.format("passage")} AS t FROM eval_cases WHERE passage IS NOT NULL),
dw AS (SELECT DISTINCT doc_id, array_to_string(t[i:i+15], ' ') AS w FROM (SELECT doc_id, t, unnest(range(1, len(t) - 14)) AS i FROM d WHERE len(t) >= 16)),
cw AS (SELECT DISTINCT case_id, array_to_string(t[i:i+15], ' ') AS w FROM (SELECT case_id, t, unnest(range(1, len(t) - 14)) AS i FROM c WHERE len(t) >= 16))
SELECT DISTINCT doc_id, case_id FROM dw JOIN cw USING (w)""",
}

QUERIES = {"p6_found": p6_found, "p6_coverage": p6_coverage, "p6_reordered": p6_reordered}
