"""Splitting oversized items at natural boundaries.

An item whose token estimate exceeds `limit` is cut into pieces of at most `limit` tokens. Prefix sums of quarter
tokens over the code points and the sorted array of boundaries are built once for an item; each cut is then two
binary searches: the furthest end that fits, and the last boundary at or before it. Without a boundary there, the
piece is cut hard. The next piece steps back by at most `overlap` tokens, to a boundary or a blank where one is in
reach, and less where the overlap would keep the next stretch from fitting.

Work is one narrow pass: the JVM drops items within the limit, so only oversized texts travel to Python, in Arrow
batches. No shuffle.

Defined results: null and empty texts have no piece; an item within the limit is one piece, `whole`; repeated rows
give repeated pieces (the callers drop them); the other columns of the input stay, but for those that bear an output's
name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import token_estimate

LIMIT, OVERLAP = 420, 30

# Ranges of the code points that count as one token each.
WIDE_RANGES = ((0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x3040, 0x30FF), (0xAC00, 0xD7AF))
# Marks that end a stretch anywhere, and marks that end one before white space.
HARD_MARKS, SOFT_MARKS = "。！？", ".!?"

PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("piece_no", T.IntegerType(), False),
            T.StructField("from_char", T.LongType(), False),
            T.StructField("to_char", T.LongType(), False),
            T.StructField("tokens", T.IntegerType(), False),
            T.StructField("cut", T.StringType(), False),
            T.StructField("piece", T.StringType(), False),
        ]
    )
)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def boundaries(text: str, cp: np.ndarray) -> np.ndarray:
    """Sorted offsets at which the text may be cut: around each line end and after each end mark."""
    line = np.flatnonzero(cp == 10)
    hard = np.flatnonzero(np.isin(cp, code_points(HARD_MARKS)))
    soft = np.flatnonzero(np.isin(cp[:-1], code_points(SOFT_MARKS))) if len(cp) else line
    if len(soft):
        soft = soft[[text[i + 1].isspace() for i in soft]]
    return np.unique(np.concatenate([line, line + 1, hard + 1, soft + 1, [len(cp)]]))


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, bool]]:
    """(start, end, forced) of each piece; together the pieces cover the text."""
    cp = code_points(text)
    wide = np.zeros(len(cp), bool)
    for low, high in WIDE_RANGES:
        wide |= (cp >= low) & (cp <= high)
    total = np.concatenate([[0], np.cumsum(np.where(wide, 4, 1))])  # in quarters of a token
    at, room, n = boundaries(text, cp), 4 * limit, len(cp)
    blank = np.array([i + 1 for i, c in enumerate(text) if c.isspace()], dtype=np.int64)
    out, start, done = [], 0, 0
    while done < n:
        following = at[np.searchsorted(at, done, "right")]  # the next boundary after what is done
        start = min(done, max(start, int(np.searchsorted(total, total[following] - room, "left"))))
        furthest = int(np.searchsorted(total, total[start] + room, "right")) - 1
        end = int(at[np.searchsorted(at, furthest, "right") - 1]) if at[0] <= furthest else 0
        forced = end <= done
        if forced:  # the stretch after `done` is too long by itself
            end = furthest if furthest > done else int(np.searchsorted(total, total[done] + room, "right")) - 1
            start = start if furthest > done else done
        out.append((start, end, forced))
        back = int(np.searchsorted(total, total[end] - 4 * overlap, "left"))
        for places in (at, blank):  # begin the overlap at a boundary, else at a blank
            k = int(np.searchsorted(places, back, "left"))
            if k < len(places) and places[k] < end:
                back = int(places[k])
                break
        done, start = end, max(back, start + 1)
    return out


def split_oversized(df: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, keep_whole: bool = False) -> DataFrame:
    """The columns of `df` without `text`, and piece_no, from_char, to_char, tokens, cut (natural, forced, whole), piece."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")

    @F.pandas_udf(PIECES)
    def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            rows = []
            for t in batch:
                rows.append(
                    [
                        {"piece_no": i, "from_char": a, "to_char": b, "tokens": quarter_tokens(t[a:b]), "cut": "forced" if forced else "natural", "piece": t[a:b]}
                        for i, (a, b, forced) in enumerate(cut_points(t, limit, overlap))
                    ]
                )
            yield pd.Series(rows)

    rest = [c for c in df.columns if c not in (text, *[f.name for f in PIECES.elementType.fields])]
    size = token_estimate(F.col(text))
    over = df.filter((F.length(text) > limit) & (size > limit))  # the cheap test first: no text of `limit` code points is over
    cut = over.withColumn("__p", F.explode(pieces(F.col(text)))).select(*rest, "__p.*")
    if not keep_whole:
        return cut
    whole = df.filter((F.length(text) > 0) & ((F.length(text) <= limit) | (size <= limit)))
    return cut.unionByName(
        whole.select(*rest, F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("from_char"), F.length(text).cast("long").alias("to_char"), size.alias("tokens"), F.lit("whole").alias("cut"), F.col(text).alias("piece"))
    )


def quarter_tokens(text: str) -> int:
    wide = sum(1 for c in text if any(low <= ord(c) <= high for low, high in WIDE_RANGES))
    return max(1, wide + (len(text) - wide + 3) // 4)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items over the limit; forced if any of their pieces had to be cut within a stretch."""
    from foliant.llm.items import text_items

    pieces = split_oversized(text_items(spark, sf_dir))
    return pieces.groupBy("origin", "item_id").agg(F.min("cut").alias("cut"))  # forced < natural


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every item, whole ones included, each once."""
    from foliant.llm.items import text_items

    return split_oversized(text_items(spark, sf_dir), keep_whole=True).dropDuplicates(["origin", "item_id", "piece_no"]).select("origin", "item_id", "piece_no", "from_char", "to_char", "tokens", "cut", "piece")


_EST = "greatest(1, length(regexp_replace({0}, '[^\\x{{3400}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}\\x{{3040}}-\\x{{30FF}}\\x{{AC00}}-\\x{{D7AF}}]', '', 'g')) + (length(regexp_replace({0}, '[\\x{{3400}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}\\x{{3040}}-\\x{{30FF}}\\x{{AC00}}-\\x{{D7AF}}]', '', 'g')) + 3) // 4)"

SQL = {
    "p4_found": f"""
WITH items AS (
  SELECT DISTINCT 'block' AS origin, block_id AS item_id, text FROM blocks
  UNION ALL SELECT DISTINCT 'chunk', id, chunk_content FROM chunks),
big AS (SELECT * FROM items WHERE length(text) > 420 AND {_EST.format("text")} > 420),
stretches AS (
  SELECT origin, item_id, unnest(string_split(regexp_replace(regexp_replace(text, '([。！？])', '\\1' || chr(10), 'g'),
    '([.!?])(\\s)', '\\1' || chr(10) || '\\2', 'g'), chr(10))) AS stretch FROM big)
SELECT origin, item_id, CASE WHEN max({_EST.format("stretch")}) > 420 THEN 'forced' ELSE 'natural' END AS cut
FROM stretches GROUP BY origin, item_id""",
}

QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces}
