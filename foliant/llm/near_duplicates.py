"""Near-duplicate records with small edits, by pigeonring filtering.

A text's set of `q` code point substrings has a signature of 96 positions (minima of hashed substrings over bins, two
hash functions of 48 bins) and a sketch of two bits a position. Two texts whose sets have similarity s (intersection
over union) agree at a position with probability s, so their sketches differ at about 72 (1 - s) of 96 positions. The
positions form a ring of 24 segments of four.

1. Seeds: pairs that agree on all of at least one segment. A pair of similarity 0.6 has such a segment with
   probability 1 - (1 - 0.6^4)^24 = 0.964, one of 0.7 with 0.998; the measured recall stands in the README.
2. Pigeonring: with at most `budget` differing positions over the ring of twelve parts of eight positions, some part
   must start a chain whose first one, two, three, four parts stay within as many twelfths of the budget.
3. The full Hamming check of the two sketches.
4. The exact check of the two sets, which alone decides.

Exact copies collapse: a task passes on the segments of a text once, and what still repeats meets itself and is
dropped, so a third of all rows being one text costs nothing; copies come back as class members. The segment rows are
shuffled and sorted once, by the segment's hash; runs of one hash are paired in array operations. A run of more than
`HOT` rows is not paired there: its rows go to a join by block pairs (block of one side, block of the other), so its
members spread over many tasks while every pair still meets exactly once.

Defined results: null texts and texts under `least` code points (after lower-casing and squeezing blanks) have no
pair; repeated rows count once; ids that are null are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.tables import small, staged, table

Q, LEAST, SIMILARITY = 5, 100, 0.6
POSITIONS, SEGMENT, BINS = 96, 4, 48
BUDGET = 44  # differing positions of 96; similarity 0.6 expects 28.8 with a deviation of 4.5
PARTS, CHAIN = 12, 4  # of the ring
HOT, BLOCK = 4096, 2048  # a segment hash shared by more rows than HOT is split into blocks of about BLOCK
MOST_SENT = 32 << 20  # most bytes of seeds whose texts' keys are broadcast; beyond, a shuffled join
MEMBERS = 4096  # a class of equal texts is listed by blocks of about so many records


def normal_text(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[ \t\r\n]{2,}|[\t\r\n]", " "), F.lit(" "))  # single blanks stay as they are


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(texts: list[str], q: int = Q) -> np.ndarray:
    """A row of POSITIONS 32-bit minima for each text of at least q code points; whole batches at once."""
    cps = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.array([len(c) for c in cps])
    cp = np.concatenate(cps).astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), size)
    n = len(cp) - q + 1
    with np.errstate(over="ignore"):
        gram = np.zeros(n, np.uint64)
        for j in range(q):
            gram = gram * np.uint64(0x100000001B3) + cp[j : j + n]
        keep = doc[:n] == doc[q - 1 :]
        gram, doc = gram[keep], doc[:n][keep]
        out = np.full((len(texts), POSITIONS), np.iinfo(np.uint32).max, np.uint32)
        for f in range(POSITIONS // BINS):
            h = _mixed(gram + np.uint64((0x9E3779B97F4A7C15 * (f + 1)) % 2**64))
            slot = doc * POSITIONS + f * BINS + (h % np.uint64(BINS)).astype(np.int64)
            np.minimum.at(out.reshape(-1), slot, (h >> np.uint64(32)).astype(np.uint32))
    for f in range(POSITIONS // BINS):  # an empty bin takes the value of the next full one, mixed with the distance
        part = out[:, f * BINS : (f + 1) * BINS]
        empty = part == np.iinfo(np.uint32).max
        if empty.any():
            ahead = np.where(empty, 2 * BINS, np.arange(BINS))
            twice = np.concatenate([ahead, ahead + BINS], axis=1)
            following = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :BINS]
            distance = following - np.arange(BINS)
            filled = np.take_along_axis(part, following % BINS, 1) + (distance * 0x9E3779B1 % 2**32).astype(np.uint32)
            part[:] = np.where(empty, filled, part)
    return out


def _sketches(df: DataFrame, q: int) -> DataFrame:
    """(id, h, w, segs): digest of the text, and, where a task meets the text first, its sketch in three longs and a hash for each segment."""
    schema = "id string, h binary, w0 long, w1 long, w2 long, segs array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                digests = part.column(1).to_pylist()
                first = np.zeros(len(digests), bool)
                for i, h in enumerate(digests):
                    if h not in met:
                        met.add(h)
                        first[i] = True
                new = part.filter(pa.array(first))
                words = np.zeros((0, 3), np.int64)
                segs = np.zeros((0, POSITIONS // SEGMENT), np.uint64)
                if new.num_rows:
                    sig = signatures(new.column(2).to_pylist(), q)
                    words = sketch(sig)
                    with np.errstate(over="ignore"):
                        segs = np.zeros((len(sig), POSITIONS // SEGMENT), np.uint64)
                        for j in range(SEGMENT):
                            segs = _mixed(segs * np.uint64(31) + sig[:, j::SEGMENT].astype(np.uint64) + np.uint64(1))
                        segs = _mixed(segs + np.arange(segs.shape[1], dtype=np.uint64))
                offsets = np.concatenate([[0], np.cumsum(first)]) * segs.shape[1]
                at = np.maximum(np.cumsum(first) - 1, 0)
                spread = [pa.array(words[at, i] if len(words) else np.zeros(len(at), np.int64), mask=~first) for i in range(3)]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(segs.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *spread, lists], ["id", "h", "w0", "w1", "w2", "segs"])

    return df.mapInArrow(run, schema)


def sketch(sig: np.ndarray) -> np.ndarray:
    """Two bits a position: both bits of 64 positions in a long each, those of the other 32 in the halves of a third."""
    one, two = ((sig >> np.uint32(7)) & np.uint32(1)).astype(np.uint8), ((sig >> np.uint32(19)) & np.uint32(1)).astype(np.uint8)
    pack = lambda bits: np.packbits(bits, axis=1, bitorder="little")
    raw = np.concatenate([pack(one[:, :64]), pack(two[:, :64]), pack(one[:, 64:]), pack(two[:, 64:])], 1)
    return np.ascontiguousarray(raw).view("<i8")


def near(x: np.ndarray, y: np.ndarray, budget: int) -> np.ndarray:
    """Which rows of two arrays of sketches pass the ring and the full check."""
    d = x ^ y
    one, two = d[:, 0] | d[:, 1], d[:, 2] | (d[:, 2] >> 32)
    parts = np.concatenate([np.ascontiguousarray(one).view(np.uint8).reshape(-1, 8), np.ascontiguousarray(two).view(np.uint8).reshape(-1, 8)[:, :4]], 1)
    differ = np.bitwise_count(parts).astype(np.int16)
    chain, viable = np.zeros_like(differ), np.ones(differ.shape, bool)
    for length in range(1, CHAIN + 1):
        chain = chain + np.roll(differ, 1 - length, axis=1)
        viable &= chain <= budget * length // PARTS
    out = viable.any(1)
    out[out] = differ[out].sum(1) <= budget
    return out


def _paired(rows: DataFrame, budget: int) -> DataFrame:
    """Pairs (a, b) of the rows of one segment hash; the rows of hot ones as they are, with their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, hot = np.zeros((0, 5), np.int64), None

        def given(a: np.ndarray, b: np.ndarray, seg: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
            is_hot = len(seg) > 0
            cols = [pa.array(a), pa.array(a if is_hot else b)] + [pa.array(c) if is_hot else pa.nulls(len(a), pa.int64()) for c in (seg, *words.T)]
            return pa.RecordBatch.from_arrays(cols, ["a", "b", "seg", "w0", "w1", "w2"])

        def pairs_of(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            start = np.flatnonzero(np.concatenate([[True], x[1:, 0] != x[:-1, 0]]))
            size = np.diff(np.concatenate([start, [len(x)]]))
            big = np.repeat(size > HOT, size)
            if big.any():
                yield given(x[big, 1], x[big, 1], x[big, 0], x[big, 2:])
            several = np.repeat(size > 1, size) & ~big
            x = x[several]
            step = 1
            while step < len(x):
                at = np.flatnonzero(x[step:, 0] == x[:-step, 0])
                if not len(at):
                    break
                at = at[x[at, 1] != x[at + step, 1]]
                at = at[near(x[at, 2:], x[at + step, 2:], budget)]
                if len(at):
                    yield given(np.minimum(x[at, 1], x[at + step, 1]), np.maximum(x[at, 1], x[at + step, 1]), x[:0, 0], x[:0, 2:])
                step += 1

        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            if hot is not None:
                more = int(np.searchsorted(x[:, 0] != hot, True))
                if more:
                    yield given(x[:more, 1], x[:more, 1], x[:more, 0], x[:more, 2:])
                x = x[more:]
                hot = hot if not len(x) else None
            x = np.concatenate([rest, x])
            if not len(x):
                continue
            last = int(np.flatnonzero(np.concatenate([[True], x[1:, 0] != x[:-1, 0]]))[-1])
            if last:
                yield from pairs_of(x[:last])
            rest = x[last:]
            if len(rest) > HOT:
                hot = rest[0, 0]
                yield given(rest[:, 1], rest[:, 1], rest[:, 0], rest[:, 2:])
                rest = rest[:0]
        if len(rest):
            yield from pairs_of(rest)

    return rows.mapInArrow(run, "a long, b long, seg long, w0 long, w1 long, w2 long")


def _hot_pairs(hot: DataFrame, budget: int) -> DataFrame:
    """Pairs of the members of hot segments, by block pairs."""
    hot = hot.select(F.col("a").alias("h"), "seg", "w0", "w1", "w2").dropDuplicates(["seg", "h"])
    blocks = hot.groupBy("seg").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    split = hot.join(blocks, "seg").withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    # A member of block i stands on the left for pairs (i, j >= i) and on the right for pairs (j <= i, i).
    words = ["w0", "w1", "w2"]
    left = split.select("h", "seg", F.array(*words).alias("w"), F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = split.select(F.col("h").alias("g"), "seg", F.array(*words).alias("v"), F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"))
    met = left.join(right, ["seg", "i", "j"]).filter(((F.col("i") != F.col("j")) & (F.col("h") != F.col("g"))) | (F.col("h") < F.col("g")))

    @F.pandas_udf("boolean")
    def close(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(near(np.stack(x.values).astype(np.int64), np.stack(y.values).astype(np.int64), budget) if len(x) else np.zeros(0, bool))

    return met.filter(close("w", "v")).select(F.least("h", "g").alias("a"), F.greatest("h", "g").alias("b"))


def _seeds(sketched: DataFrame, budget: int) -> DataFrame:
    """Distinct pairs (a, b) of texts, by the 64-bit hash of their digests, that share a segment and pass the checks."""
    rows = sketched.select(F.explode("segs").alias("seg"), F.xxhash64("h").alias("h"), "w0", "w1", "w2")
    paired = staged(_paired(rows.repartition("seg").sortWithinPartitions("seg"), budget), "near-duplicate-pairs")
    return paired.filter("seg IS NULL").select("a", "b").unionByName(_hot_pairs(paired.filter("seg IS NOT NULL"), budget)).distinct()


def near_duplicates(df: DataFrame, key: str, text: str, q: int = Q, least: int = LEAST, similarity: float = SIMILARITY, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(classes, links): class id `h` of each record's text, and the pairs of classes at least `similarity` alike."""
    normal = df.select(F.col(key).cast("string").alias("id"), normal_text(F.col(text)).alias("t")).filter(F.col("id").isNotNull() & (F.length("t") >= max(least, q)))
    normal = normal.select("id", F.unhex(F.md5("t")).alias("h"), "t")
    sketched = staged(_sketches(normal, q), "near-duplicates")
    classes = sketched.select("id", "h").distinct()
    seeds = staged(_seeds(sketched, budget), "near-duplicate-seeds")
    wanted = seeds.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    wanted = F.broadcast(wanted) if small(seeds, MOST_SENT) else wanted
    full = normal.withColumn("k", F.xxhash64("h")).join(wanted, "k", "left_semi").groupBy("h").agg(F.first("k").alias("k"), F.first("t").alias("t"))
    a, b = full.select(F.col("k").alias("a"), F.col("h").alias("ha"), F.col("t").alias("ta")), full.select(F.col("k").alias("b"), F.col("h").alias("hb"), F.col("t").alias("tb"))
    links = seeds.join(a, "a").join(b, "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"), _alike(q)("ta", "tb").alias("similarity")).filter(F.col("similarity") >= similarity)
    return classes, links


def _alike(q: int):
    """A column function: intersection over union of the sets of substrings of q code points of two texts. A text's set is
    made once a batch, as sorted 64-bit hashes; two different substrings of a pair of texts share one but once in some
    10^13 pairs."""

    def grams(text: str) -> np.ndarray:
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        gram = np.zeros(len(cp) - q + 1, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(q):
                gram = _mixed(gram * np.uint64(0x100000001B3) + cp[j : j + len(gram)] + np.uint64(1))
        return np.unique(gram)

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        made: dict[str, np.ndarray] = {}
        out = []
        for s, t in zip(x, y):
            for text in (s, t):
                if text not in made:
                    made[text] = grams(text)
            m, n = made[s], made[t]
            both = int((n[np.minimum(np.searchsorted(n, m), len(n) - 1)] == m).sum())
            out.append(both / (len(m) + len(n) - both))
        return pd.Series(out)

    return run


def pairs(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair of records: of linked classes, and within a class. The members of a class are numbered in blocks of
    MEMBERS, and pairs are made by pairs of blocks, so a text that has a third of all records spreads over many tasks."""
    counted = classes.groupBy("h").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
    several = staged(counted.filter("blocks > 1"), "large-classes")  # at most one for MEMBERS records
    large = F.broadcast(several) if small(several, MOST_SENT) else several
    members = classes.join(large, "h", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    a, b = members.select(F.col("h").alias("a"), F.col("id").alias("x"), F.col("block").alias("i")), members.select(F.col("h").alias("b"), F.col("id").alias("y"), F.col("block").alias("j"))
    of = large.select("h", "blocks")
    met = links.select("a", "b").unionByName(classes.groupBy(F.col("h").alias("a")).agg(F.count("*").alias("n")).filter("n > 1").select("a", F.col("a").alias("b")))
    for side, no in (("a", "i"), ("b", "j")):
        met = met.join(of.select(F.col("h").alias(side), F.col("blocks").alias(no)), side, "left").withColumn(no, F.explode(F.sequence(F.lit(0), F.coalesce(no, F.lit(1)) - 1)))
    out = met.filter((F.col("a") != F.col("b")) | (F.col("i") <= F.col("j"))).join(a, ["a", "i"]).join(b, ["b", "j"])
    out = out.filter((F.col("a") != F.col("b")) | (F.col("i") != F.col("j")) | (F.col("x") < F.col("y")))
    return out.select(F.least("x", "y").alias("chunk_a"), F.greatest("x", "y").alias("chunk_b"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of near-duplicate chunks."""
    return pairs(*near_duplicates(table(spark, sf_dir, "chunks"), "id", "chunk_content"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a chunk: its class of equal texts, and the number of classes linked to that class."""
    classes, links = near_duplicates(table(spark, sf_dir, "chunks"), "id", "chunk_content")
    degree = links.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count("*").alias("links"))
    return classes.join(degree, "h", "left").select(F.col("id").alias("chunk_id"), F.lower(F.hex("h")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p5_found": p5_found, "p5_classes": p5_classes}
SQL: dict[str, str] = {}
