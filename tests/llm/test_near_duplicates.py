import random

import numpy as np

import foliant.llm.near_duplicates as N


def texts(n=120, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    out = []
    for i in range(n):
        words = [word() for _ in range(50)]
        out.append((f"t{i}", " ".join(words)))
        for j in range(3):
            w = list(words)
            for _ in range((j + 1) * 2):
                w[rng.randrange(len(w))] = word()
            out.append((f"t{i}.{j}", " ".join(w)))
    return out


def brute(rows):
    sets = {i: {t[k : k + 5] for k in range(len(t) - 4)} for i, t in rows if t and len(t) >= 100}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}


def test_recall_and_no_false_pair(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "id string, body string")
    got = [tuple(r) for r in N.pairs(*N.near_duplicates(df, "id", "body")).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(set(got)) >= 0.97 * len(want)


def test_copies_case_blanks_nulls_and_repeats(spark):
    a = "The quick brown fox jumps over the lazy dog and runs away from the very angry bear in the dark wood. " * 2
    rows = [("1", a), ("2", a.upper().replace(" ", " \n ")), ("2", a.upper().replace(" ", " \n ")), ("3", None), ("4", "short"), (None, a), ("5", a + " More words here.")]
    df = spark.createDataFrame(rows, "id string, body string")
    classes, links = N.near_duplicates(df, "id", "body")
    assert {tuple(r) for r in N.pairs(classes, links).collect()} == {("1", "2"), ("1", "5"), ("2", "5")}
    assert classes.count() == 3 and links.count() == 1
    assert N.pairs(*N.near_duplicates(df.limit(0), "id", "body")).count() == 0


def test_large_classes_are_listed_by_blocks(spark, monkeypatch):
    classes = spark.createDataFrame([(f"a{i}", bytearray(b"a")) for i in range(40)] + [(f"b{i}", bytearray(b"b")) for i in range(25)] + [("c", bytearray(b"c"))], "id string, h binary")
    links = spark.createDataFrame([(bytearray(b"a"), bytearray(b"b")), (bytearray(b"c"), bytearray(b"b"))], "a binary, b binary")
    monkeypatch.setattr(N, "MEMBERS", 7)
    got = [tuple(r) for r in N.pairs(classes, links).collect()]
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(25)]
    want = {tuple(sorted(p)) for p in [(x, y) for x in a for y in a + b if x != y] + [(x, y) for x in b for y in b + ["c"] if x != y]}
    assert len(got) == len(want) and set(got) == want


def test_a_hot_segment_is_joined_by_blocks(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(1, 2**60, 6000)
    base = rng.integers(0, 2**60, 3)
    rows = [(7, int(x), *map(int, base)) for x in h] + [(9, 1, 1, 1, 1), (9, 2, 1, 1, 1)]
    df = spark.createDataFrame(rows, "seg long, h long, w0 long, w1 long, w2 long")
    paired = N._paired(df.repartition("seg").sortWithinPartitions("seg"), N.BUDGET).collect()
    assert sum(r["seg"] is not None for r in paired) == 6000 and [(r["a"], r["b"]) for r in paired if r["seg"] is None] == [(1, 2)]
    hot = spark.createDataFrame([(int(x), 7, 0, 0, 0) for x in range(1, 5001)], "a long, seg long, w0 long, w1 long, w2 long")
    few = N._hot_pairs(hot.filter("a <= 60"), N.BUDGET)
    assert few.count() == 60 * 59 // 2
    assert N._hot_pairs(hot.filter("a <= 2500"), N.BUDGET).count() == 2500 * 2499 // 2


def test_ring_keeps_all_within_budget_that_have_a_start():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63 - 1, (2000, 3), dtype=np.int64)
    y = x.copy()
    assert N.near(x, y, N.BUDGET).all()
    assert N.near(x, rng.integers(0, 2**63 - 1, (2000, 3), dtype=np.int64), N.BUDGET).mean() < 0.01
