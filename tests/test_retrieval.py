import math
import random

import numpy as np
from pyspark.sql import functions as F

from foliant.operators.fusion import fused
from foliant.operators.lexical import bm25, documents_of
from foliant.operators.literal import containing
from foliant.operators.vectors import knn

DOCS = [("a", "beta gamma delta", "p/one"), ("b", "gamma beta", None), ("c", None, None), ("d", "beta-gamma beta gamma", "x"), ("e", "epsilon", "y"), ("f", "zeta", "z")]


def docs(spark):
    return documents_of(spark.createDataFrame(DOCS, "id string, body string, path string"), "id", ["body", "path"])


def asked(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, query string")


def test_scores_match_formula(spark):
    got = {r["row_id"]: r["score"] for r in bm25(docs(spark), asked(spark, "epsilon"), 5).collect()}
    avg = sum([5, 2, 0, 5, 2, 2]) / 6
    assert got == {"e": round(math.log((6 - 1 + 0.5) / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / avg)), 6)}


def test_punctuated_terms_are_phrases(spark):
    assert [r["row_id"] for r in bm25(docs(spark), asked(spark, "beta-gamma"), 5).orderBy("rank").collect()] == ["d", "a"]


def test_queries_without_tokens_and_nulls_match_nothing(spark):
    assert bm25(docs(spark), asked(spark, None, "", " -- "), 5).count() == 0
    assert bm25(docs(spark).limit(0), asked(spark, "beta"), 5).count() == 0


def test_filter_cuts_before_the_top(spark):
    allowed = spark.createDataFrame([("b",)], "row_id string")
    assert [r["row_id"] for r in bm25(docs(spark), asked(spark, "beta"), 1, allowed).collect()] == ["b"]
    assert bm25(docs(spark), asked(spark, "beta"), 1, allowed.limit(0)).count() == 0


def test_knn_is_exact_and_skips_unusable(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(60)] + [(100, None), (101, [0.0] * 8), (102, [float("nan")] * 8), (103, [1.0])]
    df = spark.createDataFrame(rows, "row_id long, v array<float>")
    got = knn(df, df.filter("row_id % 20 = 0").withColumnRenamed("row_id", "query_id"), 5, 8).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 20, 40):
        assert [r["row_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == np.argsort(-(u @ u[q]))[:5].tolist()


def test_fusion_orders_at_each_weight(spark):
    lex = spark.createDataFrame([(1, "c", 9.0, 1), (1, "b", 5.0, 2)], "query_id long, row_id string, score double, rank int")
    vec = spark.createDataFrame([(1, "a", 1.0, 1), (1, "b", 0.8, 2), (1, "d", 0.0, 3)], "query_id long, row_id string, cosine double, rank int")
    order = lambda alpha: [r["row_id"] for r in fused(lex, vec, alpha, 9).orderBy("rank").collect()]
    assert order(0.0)[:2] == ["a", "b"]
    assert order(1.0)[0] == "c"
    assert order(0.3)[0] == "a"
    assert [r["hybrid"] for r in fused(lex, vec.limit(0), 0.3, 9).orderBy("rank").collect()] == [1.0, 0.0]


def test_literal_equals_contains_at_every_length(spark, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \n\U0001f600c") for _ in range(n)) for n in (0, 1, 2, 3, 40, 90, 200)] + [None, "x" * 50_000]
    bare = ["".join(c for c in t or "" if c not in " \n\t\r") for t in texts]
    patterns = [t[a : a + n] for t in bare for n in (1, 2, 3, 7, 8, 15, 16, 31, 63, 80) for a in (0, 3, 11) if t[a : a + n]] + ["nowhere", " ", None, "a"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "row_id string, text string")
    asked = spark.createDataFrame(list(enumerate(patterns)), "query_id long, pattern string")
    want = {(q, str(i)) for q, p in enumerate(patterns) if p and p.strip() for i, t in enumerate(bare) if p in t}
    for most in (1 << 20, 0):
        monkeypatch.setattr("foliant.operators.literal.MOST_SENT", most)
        got = [tuple(r) for r in containing(rows, asked).collect()]
        assert set(got) == want and len(got) == len(want)
    assert containing(rows, asked.filter("query_id < 0")).count() == containing(rows.limit(0), asked).count() == 0


def test_blocks_of_queries_answer_alike(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: rng.choice("alpha beta gamma delta-eps the the zeta".split())
    rows = [(f"r{i}", " ".join(word() for _ in range(rng.randint(0, 30))), "p") for i in range(300)]
    d = documents_of(spark.createDataFrame(rows, "id string, body string, path string"), "id", ["body", "path"])
    q = asked(spark, *[" ".join(word() for _ in range(3)) for _ in range(40)])
    one = sorted(map(tuple, bm25(d, q, 7).collect()))
    monkeypatch.setattr("foliant.operators.lexical.MOST_ASKED", 10)
    monkeypatch.setattr("foliant.operators.lexical.CELLS", 100)
    assert one == sorted(map(tuple, bm25(d, q, 7).collect())) and len(one) == 280
    some = q.select("query_id").crossJoin(d.select("row_id").filter("row_id < 'r2'"))
    by_row = sorted(map(tuple, bm25(d, q, 7, some.select("row_id").distinct()).collect()))
    assert by_row == sorted(map(tuple, bm25(d, q, 7, some).collect()))


def test_blocks_of_query_vectors_answer_alike(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(v) for v in rng.integers(-2, 3, 4)]) for i in range(400)], "row_id long, v array<float>")
    q = df.filter("row_id % 7 = 0").withColumnRenamed("row_id", "query_id")
    one = sorted(map(tuple, knn(df, q, 9, 4).collect()))
    monkeypatch.setattr("foliant.operators.vectors.MOST_SENT", 500)
    monkeypatch.setattr("foliant.operators.vectors.SLICE", 30)
    assert one == sorted(map(tuple, knn(df, q, 9, 4).collect()))
    assert knn(df.limit(0), q, 9, 4).count() == knn(df, q.limit(0), 9, 4).count() == 0
