import pytest
from pyspark.sql import functions as F

from foliant.operators import catalog as C
from foliant.operators import evaluation as E
from foliant.operators import sync as S
from foliant.operators.models import Transient, reranked
from foliant.operators.navigation import between, page_range
from foliant.operators.retrieve import Options, retrieve

INDEX = "row_id string, content string, rel string, heading string, v array<float>"
ROWS = [("a", "river delta mud", "coast/one.md", "Coast", [1.0, 0.0]), ("b", "delta wing plane", "air/two.md", "Air", [0.0, 1.0]), ("c", "湖水很深", "lake/三.md", None, [0.6, 0.8]), ("d", None, "x", None, None)]
ASKED = "query_id long, query string, v array<float>"


def test_options_are_checked():
    for bad in ({"mode": "x"}, {"top_k": 0}, {"top_k": 9, "candidates": 5}, {"candidates": 201}, {"alpha": 1.5}, {"mode": "bm25", "rerank": True}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_one_call_answers_each_query_by_its_method(spark):
    index = spark.createDataFrame(ROWS, INDEX)
    asked = spark.createDataFrame([(1, "delta", [1.0, 0.0]), (2, "air delta", None), (3, "湖水", [0.6, 0.8]), (4, "山高", [1.0, 0.0]), (5, None, None)], ASKED)
    got = {}
    for r in retrieve(index, asked, Options(top_k=2, alpha=0.5), 2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["row_id"], r["method"]))
    assert got[1][0] == ("a", "hybrid") and got[2][0] == ("b", "bm25-fallback") and got[3][0] == ("c", "hybrid")
    assert [x for x, _ in got[4]] == ["a", "c"] and 5 not in got
    with pytest.raises(ValueError):
        retrieve(index, asked, Options(mode="vector"), 2)
    nothing = retrieve(index, asked, Options(top_k=2), 2, allowed=index.select("row_id").limit(0))
    assert nothing.count() == 0
    lit = retrieve(index, asked, Options(mode="literal"), 2).collect()
    assert {(r["query_id"], r["row_id"]) for r in lit} == {(1, "a"), (1, "b"), (3, "c")}
    ranked = retrieve(index, asked, Options(top_k=1, candidates=3, rerank=True), 2, lambda q, ts: [float("plane" in t) for t in ts])
    assert {(r["query_id"], r["row_id"], r["method"]) for r in ranked.collect()} >= {(1, "b", "rerank"), (2, "b", "bm25-fallback")}


def test_reranking_calls_once_a_query_and_falls_back(spark):
    rows = [(1, "q", f"r{i}", f"text {i}", i) for i in range(1, 6)] + [(2, "down", "x", "t", 1), (2, "down", "y", "u", 2)]
    df = spark.createDataFrame(rows, "query_id long, query string, row_id string, text string, rank int")

    def score(query, texts):
        if query == "down":
            raise Transient()
        assert len(texts) == 4
        return [float(t[-1]) for t in texts]

    got = {(r["query_id"], r["rank"]): (r["row_id"], r["rerank"]) for r in reranked(df, score, 2, most=4).collect()}
    assert got == {(1, 1): ("r4", 4.0), (1, 2): ("r3", 3.0), (2, 1): ("x", None), (2, 2): ("y", None)}


def test_links_and_keys(spark):
    schema = "document string, item_key string, how string, locked boolean"
    old = spark.createDataFrame([("d1", "i1", "manual", True), ("d2", "i2", "doi", False), ("d3", "i3", "doi", None)], schema)
    new = spark.createDataFrame([("d1", "i9", "doi", False), ("d2", "i8", "doi", False), ("d4", "i4", "doi", None)], schema)
    assert {(r["document"], r["item_key"]) for r in C.relinked(old, new).collect()} == {("d1", "i1"), ("d2", "i8"), ("d3", "i3"), ("d4", "i4")}
    items = spark.createDataFrame([("i1", None, "t"), ("i2", "10.1/x", "u"), ("i5", None, "w")], "item_key string, doi string, title string")
    files = spark.createDataFrame([("d1", "", "", "10.1/x"), ("d2", "", "", "10.1/x"), ("d3", "", "", None)], "document string, place string, name string, doi string")
    places = spark.createDataFrame([], "item_key string, place string")
    own = spark.createDataFrame([("d2", "i5"), ("d3", "gone")], "document string, item_key string")
    assert {(r["document"], r["item_key"], r["how"]) for r in C.matched(files, items, places, own, old).collect()} == {("d1", "i1", "manual"), ("d2", "i5", "reference")}
    one = lambda df, c: df.select(c).first()[0]
    p = spark.createDataFrame([("/l/paper.pdf-0a1b2c3d-0000-1111-2222-0123456789ab/auto/x.json", "AB" * 16)], "p string, h string")
    assert one(p, C.converted_from(F.col("p"))) == "paper.pdf" and one(p, C.converted_from(F.lit("/l/x"))) is None
    assert one(p, S.source_key(F.col("h"), F.col("p"))) == "md5:" + "ab" * 16 and one(p, S.source_key(F.lit("?"), F.col("p"))).startswith("content:sha256:")
    assert [one(p, page_range(F.lit(t))) and tuple(one(p, page_range(F.lit(t)))) for t in ("8", "8-9", "9-8", "x", "0")] == [(8, 8), (8, 9), None, None, None]


def test_snapshots(spark):
    a = spark.createDataFrame([("p1", "1"), ("p2", "2")], "path string, hash string")
    sign = lambda df: tuple(S.signature(df, "path", "hash").first())
    assert sign(a) == sign(a.orderBy("path", ascending=False)) != sign(a.withColumn("hash", F.lit("1"))) and sign(a.limit(0))[0] == 0
    none = spark.createDataFrame([], "path string, error string")
    assert S.reconciled(a, a.limit(1), none).count() == 1 and S.reconciled(a, a.limit(1), none.unionByName(spark.createDataFrame([("x", "e")], none.schema))).count() == 2
    index, new = spark.createDataFrame([("/l/a/content_list.json",), ("/l/b/x.md",)], "path string"), spark.createDataFrame([("/l/a/y.mineru.json",)], "path string")
    assert [r["path"] for r in S.obsolete(index, new).collect()] == ["/l/a/content_list.json"]
    assert S.compatibility(model="m", dim=3) == S.compatibility(dim=3, model="m") != S.compatibility(dim=4, model="m")


def test_labels_and_reports(spark):
    hits = spark.createDataFrame([(1, 1, "/l/a/x.md", "has Needle", "S"), (1, 2, "/l/b/x.md", "needle", None)], "query_id long, rank int, path string, content string, section string")
    labels = spark.createDataFrame([(1, 0, "x.md", "needle", None), (1, 0, None, "Needle", "T"), (1, 1, "a/x.md", None, "S"), (1, 2, "ax.md", None, None), (2, 0, None, "z", None)], "query_id long, label_no int, pathSuffix string, contains string, section string")
    met = E.label_hits(hits, labels)
    assert {tuple(r) for r in met.collect()} == {(1, 0, 2), (1, 1, 1)}
    assert {tuple(r) for r in E.recall_of_labels(labels, met, 1).collect()} == {(1, 3, 1, 0.333333, 1.0), (2, 1, 0, 0.0, 0.0)}
    b, a = (spark.createDataFrame([("m", "q", v, 1.0)], "mode string, id string, recall double, rr double") for v in (0.5, 0.75))
    assert [tuple(r) for r in E.changes(b, a, ["mode", "id"], ["recall", "rr"]).collect()] == [("m", "q", "recall", 0.5, 0.75)]


def test_ranges(spark):
    p = spark.createDataFrame([("d", i, None, i, i, 1) for i in range(6)], "doc string, idx int, section string, page_start int, page_end int, tokens int")
    assert [r["idx"] for r in between(p, 2, 3).orderBy("idx").collect()] == [2, 3] and between(p, pages_of=(1, 2)).count() == 2 and between(p, 4).count() == 2
    for bad in ({"first": 1, "pages_of": (1, 2)}, {"first": 3, "last": 2}, {"pages_of": (3, 2)}):
        with pytest.raises(ValueError):
            between(p, **bad)
