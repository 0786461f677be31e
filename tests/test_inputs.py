"""Manifests, files that belong together, stamps, and evaluation of every mode."""

import json

import pytest

from foliant.operators import inputs as I
from foliant.operators.retrieve import by_mode
from pyspark.sql import functions as F

FILES = "path string, size long, modified double, content binary"


def listing(spark, **files):
    return spark.createDataFrame([(p, len(c), m, c) for p, (c, m) in files.items()] or [], FILES)


@pytest.mark.parametrize(
    "text, error",
    [
        ('{"version":1,"contentPath":"./sub/../a.md"}', None),
        ('{"version":1,"contentPath":"a.md","pagesFrom":"p.json","title":"T"}', None),
        ('{"version":2,"contentPath":"a.md"}', "unknown version"),
        ('{"version":1,"contentPath":"a.md","colour":1}', "unknown field"),
        ('{"version":1,"contentPath":"/d/a.md"}', "no path within the folder"),
        ('{"version":1,"contentPath":"../e/b.md"}', "no path within the folder"),
        ('{"version":1,"contentPath":""}', "no path within the folder"),
        ('{"version":1,"contentPath":"a.md","pagesFrom":"../p.json"}', "no path within the folder"),
        ('{"version":1,"contentPath":"rag-source.json"}', "names a manifest"),
        ('{"version":1,"contentPath":"missing.md"}', "no such file"),
        ("{", "malformed"),
        ("", "malformed"),
    ],
)
def test_manifests(spark, text, error):
    files = listing(spark, **{"/d/rag-source.json": (text.encode(), 1.0), "/d/a.md": (b"a", 1.0), "/d/p.json": (b"[]", 1.0), "/e/b.md": (b"b", 1.0)})
    (row,) = I.manifests(files).collect()
    assert row["error"] == error and (error or row["content"] == "/d/a.md")


def test_input_sets_and_stamps(spark):
    manifest = json.dumps({"version": 1, "contentPath": "a.md", "pagesFrom": "p.json"}).encode()
    files = {"/d/rag-source.json": (manifest, 1.0), "/d/a.md": (b"a", 2.0), "/d/p.json": (b"[]", 1.0), "/e/content_list.json": (b"[]", 5.0), "/e/x_middle.json": (b"{}", 1.0), "/e/layout.json": (b"{}", 9.0), "/f/x_content_list.json": (b"[]", 1.0)}
    got = {}
    for r in I.input_files(listing(spark, **files)).orderBy("path", "place").collect():
        got.setdefault(r["path"], []).append(r["input"])
    assert got["/d/rag-source.json"] == ["/d/rag-source.json", "/d/a.md", "/d/p.json"]
    assert got["/e/content_list.json"] == ["/e/content_list.json", "/e/layout.json"]
    assert got["/f/x_content_list.json"] == ["/f/x_content_list.json"] and got["/d/a.md"] == ["/d/a.md"]
    before = I.input_marks(listing(spark, **files))
    cached = I.worth_keeping(before, 8.0).cache()
    assert cached.filter("path LIKE '/e/content%'").count() == 0  # its layout changed at 9
    after = I.input_marks(listing(spark, **{**files, "/d/a.md": (b"b", 2.5)}))
    to_hash = {r["path"] for r in I.remembered(after.drop("hash"), cached).filter("hash IS NULL").collect()}
    assert to_hash == {"/d/a.md", "/d/rag-source.json", "/e/content_list.json", "/e/layout.json", "/e/x_middle.json"}
    marks = [{r["path"]: r["hash"] for r in x.collect()} for x in (before, after)]
    assert {p for p in marks[0] if marks[0][p] != marks[1][p]} == {"/d/a.md", "/d/rag-source.json"}
    assert I.input_files(listing(spark)).count() == 0


def test_json_hash(spark):
    texts = ['{"a":1,"tags":["x","y"],"version":3}', '{"tags":["y","x"],"version":9,"a":1}', '{"a":2,"tags":["x","y"]}', "[1]", "{", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    h = [r["h"] for r in df.select("i", I.json_hash(F.col("t"), ("version",), ("tags",)).alias("h")).orderBy("i").collect()]
    assert h[0] == h[1] and h[0] != h[2] and h[3:] == [None, None, None]


def test_stale(spark):
    asked = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("gone", "1"), ("null", "1")], "document_id string, version string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "9"), ("null", None)], "document_id string, version string")
    assert sorted((r["document_id"], r["now"]) for r in I.stale(asked, now).collect()) == [("b", "2"), ("gone", None), ("null", None)]


def test_every_mode(spark):
    words = ["anchor", "beacon", "channel", "dredger"]
    index = spark.createDataFrame([(i, f"The {w} of the port", f"{w}.md", "", [1.0 if i == j else 0.0 for j in range(4)]) for i, w in enumerate(words)], "row_id long, content string, rel string, heading string, v array<float>")
    queries = spark.createDataFrame([(0, "anchor", [0.0, 1.0, 0.0, 0.0]), (1, "beacon", None), (2, "channel", [0.0, 0.0, 1.0, 0.0])], "query_id long, query string, v array<float>")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "query_id long, row_id long")
    exact = lambda q, texts: [1.0 if q in t else 0.0 for t in texts]
    got = {r["mode"]: r for r in by_mode(index, queries, labels, 4, 1, exact).collect()}
    assert {m: (r["cases"], round(r["recall"], 3)) for m, r in got.items() if m != "hybrid"} == {"bm25": (3, 1.0), "literal": (3, 1.0), "vector": (3, 0.333), "rerank": (3, 1.0)}
    assert got["rerank"]["candidate_recall"] == 1.0 and got["bm25"]["candidate_recall"] is None


def test_report(spark, tmp_path):
    from foliant.operators.evaluation import written

    report = spark.createDataFrame([("bm25", 0.5, None)], "mode string, recall double, candidate_recall double")
    written(report, str(tmp_path / "report"))
    assert [r.asDict() for r in spark.read.json(str(tmp_path / "report")).collect()] == [{"candidate_recall": None, "mode": "bm25", "recall": 0.5}]
    with pytest.raises(Exception, match="exist"):
        written(report, str(tmp_path / "report"))
