import json

import pytest
from pyspark.sql import functions as F

from foliant.operators import catalog as C
from foliant.operators import evaluation as E
from foliant.operators import sync as S
from foliant.sources.files import eval_cases, folder


def test_snapshot(spark):
    old = spark.createDataFrame([("a", "1", False), ("b", "1", False), ("c", "1", True), ("d", "1", False), ("e", "1", True)], "item_key string, content_hash string, deleted boolean")
    new = spark.createDataFrame([("a", "1", False), ("b", "2", False), ("c", "1", False), ("n", "1", None)], old.schema)
    assert dict(map(tuple, C.apply_snapshot(old, new).collect())) == {"a": "unchanged", "b": "updated", "c": "restored", "d": "deleted", "e": "gone", "n": "inserted"}


def test_links_take_attachments_first_and_refuse_several_works(spark):
    items = spark.createDataFrame([("p", "journalArticle", "", "", "", False), ("x", "attachment", "p", "/s/a.pdf", "a.pdf", False), ("gone", "attachment", "p", "/s/b.pdf", "b.pdf", True)], "item_key string, item_type string, parent_key string, attachment_path string, filename string, deleted boolean")
    places = C.attachments(items)
    files = spark.createDataFrame([("f1", "/s/a.pdf", "a.pdf", None), ("f2", "", "", "10.1/x"), ("f3", "/s/b.pdf", "b.pdf", "10.1/y")], "document string, place string, name string, doi string")
    works = spark.createDataFrame([("p", None, "t"), ("q", "10.1/x", "u"), ("r", "10.1/y", "v"), ("s", "10.1/y", "w")], "item_key string, doi string, title string")
    assert {tuple(r) for r in C.linked(files, works, places).collect()} == {("f1", "p", "attachment"), ("f2", "q", "doi")}


def test_title_candidates_equal_all_pairs(spark):
    words = "alpha beta gamma delta eps zeta eta theta".split()
    titles = [" ".join(words[i:] + words[: i % 3]) for i in range(6)] + ["two words", None, ""]
    d = spark.createDataFrame(list(enumerate(titles)), "document long, title string")
    i = d.withColumnRenamed("document", "item_key")
    want = set()
    for a, s in enumerate(titles):
        for b, t in enumerate(titles):
            x, y = set((s or "").split()), set((t or "").split())
            if len(x) >= 3 and y and len(x & y) / max(len(x), len(y)) >= 0.8:
                want.add((a, b))
    assert {(r[0], r[1]) for r in C.title_candidates(d, i).collect()} == want


def test_sync(spark):
    b = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, mark string")
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", None)], b.schema)
    assert dict(map(tuple, S.difference(b, a).collect())) == {"a": "unchanged", "b": "changed", "c": "removed", "d": "added"}
    index = spark.createDataFrame([("p1", "x"), ("p2", "y"), ("p3", "z")], "path string, document_id string")
    new = spark.createDataFrame([("q1", "x"), ("p2", "y2")], index.schema)
    gone = spark.createDataFrame([("p3",)], "path string")
    assert {tuple(r) for r in S.replaced(index, new, gone).collect()} == {("q1", "x"), ("p2", "y2")}
    paths = [("/l/a/x.mineru.json",), ("/l/a/content_list.json",), ("/l/a/sub/content_list.json",), ("/l/b/n.txt",), ("/l/a/readme.md",)]
    assert {r["path"] for r in S.canonical(spark.createDataFrame(paths, "path string")).collect()} == {"/l/a/x.mineru.json", "/l/b/n.txt"}


def test_nearest_rank(spark):
    df = spark.createDataFrame([("g", v) for v in (1, 2, 3, 4, 10)] + [("h", None)], "g string, v long")
    assert [tuple(r) for r in E.nearest_rank(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()] == [("g", 5, 3, 10)]


def test_recall_counts_failures_as_zero(spark):
    labels = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "query_id long, row_id string")
    hits = spark.createDataFrame([(1, "z", 1), (1, "a", 2)], "query_id long, row_id string, rank int")
    assert {tuple(r) for r in E.scored(labels, hits, 5).collect()} == {(1, 2, 1, 0.5, 0.5), (2, 1, 0, 0.0, 0.0)}


def test_folder_source_and_cases(spark, tmp_path):
    (tmp_path / "d/.git").mkdir(parents=True)
    (tmp_path / "d/_x.md").write_text("x")
    (tmp_path / "d/.git/y.md").write_text("y")
    (tmp_path / "z.txt").write_text("z")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in folder(spark, str(tmp_path)).collect()) == ["_x.md", "z.txt"]
    assert folder(spark, str(tmp_path), ".md").count() == 1
    good = {"id": "1", "query": "q", "provenance": "", "relevant": [{"contains": "c"}]}
    (tmp_path / "c.jsonl").write_text(json.dumps(good) + "\n\n")
    assert eval_cases(spark, str(tmp_path / "c.jsonl")).count() == 1
    (tmp_path / "bad.jsonl").write_text(json.dumps(good) + "\n" + json.dumps(good))
    with pytest.raises(ValueError):
        eval_cases(spark, str(tmp_path / "bad.jsonl"))
