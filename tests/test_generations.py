import datetime as dt

import pytest

from foliant.sources.files import Generations, eval_cases, folder
from foliant.streaming.ingest import index_stream

SCHEMA = "path string, document_id string, hash string, indexed timestamp"


def at(day):
    return dt.datetime(2024, 1, day)


@pytest.mark.parametrize("step", ["write", "rename", "pointer", "move", "forget"])
def test_a_loss_at_any_step_leaves_a_whole_generation(spark, tmp_path, monkeypatch, step):
    src, index = str(tmp_path / "in"), str(tmp_path / "index")

    def arrive(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)

    def lost(self, name):
        if name == step:
            raise OSError("lost")

    def follow():
        index_stream(spark, src, SCHEMA, index, str(tmp_path / "check")).awaitTermination(120)

    arrive([("a", "1", "h1", at(1)), ("b", "2", "h1", at(1))])
    follow()
    before = {("a", "h1"), ("b", "h1")}
    after = {("a", "h2"), ("b", "h1"), ("c", "h3")}
    arrive([("a", "1", "h2", at(3)), ("a", "1", "h0", at(2)), ("c", "3", "h3", at(2))])
    with monkeypatch.context() as m:
        m.setattr(Generations, "_step", lost)
        with pytest.raises(Exception):
            follow()
    read = lambda: {(r["path"], r["hash"]) for r in Generations(spark, index).read("g000000001").collect()}
    assert read() == (after if step == "forget" else before)
    follow()
    assert read() == after and Generations(spark, index).active() == "g000000001"


def test_cleaner_and_coverage(spark, tmp_path):
    index = Generations(spark, str(tmp_path / "index"))
    assert index.active() is None and index.read() is None
    rows = spark.createDataFrame([("x",), ("y",)], "id string")
    for n in range(4):
        index.publish(rows, f"g{n}")
    (tmp_path / "index/precious").mkdir()
    assert index.clean(2, preview=True) == ["g1", "g0"] and index.clean(2) == ["g1", "g0"]
    assert (tmp_path / "index/precious").is_dir() and index.active() == "g3" and index.read().count() == 2
    with pytest.raises(ValueError):
        index.publish(rows, "g5", rows.limit(1))
    with pytest.raises(ValueError):
        index.publish(rows, "other")
    assert index.active() == "g3"
    for p in (tmp_path / "index").glob("active-*"):
        p.unlink()
    with pytest.raises(ValueError):
        index.active()


def test_ignored_files_and_unknown_fields(spark, tmp_path):
    (tmp_path / "a/drafts").mkdir(parents=True)
    for name in ("a/x.md", "a/drafts/y.md", "a/z.tmp"):
        (tmp_path / name).write_text("text")
    assert [r["path"].rsplit("/", 1)[1] for r in folder(spark, str(tmp_path), "", "drafts,*.tmp").collect()] == ["x.md"]
    (tmp_path / "c.jsonl").write_text('{"id": "1", "query": "q", "other": 1, "relevant": [{"contains": "c"}]}')
    with pytest.raises(ValueError):
        eval_cases(spark, str(tmp_path / "c.jsonl"))
