"""Exports of page converters, pages taken from them, and files to chunks."""

import json

import pytest
from pyspark.sql import functions as F

from foliant.operators import exports as X
from foliant.operators import formats as P
from foliant.operators import paging as G
from foliant.operators.chunking import Limits, routed
from foliant.operators.models import HashedWords, embedding
from foliant.operators.pipeline import chunked_files, rebuilt
from foliant.sources.files import Generations, folder


def test_items_of_a_flat_list():
    items = [
        {"type": "text", "text": "Survey  of\ttides", "text_level": 1, "page_idx": 4},
        {"type": "text", "text": "Proof. As above.", "text_level": 2, "page_idx": 4},
        {"type": "text", "text": "II.", "text_level": 2, "page_idx": 4},
        {"type": "image", "img_path": "gauge.png", "page_idx": 5},
        {"type": "table", "table_caption": ["Heights"], "table_body": "<table><tr><th>port<th>m</tr><tr><td>Brest</td><td>6 &lt; 7</td></tr></table>", "page_idx": 5},
        {"type": "code", "code_body": "a = 1", "page_idx": 5},
        {"type": "page_number", "text": "17", "page_idx": 5},
        {"type": "list", "list_items": ["ebb", "flow"], "page_idx": 5},
        {"type": "text", "text": "Bibliography", "text_level": 1, "page_idx": 6},
        {"type": "text", "text": "Somebody, 1907", "page_idx": 6},
        {"type": "image", "img_path": "author.png", "page_idx": 6},
    ]
    got = X.export_blocks(json.dumps(items))
    assert [b[0] for b in got] == ["Survey of tides", "Proof. As above.", "II.", "Heights\nport | m\nBrest | 6 < 7", "a = 1", "ebb flow"]
    assert got[1][1] == "Survey of tides" and got[2][1] == "Survey of tides / II." == got[5][1]
    assert [(b[2], b[4]) for b in got] == [(5, ""), (5, ""), (5, ""), (6, "table"), (6, "code"), (6, "")]
    assert got[2][5] == ["gauge.png"]  # with the block before it


def test_nested_paged_and_lined_documents():
    said = [{"type": "text", "content": "Height "}, {"type": "inline_equation", "content": "h_0"}]
    nested = [[{"type": "paragraph", "content": {"paragraph_content": said}}, {"type": "equation_interline", "content": {"math_content": "h=0"}}, {"type": "list", "content": {"list_type": "reference_list", "list_items": [{"item_content": said}]}}]]
    assert [(b[0], b[2]) for b in X.export_blocks(json.dumps(nested))] == [("Height $h_0$", None), ("$$h=0$$", None)]
    paged = {"schema": "docvortex.middle", "schema_version": "2.0", "pages": [{"page_idx": 11, "blocks": [{"type": "text", "content": said}]}]}
    assert X.export_blocks(json.dumps(paged))[0][:4] == ("Height $h_0$", None, 12, 12)
    lined = {"pdf_info": [{"page_idx": 0, "para_blocks": [{"type": "algorithm", "blocks": [{"lines": [{"spans": said}]}, {"lines": [{"spans": said}]}]}]}]}
    assert [(b[0], b[4]) for b in X.export_blocks(json.dumps(lined))] == [("Height $h_0$ Height $h_0$", "code")]


@pytest.mark.parametrize(
    "bad",
    ["[]", "7", "[3]", "{}", '[{"type":"text","text":"x"}] 1', '[{"type":"text","text":"x","page_idx":1.5}]', '[{"type":"text","text":"x","page_idx":true}]', '[{"type":"title","text":"x","level":7}]', '{"pages":[{"blocks":[]}]}', '{"pages":[{"page_idx":1,"blocks":[]},{"page_idx":1,"blocks":[]}]}', '{"schema":"other","pages":[]}'],
)
def test_malformed_exports_are_rows_with_errors(spark, bad):
    df = spark.createDataFrame([("good", '[{"type":"text","text":"kept"}]'), ("bad", bad), ("null", None), ("empty", "")], "id string, s string")
    assert [(r["id"], r["text"]) for r in P.parsed(df, "id", "s", "mineru").collect()] == [("good", "kept")]
    assert [r["id"] for r in P.failures(df, "id", "s", "mineru").collect()] == ["bad"]


def test_spans_cross_pages(spark):
    line = lambda t, **k: {"spans": [{"type": "text", "content": t, **k}]}
    doc = {"pdf_info": [{"page_idx": 2, "para_blocks": [{"lines": [line("one"), line("two", cross_page=True)], "blocks": [{"lines": [line("three")], "blocks": [{"lines": [line("four", html="<b>")]}]}]}, {"lines": []}, {}]}, {"page_idx": -1, "para_blocks": [{"lines": [line("none")]}]}]}
    df = spark.createDataFrame([("d", json.dumps(doc)), ("e", "[]"), ("f", None), ("g", "{")], "id string, s string")
    assert [(r["id"], r["page"], r["text"]) for r in X.spans(df, "id", "s").orderBy("at").collect()] == [("d", 3, "one"), ("d", 4, "two"), ("d", 3, "three"), ("d", 3, "four <b>")]


ONE, TWO = ("The harbour at low water shows a broad shelf of worn slate and weed.", "Soundings taken from the eastern mole differ by a fathom each spring.")


def test_pages_for_paragraphs(spark):
    text = f"A word.\n\n{ONE}\n\nshort\n\n\n{TWO}\nGo on.\n\nend"
    blocks = spark.createDataFrame([("d", 1, text, 10), ("other", 1, ONE, 1), ("blank", 1, " \n", 1), ("null", 1, None, 1)], "doc string, block_ord int, text string, line_start int")
    paged = spark.createDataFrame([("d", 5, ONE.upper()), ("d", 7, TWO), ("d", None, "x"), ("other", 1, TWO)], "doc string, page int, text string")
    got, off = G.paged_paragraphs(blocks, paged)
    rows = [tuple(r) for r in got.orderBy("part").select("line_start", "line_end", "page_start", "page_end").collect()]
    assert rows == [(10, 10, 5, 5), (12, 12, 5, 5), (14, 14, 5, 7), (17, 18, 7, 7), (20, 20, 7, 7)]
    assert [r["doc"] for r in off.collect()] == ["other"]


def test_repaged_and_figures(spark):
    rows = [("a", "d", 1, ONE, 1, 1, ["x.png"]), ("b", "d", 2, "(a)", 1, 1, ["y.png", "z.png"]), ("c", "d", 3, TWO, 1, 1, []), ("n", "e", 1, None, 4, 4, ["w.png"])]
    blocks = spark.createDataFrame(rows, "row_id string, doc string, place int, text string, page_start int, page_end int, images array<string>")
    paged = spark.createDataFrame([("d", 3, ONE), ("d", 4, TWO[:46]), ("d", 5, TWO[20:])], "doc string, page int, text string")
    assert [(r["row_id"], r["page_start"], r["page_end"]) for r in G.repaged(blocks, paged).orderBy("row_id").collect()] == [("a", 3, 3), ("b", 1, 1), ("c", 4, 5), ("n", 4, 4)]
    chunks = spark.createDataFrame([("d", 0, TWO), ("d", 1, ONE)], "doc string, chunk_index int, text string")
    assert sorted((r["chunk_index"], r["image"]) for r in G.figure_places(blocks, chunks).collect()) == [(1, "x.png"), (1, "y.png"), (1, "z.png")]


def test_routes_and_lines(spark):
    long = "\n".join(f"Line {i} of the log is here." for i in range(60))
    rows = [("m", "a.md", "markdown", 1, long, 5), ("c", "a.py", "text", 1, long, 1), ("c", "a.py", "text", 2, long, 70), ("t", "a.txt", "text", 1, "  \n\nShort note.", 3), ("n", None, None, 1, "x", None)]
    df = spark.createDataFrame(rows, "document_id string, path string, file_format string, group_no int, text string, line_start int").withColumns({"section": F.lit(None).cast("string"), "page_start": F.lit(None).cast("int"), "page_end": F.lit(None).cast("int")})
    got = routed(df, embedding(HashedWords(8)), Limits()).orderBy("document_id", "chunk_index").collect()
    assert {(r["document_id"], r["route"]) for r in got} == {("m", "meaning"), ("c", "document"), ("t", "meaning"), ("n", "document")}
    m = [r for r in got if r["document_id"] == "m"]
    assert len(m) > 1 and (m[0]["line_start"], m[-1]["line_end"]) == (5, 64)
    assert all(r["content"] == "\n".join(long.split("\n")[r["line_start"] - 5 : r["line_end"] - 4]) for r in m)
    assert [(r["line_start"], r["line_end"]) for r in got if r["document_id"] == "t"] == [(5, 5)]
    assert {r["route"] for r in routed(df, embedding(HashedWords(8)), Limits(), "legacy").collect()} == {"block", "document"}
    with pytest.raises(ValueError):
        routed(df, embedding(HashedWords(8)), Limits(), "other")


def test_files_to_an_index(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("# Tides\n\n" + ONE)
    (docs / "b.txt").write_text(TWO)
    (docs / "c_content_list.json").write_text(json.dumps([{"type": "text", "text": ONE, "page_idx": 1}]))
    (docs / "scan.json").write_text(json.dumps({"version": 1, "blocks": [{"text": TWO, "pageStart": 2, "pageEnd": 2}]}))
    embed = embedding(HashedWords(8))
    chunks, failures = chunked_files(folder(spark, str(docs)), str(docs), embed)
    assert failures.count() == 0
    got = {r["path"].rsplit("/", 1)[1]: r for r in chunks.collect()}
    assert sorted(got) == ["a.md", "b.txt", "c_content_list.json", "scan.json"]
    assert got["a.md"]["section"] == "Tides" and got["c_content_list.json"]["page_start"] == 2 and got["scan.json"]["page_end"] == 2
    index = Generations(spark, str(tmp_path / "index"))
    assert rebuilt(index, chunks, failures) == "g000000001" and index.read().count() == 4
    (docs / "empty.txt").write_text("")
    (docs / "broken.docx").write_bytes(b"no zip")
    chunks, failures = chunked_files(folder(spark, str(docs)), str(docs), embed)
    assert sorted((r["path"].rsplit("/", 1)[1], r["stage"]) for r in failures.collect()) == [("broken.docx", "parse"), ("empty.txt", "parse")]
    with pytest.raises(ValueError):
        rebuilt(index, chunks, failures)
    assert index.active() == "g000000001"
