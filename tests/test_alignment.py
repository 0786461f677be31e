import random

import pytest

from foliant.operators.alignment import PIECE, STEP, WINDOW, _windows, accepted, aligned, corrected
from pyspark.sql import functions as F


def test_passages_get_the_pages_of_their_windows(spark):
    pages = [("d", p, " ".join(f"word{p}x{i} stands" for i in range(40)) + " common footer text on every single page") for p in (1, 2, 3)]
    paged = spark.createDataFrame(pages + [("d", None, "nothing"), ("d", 4, None)], "doc string, page int, text string")
    rows = [("a", "d", pages[0][2][200:]), ("b", "d", pages[1][2][-120:] + "\n" + pages[2][2][:150]), ("c", "d", "common footer text on every single page"), ("e", "other", pages[0][2]), ("f", "d", None)]
    got = {r["row_id"]: (r["page_start"], r["page_end"]) for r in aligned(spark.createDataFrame(rows, "row_id string, doc string, text string"), paged).collect()}
    assert got == {"a": (1, 1), "b": (2, 3)}


def test_windows_are_cut_piece_by_piece(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdé字𝒳1") for _ in range(n)) for n in (0, 1, WINDOW - 1, WINDOW, PIECE - 1, PIECE, PIECE + 1, PIECE + WINDOW - 1, 2 * PIECE + 5, 3001)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    for step in (1, STEP):
        cut = _windows(df, step)
        assert sorted((r["n"], r["w"]) for r in cut.collect()) == sorted((n, t[i : i + WINDOW]) for n, t in enumerate(texts) if t for i in range(0, len(t) - WINDOW + 1, step))
        assert "ArrowEvalPython" not in cut._jdf.queryExecution().toString()  # no Python worker holds the windows of a batch of texts


def test_corrections(spark):
    df = spark.createDataFrame([("on tbe way",), ("tbe end of tbe",), ("x",)], "t string")
    assert [r[0] for r in df.select(corrected(F.col("t"), [("tbe", "the"), ("the way", "it"), ("x", " ")])).collect()] == ["on it", "the end of the", None]
    assert accepted(df, "t", "end", "End") == ("end", "End")
    for wrong in ("tbe", "none", "#x", "a\tb", ""):
        with pytest.raises(ValueError):
            accepted(df, "t", wrong, "y")
