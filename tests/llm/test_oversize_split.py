from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm.oversize_split import cut_points, quarter_tokens, split_oversized


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 漢。.!?\n\t,", max_size=400), st.integers(4, 40), st.integers(0, 3))
def test_pieces_fit_cover_and_overlap(text, limit, overlap):
    pieces = cut_points(text, limit, overlap) if text else []
    done = 0
    for start, end, _ in pieces:
        assert quarter_tokens(text[start:end]) <= limit
        assert start <= done < end  # no gap, always further
        assert not text[start:done] or quarter_tokens(text[start:done]) <= max(overlap, 1)
        done = end
    assert done == len(text)


def test_forced_only_where_a_stretch_is_too_long():
    assert [f for *_, f in cut_points("word " * 400, 420, 0)] == [True, False]
    assert not any(f for *_, f in cut_points("Some words stand here. " * 120, 420, 30))
    assert not any(f for *_, f in cut_points(("x" * 1680 + "\n") * 3, 420, 0))  # the line end belongs to no stretch


def test_defined_results(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "short", "x"), (4, "漢" * 500, "x"), (4, "漢" * 500, "x"), (5, "a" * 200_000, "x")]
    df = spark.createDataFrame(rows, "id long, text string, piece string")  # `piece` bears an output's name
    got = split_oversized(df, keep_whole=True, overlap=0).collect()
    assert {(r["id"], r["cut"]) for r in got} == {(3, "whole"), (4, "forced"), (4, "natural"), (5, "forced"), (5, "natural")}
    assert sum(r["id"] == 4 for r in got) == 4  # two pieces of each repeated row
    assert "".join(r["piece"] for r in sorted(got, key=lambda r: r["piece_no"]) if r["id"] == 5) == "a" * 200_000
    assert split_oversized(df.limit(0)).count() == 0
