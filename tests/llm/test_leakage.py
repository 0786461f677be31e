import random

from foliant.llm.leakage import leaked, tile, tokens


def brute(docs, cases, run):
    out = set()
    for d, t in docs:
        x = tokens(t)
        there = {tuple(x[i : i + run]) for i in range(len(x) - run + 1)}
        for c, p in cases:
            y = tokens(p)
            if any(tuple(y[i : i + run]) in there for i in range(len(y) - run + 1)):
                out.add((d, c))
    return out


def sample():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(2))
    cases = [(i, " ".join(word() for _ in range(30))) for i in range(8)] + [(8, "漢字の文章をそのまま含む長い試験問題です。" * 2), (9, None), (10, ""), (11, "too short")]
    cases.append((12, cases[0][1]))  # two items share a text
    docs = [(i, " ".join(word() for _ in range(200))) for i in range(20)] + [(30, None), (31, "")]
    docs += [(40, "x " + cases[0][1].upper() + " y"), (41, ", ".join(cases[1][1].split()[5:21])), (42, "前" + cases[8][1]), (43, " ".join(cases[2][1].split()[:15])), (40, "x " + cases[0][1].upper() + " y")]
    words = cases[3][1].split()
    docs.append((44, " ".join(words[16:] + ["zz"] + words[:16])))
    return docs, cases


def test_both_ways_equal_brute_force(spark):
    docs, cases = sample()
    d, c = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(cases, "case_id long, passage string")
    for run in (16, 8):
        want = brute(docs, cases, run)
        for most in (10**6, 0):
            got = leaked(d, c, run=run, most_windows=most).collect()
            assert {(r["doc_id"], r["case_id"]) for r in got} == want and len(got) == len(want)
    assert leaked(d.limit(0), c).count() == 0 and leaked(d, c.limit(0)).count() == 0


def test_reordered_pieces_count_together(spark):
    docs, cases = sample()
    got = leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(cases, "case_id long, passage string"), run=8).filter("doc_id = 44 AND case_id = 3").first()
    assert got["tiles"] == 2 and got["coverage"] == 1.0


def test_tiles_do_not_overlap():
    got = tile([(0, 0, 20), (10, 100, 20), (10, 5, 16)], 8)
    assert got[0] == (0, 0, 20) and (20, 110, 10) in got and sum(n for *_, n in got) == 30
