"""Runs counted in parts and chunks folded by run equal those of a whole document."""

import random

from foliant.operators import chunking as C
from foliant.operators import navigation as N


def passages(spark, seed=3):
    r, rows = random.Random(seed), []
    for doc in ("a", "b", "c"):
        section, at = "x", r.randrange(5)
        for _ in range({"a": 200, "b": 1, "c": 37}[doc]):
            section = r.choice([section, section, "x", "y", None, ""])
            rows.append((doc, at, section, 1, 1, 5))
            at += r.choice([1, 1, 1, 9])
    return rows, spark.createDataFrame([*rows, (None, 1, "x", 1, 1, 5)], "doc string, idx int, section string, page_start int, page_end int, tokens int")


def test_outline_whatever_the_parts(spark, monkeypatch):
    rows, df = passages(spark)
    want, runs = [], {}
    for doc, at, section, *_ in rows:
        run, last = runs.get(doc, (0, None))
        if last is None or last != (section or ""):
            run += 1
            want.append([doc, run, section or "", at, at])
        want[-1][4] = at
        runs[doc] = (run, section or "")
    for part in (1, 2, 7, 4096):
        monkeypatch.setattr(N, "PART", part)
        got = [list(r) for r in N.outline(df).select("doc", "run", "section", "first", "last").collect()]
        assert sorted(got) == sorted(want)


def test_common_heads(spark):
    rows = [("a", 1, "T"), ("a", 2, "T / one"), ("b", 1, "T / one"), ("b", 2, "U"), ("c", 1, ""), ("c", 2, "T"), ("d", 1, "")]
    df = spark.createDataFrame(rows, "doc string, run int, section string")
    assert [r["short"] for r in N.without_common_head(df).orderBy("doc", "run").collect()] == ["T", "one", "T / one", "U", "", "T", ""]


def test_buffers_by_run(spark):
    r, rows, limits = random.Random(5), [], C.Limits(buffer_target=20, buffer_most=30, overlap=6)
    page, section = 1, None
    for i in range(150):
        page, section = r.choice([page, page, page + 1, None, 1]) or 1, r.choice([section, section, section, "s", "t", None])
        rows.append(("d", i, r.choice(["", "\n\n"]) + " ".join(r.choice(["tide", "rock", "ebb.", "港口"]) for _ in range(r.randrange(0, 60))) + r.choice(["", "\n\nA tail."]), section, r.choice([page, page, None])))
    pieces = [(p.strip(), s, at) for _, _, t, s, at in rows for p in C.re.split(r"\n{2,}", t) if p.strip()]
    want = [(t, pieces[i][1]) for t, i in C.fold_by_buffer(pieces, limits)]
    df = spark.createDataFrame(rows, "document_id string, place int, text string, section string, page_start int")
    got = C.by_buffer(df.repartition(5), limits).orderBy("chunk_index").collect()
    assert [(x["content"], x["section"]) for x in got] == want and [x["chunk_index"] for x in got] == list(range(len(want)))
    assert C.by_buffer(df.limit(0), limits).count() == 0
