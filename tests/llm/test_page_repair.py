import random

import numpy as np
from pyspark.sql import functions as F

from foliant.llm.models import Boosted
from foliant.llm.page_repair import CONFUSIONS, defects, folded, repaired

FILES = "document_id string, path string, title string, file_format string, indexed timestamp"
BLOCKS = "block_id string, document_id string, block_ord int, page_start int, text string"
CHUNKS = "id string, file_path string, chunk_index int, page_start int, chunk_content string"


def library(spark):
    """Clean texts, and scanned pages spoilt on purpose: (tables, the true defects)."""
    rng = random.Random(5)
    syllables = "ka lo mi tes ran dol vek sun par ter wil hom bas".split()
    words = sorted({"".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(260)})
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    files = [("clean", "/c.md", "Clean", "markdown", None)]
    chunks = [(f"clean-{i}", "/c.md", i, None, text(120) + " self-" + rng.choice(words) + ".") for i in range(60)]
    blocks, truth = [], set()
    for d in range(12):
        title = f"the {text(4)}"
        files.append((f"d{d}", f"/d{d}.json", title, "paged-text", None))
        for p in range(1, 9):
            lines = [title.upper()]
            for _ in range(14):
                lines.append(text(6))
            lines.append(f"- {p} -")
            bid = f"d{d}#{p}"
            truth |= {("block", bid, 1, "furniture"), ("block", bid, len(lines), "furniture")}
            for k in (3, 7):
                w = rng.choice([w for w in words if len(w) >= 6])
                lines[k] += " " + w[:3] + "-"
                lines[k + 1] = w[3:] + " " + lines[k + 1]
                truth.add(("block", bid, k + 1, "hyphen"))
            right, wrong = rng.choice([c for c in CONFUSIONS if c[0] in "losetinah"])
            tokens = lines[11].split()
            at = [i for i, w in enumerate(tokens) if right in w and len(w) >= 5]
            if at:
                tokens[at[0]] = tokens[at[0]].replace(right, wrong, 1)
                lines[11] = " ".join(tokens)
                truth.add(("block", bid, 12, "misread"))
            blocks.append((bid, f"d{d}", p, p, "\n".join(lines)))
    blocks += [blocks[0], ("n1", "d0", 99, None, None), ("n2", "d0", 98, None, ""), (None, None, None, None, None)]
    chunks += [("x", None, None, None, None)]
    return [spark.createDataFrame(rows, s) for rows, s in ((files, FILES), (blocks, BLOCKS), (chunks, CHUNKS))], truth


def test_held_out_accuracy_and_repair(spark):
    tables, truth = library(spark)
    lines, cuts, misread = defects(*tables)
    got = {(r["origin"], r["item_id"], r["line_no"], "furniture") for r in lines.filter("furniture >= 0.5").collect()}
    got |= {(r["origin"], r["item_id"], r["line_no"], "hyphen") for r in cuts.collect()}
    got |= {(r["origin"], r["item_id"], r["line_no"], "misread") for r in misread.collect()}
    for kind in ("furniture", "hyphen", "misread"):
        g, t = {x for x in got if x[3] == kind}, {x for x in truth if x[3] == kind}
        assert len(g & t) >= 0.9 * len(t), kind
        assert len(g - t) <= 0.1 * len(t), kind
    page = repaired(lines, cuts, misread).filter("doc = 'd1' AND page = 2").first()["text"]
    assert "THE" not in page and "- 2 -" not in page and "-" not in page


def test_empty_tables(spark):
    tables, _ = library(spark)
    lines, cuts, misread = defects(*[t.limit(0) for t in tables])
    assert lines.count() == cuts.count() == misread.count() == 0


def test_a_word_and_its_misreading_fold_alike(spark):
    pairs = [("residual", "re5idual"), ("fragment", "fragrnent"), ("kernel", "kemel"), ("sediment", "secliment"), ("index", "indcx"), ("studies", "stiidies"), ("twice", "tvvice")]
    for a, b in spark.createDataFrame(pairs, "a string, b string").select(folded(F.col("a")), folded(F.col("b"))).collect():
        assert a == b


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((Boosted().fit(x, y).probability(x) > 0.5) == y).mean() > 0.95
    assert len(Boosted().fit(np.zeros((0, 3)), np.zeros(0)).probability(x)) == 2000
