import io
import zipfile

from pyspark.sql import functions as F

from foliant.operators import blocks as B
from foliant.operators import chunking as C
from foliant.operators import formats as P
from foliant.operators import navigation as N
from foliant.operators.models import HashedWords, embedding

BLOCK = "document_id string, block_id string, block_ord int, text string, section string, page_start int, page_end int, line_start int, line_end int, kind string"


def rows(*texts, kinds=None):
    return [("d", str(i), i, t, "s", 1, 1, None, None, (kinds or {}).get(i, "")) for i, t in enumerate(texts)]


def test_figures_float_behind_the_run_they_interrupt(spark):
    df = spark.createDataFrame(rows("one", "fig", "two", " ", None, kinds={1: "figure"}), BLOCK)
    got = [(r["text"], r["kind"]) for r in B.merged(df).orderBy("group_no").collect()]
    assert got == [("one\n\ntwo", ""), ("fig", "figure")]


def test_lined_blocks_join_only_one_blank_line_apart(spark):
    a = [("d", "0", 0, "a\nb", None, None, None, 1, 2, ""), ("d", "1", 1, "c", None, None, None, 4, 4, ""), ("d", "2", 2, "e", None, None, None, 7, 7, "")]
    got = B.merged(spark.createDataFrame(a, BLOCK)).orderBy("group_no").collect()
    assert [(r["text"], r["line_start"], r["line_end"]) for r in got] == [("a\nb\n\nc", 1, 4), ("e", 7, 7)]


def test_markdown(spark):
    text = "intro\n\n# One\n\ntext\n```\n# not a heading\n```\n## Two ##\nmore\n\nThree\n=====\nlast\n\n# References\ngone"
    got = B.markdown_sections(spark.createDataFrame([(1, text), (2, None), (3, " ")], "doc_id long, text string")).orderBy("line_start").collect()
    assert [(r["section"], r["line_start"], r["line_end"]) for r in got] == [("", 1, 1), ("One", 3, 8), ("One / Two", 9, 10), ("Three", 12, 14)]


def test_outline_and_budget(spark):
    p = spark.createDataFrame([("d", i, s, i, i, 400) for i, s in enumerate(["A / x", "A / x", "A", "A / x", None])], "doc string, idx int, section string, page_start int, page_end int, tokens int")
    out = N.outline(p).orderBy("run").collect()
    assert [(r["section"], r["first"], r["last"], r["nth"]) for r in out] == [("A / x", 0, 1, 1), ("A", 2, 2, 1), ("A / x", 3, 3, 2), ("", 4, 4, 1)]
    assert [r["short"] for r in N.without_common_head(N.outline(p)).orderBy("run").collect()] == ["x", "A", "x", ""]
    assert [(r["idx"], r["next"], r["shown"]) for r in N.budget(p, 900).orderBy("idx").collect()] == [(0, 2, "A / x"), (1, 2, None)]
    assert N.budget(p, 1).count() == 1
    assert [r["idx"] for r in N.pages(p, 1, 2).orderBy("idx").collect()] == [1, 2]


def test_units_keep_formulas_whole_and_cover_the_text():
    text = "One is $a. b$ here. 二。三！ Four?\nfive " + "x" * 900
    units = C.units_of(text, 60)
    assert "".join(text[a:b] for a, b in units) == text
    assert text[slice(*units[0])] == "One is $a. b$ here. "
    assert max(C.estimate(text[a:b]) for a, b in units) <= 60


def test_semantic_fold_cuts_at_the_least_alike():
    texts = ["a" * 200] * 12  # 50 tokens each
    cut = C.fold_by_meaning(texts, [0.9] * 3 + [0.1] + [0.9] * 8, C.Limits())
    assert cut[0] == 3 and cut[-1] == 11
    assert C.fold_by_meaning(["short"], [0.0], C.Limits()) == [0]


def test_chunks_stay_within_limits(spark):
    body = " ".join(f"Sentence number {i} speaks of topic {i // 7}." for i in range(200))
    df = spark.createDataFrame([("d", 1, body), ("e", 1, None), ("f", 1, "")], "document_id string, group_no int, text string")
    got = C.by_meaning(df, ["document_id", "group_no"], embedding(HashedWords(16))).orderBy("chunk_no").collect()
    assert len(got) > 3 and all(r["tokens"] <= 420 for r in got)
    assert " ".join(r["content"] for r in got) == body
    buffered = C.by_buffer(spark.createDataFrame([("d", 1, body, "s", 1), ("d", 2, "Next page.", "t", 2)], "document_id string, place int, text string, section string, page_start int")).orderBy("chunk_index").collect()
    assert all(r["tokens"] <= 240 for r in buffered) and buffered[-1]["content"] == "Next page." and buffered[1]["content"].split(" ", 1)[0]


PAGE = """<!DOCTYPE html><title>Recipe site</title><form><input></form>
<article><h2>Leeks</h2><p>Wash them &amp; cut<br>them thin.<p aria-hidden=true>print this<pre>1 kg
  leeks</pre><template><p>card</p></template><h3>Stock</h3><ol><li>Boil<li>Strain</ol><div>Serve <i>hot</i>.</div></article>
<article><h2>Next recipe</h2><p>Beets</p></article><noscript>enable scripts</noscript>"""


def test_html_takes_the_first_article_without_its_surroundings():
    assert P.html_blocks(PAGE) == [("Wash them & cut them thin.", "Leeks"), ("1 kg\n  leeks", "Leeks"), ("Boil", "Leeks / Stock"), ("Strain", "Leeks / Stock"), ("Serve hot.", "Leeks / Stock")]
    assert P.html_blocks("<p>before<main><p>one</main><main><p>two</main>") == [("one", None)]


TEI = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><abstract>{0}</abstract></teiHeader><text><body><div><head>Method</head><p coords="2,1,1,9,9;3,1,1,9,9">We <formula>x</formula>walk.</p><p coords="2,5,5,9,9;3,1,1,2,2">Then run.</p><p coords="4,1,1,1,1">And rest.</p><div><head>Legs</head><p>Two.</p></div></div><div type="references"><p>[1]</p></div></body><back><div type="appendix"><head>Shoes</head><p>Laced.</p></div><div type="funding"><p>Nobody</p></div></back></text></TEI>'


def test_tei_has_pages_joins_and_appendices():
    want = [("We walk.\n\nThen run.", "Method", 2, 3), ("And rest.", "Method", 4, 4), ("Two.", "Method / Legs", None, None), ("Laced.", "Shoes", None, None)]
    assert P.tei_blocks(TEI.format("<p>Short.</p>")) == [("Short.", "Abstract", None, None), *want]
    assert P.tei_blocks(TEI.format("Bare text.")) == [("Bare text.", "Abstract", None, None), *want]
    for bad in (TEI.replace(' xmlns="http://www.tei-c.org/ns/1.0"', ""), TEI.replace("4,1,1,1,1", "4,1"), "<!DOCTYPE TEI>" + TEI, '<TEI xmlns="http://www.tei-c.org/ns/1.0"/>'):
        try:
            P.tei_blocks(bad)
        except Exception:
            continue
        raise AssertionError(bad)


def test_bad_documents_are_rows_to_set_aside(spark):
    good = '<!DOCTYPE article PUBLIC "-//X" "x.dtd"><article><body><sec><title>S&eacute;n</title><p>a&nbsp;b</p><sec><title>T</title><p>c</p></sec></sec></body></article>'
    df = spark.createDataFrame([(1, good), (2, "<!DOCTYPE a [<!ENTITY x 'y'>]><article/>"), (3, None), (4, "<article>")], "id long, s string")
    assert [(r["id"], r["text"], r["section"]) for r in P.parsed(df, "id", "s", "jats").orderBy("block_ord").collect()] == [(1, "a\xa0b", "Sén"), (1, "c", "Sén / T")]
    assert {r["id"] for r in P.failures(df, "id", "s", "jats").collect()} == {2, 4}
    assert [r["text"] for r in P.parsed(df.filter("id = 4"), "id", "s", "text").collect()] == ["<article>"]


def test_word_documents():
    ns = 'xmlns:w="urn:w"'
    run = lambda text, marks="": f"<w:r><w:rPr>{marks}</w:rPr><w:t>{text}</w:t></w:r>"
    para = lambda inner, marks="": f"<w:p><w:pPr>{marks}</w:pPr>{inner}</w:p>"
    body = para(run("Garden"), '<w:pStyle w:val="Heading1"/>') + para(run("Dig ") + run("deep", '<w:vanish w:val="false"/>') + run(" not", "<w:vanish/>") + "<w:del>" + run("never") + "</w:del>")
    body += para(run("Tools"), '<w:pStyle w:val="Mine"/>') + "<w:tbl>" + para(run("spade")) + "</w:tbl>" + para(run("Weeds"), '<w:outlineLvl w:val="1"/>') + para(run("plain"), '<w:outlineLvl w:val="9"/>')
    styles = f'<w:styles {ns}><w:style w:styleId="Mine"><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style></w:styles>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", styles)
    assert P.docx_blocks(out.getvalue()) == [("Garden", "Garden"), ("Dig deep", "Garden"), ("Tools", "Garden / Tools"), ("spade", "Garden / Tools"), ("Weeds", "Garden / Weeds"), ("plain", "Garden / Weeds")]


def test_markdown_fences_underlines_and_images(spark):
    text = "A ![chart of x](c.png) here\n````\n# no\n```\nB\n````\n~~~\n```\n# no\n~~~\n\nLong\ntitle\n---\n<table><tr><td>a</td><td>b</td></tr></table>"
    got = B.markdown_sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("line_start").collect()
    assert [(r["section"], r["line_start"], r["line_end"]) for r in got] == [("", 1, 10), ("Long title", 12, 15)]
    assert got[0]["text"].startswith("A chart of x here") and "\nB\n" in got[0]["text"] and got[1]["text"].endswith("a | b")
