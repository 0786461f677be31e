"""Noise in text from scanned pages: furniture, words cut at line ends, wrongly recognised characters.

Lines are rows. Page furniture is found among the EDGE first and last lines of a page by a boosted classifier over a
line and its counterparts on other pages: where it stands on its page, on how many pages of its document and in how many
documents the same line (after misreadings, digits and blanks are folded away) stands at a page's edge or within one,
page numbers, the document's title. Lines within a page serve as examples of text. Words cut at line ends are decided by
a boosted classifier of the line pair: the mark, and how often the joined word, its halves, and a compound's first part
occur in the rest of the library. Wrong characters are found by spelling: rare words retrieve candidates by a join of
inverted character 3-grams, of which only the rarest of a word need be probed, and a boosted ranking chooses among them.
Numbers are an open class without a lexicon: in them, letters that stand for digits are put back by rule.

The models learn from weak labels, drawn here: lines that repeat at edges against lines within pages; words of the
library cut at random against its compounds; words of the library spoilt by the usual confusions against words that
only look alike. Samples are at most SAMPLE rows a class; all counts cover all texts.

Scale: windows run within one page; what goes over to the next page is joined by page number, so a document of any
length is no single group. Counts aggregate before they are shuffled. Line texts are written once and read again; so are
the distinct words, for Catalyst would else work out the 3-grams of every token before it drops the repeated ones.

Defined results: null and empty texts have no row; an item whose page is null is a page of its own, in the order of
items; repeated rows count once; lines of items that are not paged text are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.models import Boosted
from foliant.sources.tables import newest, small, staged, table

SAMPLE, WORDS = 10_000, 3_000  # most rows of a class that a model is fitted on; words that the ranking learns from
MOST_SENT = 16 << 20  # most bytes of a lookup table that is broadcast; beyond, a salted join
EDGE = 3  # lines from a page's top or bottom that furniture may stand on
KNOWN, KNOWN_SHARE = 3, 1e-6  # a word is known from so many occurrences, and from this share of all words
RARE_SHARE, MISREAD_SHARE = 4e-6, 0.02  # words up to this share of all are looked into; a misreading is at most this frequent against its source
OVERLAP = 0.7  # share of a word's 3-grams that a candidate must have

# What recognition takes for what (right, wrong).
CONFUSIONS = (("l", "1"), ("o", "0"), ("s", "5"), ("m", "rn"), ("n", "ri"), ("d", "cl"), ("w", "vv"), ("u", "ii"), ("i", "j"), ("t", "f"), ("e", "c"), ("h", "b"), ("g", "q"), ("a", "ä"), ("rn", "m"))
SOFT = "¬‐­"  # marks that only cut words; the plain hyphen also joins compounds
CUT = f"[-{SOFT}]"
PAGE_NUMBER = r"(?i)^[^\p{L}\p{N}().,]*(?:page|seite|p\.)?\s*[0-9loIS]{1,5}(?:\s*(?:of|von|/)\s*[0-9loIS]{1,5})?[^\p{L}\p{N}().,%?!;:]*$"
ROMAN = r"(?i)^[^\p{L}\p{N}().,]*[ivx]{1,6}[^\p{L}\p{N}().,%?!;:]*$"
SPOILT_NUMBER = r"(?<![\p{L}\p{N}.,])(?=[0-9lo.,]*[0-9])(?=[0-9.,]*[lo])[0-9lo]+(?:[.,][0-9lo]+)*(?![\p{L}\p{N}])"
TOKEN = r"[\p{L}\p{N}]+"


def folded(text: Column) -> Column:
    """Lower case with each confusion's wrong form read as the right one; the same for a word and its misreadings."""
    t = _replaced(F.lower(text), (("fi", "ﬁ"), ("fl", "ﬂ")))
    t = F.translate(t, "105jfcbqä", "lositehga")
    return _replaced(t, (("u", "ii"), ("m", "rn"), ("n", "ri"), ("d", "el"), ("w", "vv")))  # after c is read as e, cl stands as el


def _replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for right, wrong in pairs:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def skeleton(text: Column) -> Column:
    numbers = F.regexp_replace(text, r"(?<![\p{L}])[0-9lo.,/]*\d[0-9lo.,/]*(?![\p{L}])", " ")
    return F.regexp_replace(folded(F.when(text.rlike("[0-9]"), numbers).otherwise(text)), r"[^\p{L}]+", "")


def _few(df: DataFrame) -> DataFrame:
    """Broadcast if its size is small; else as it is."""
    return F.broadcast(df) if small(df, MOST_SENT) else df


def scanned_lines(files: DataFrame, blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Lines that are not blank of all scanned items: (origin, item_id, doc, page, ord, line_no, line, top, bottom, title)."""
    docs = newest(files.filter(F.col("document_id").isNotNull()).select("document_id", "path", "title", "file_format", "indexed"), ["document_id"], "indexed").filter("file_format = 'paged-text'")
    docs = _few(staged(docs.select("document_id", "path", skeleton(F.coalesce("title", F.lit(""))).alias("title")), "scanned-documents"))
    b = blocks.filter("text IS NOT NULL").select("block_id", F.col("document_id").alias("doc"), F.col("block_ord").alias("ord"), F.col("page_start").alias("page"), "text")
    b = b.join(docs.select(F.col("document_id").alias("doc"), "title"), "doc").dropDuplicates(["block_id"]).select(F.lit("block").alias("origin"), F.col("block_id").alias("item_id"), "doc", "ord", "page", "text", "title")
    c = chunks.filter("chunk_content IS NOT NULL").select("id", "file_path", F.col("chunk_index").alias("ord"), F.col("page_start").alias("page"), F.col("chunk_content").alias("text"))
    c = c.join(docs.select(F.col("path").alias("file_path"), F.col("document_id").alias("doc"), "title"), "file_path").dropDuplicates(["id"]).select(F.lit("chunk").alias("origin"), F.col("id").alias("item_id"), "doc", "ord", "page", "text", "title")
    alone = F.coalesce("ord", F.lit(0)).cast("long") - F.lit(1 << 40)  # below all pages, in order
    items = b.unionByName(c).withColumn("page", F.coalesce(F.col("page").cast("long"), alone))
    lines = items.select("origin", "item_id", "doc", "ord", "page", "title", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1).filter(F.col("line").rlike(r"\S"))
    page = Window.partitionBy("origin", "doc", "page")
    order = page.orderBy("ord", "item_id", "line_no")
    lines = lines.withColumn("top", F.row_number().over(order)).withColumn("bottom", F.count("*").over(page) - F.col("top") + 1)
    lines = lines.withColumn("typical", F.max(F.length(F.trim("line"))).over(page)).withColumn("sk", skeleton(F.col("line")))
    return lines.withColumn("edge", (F.col("top") <= EDGE) | (F.col("bottom") <= EDGE))


def _looked_up(df: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of a table of facts: broadcast while it is small, else salted by page, for one running header may be a third of all edge lines."""
    if small(facts, MOST_SENT):
        return df.join(F.broadcast(facts), keys, "left")
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return df.withColumn("salt", F.pmod(F.col("line_no"), F.lit(8))).join(salted, [*keys, "salt"], "left").drop("salt")


FURNITURE = ["pages", "docs", "within", "number", "is_page", "roman", "top", "bottom", "titled", "long", "ends", "upper", "apart", "lower_start", "share"]


def _furniture_features(asked: DataFrame, lines: DataFrame) -> DataFrame:
    """The features of the lines asked for, against the counts of all lines."""
    at = F.col("edge").cast("int")
    on_page = lines.filter(F.length("sk") >= 4).groupBy("origin", "doc", "sk", "page").agg(F.max(at).alias("e"), F.max(1 - at).alias("i"))
    in_doc = staged(on_page.groupBy("origin", "doc", "sk").agg(F.sum("e").alias("pages"), F.max("e").alias("e"), F.max("i").alias("i")), "lines-of-documents")
    by_doc = in_doc.filter("pages > 1").select("origin", "doc", "sk", "pages")
    by_sk = in_doc.groupBy("sk", "doc").agg(F.max("e").alias("e"), F.max("i").alias("i")).groupBy("sk").agg(F.sum("e").alias("docs"), F.sum("i").alias("within"))
    x = _looked_up(asked, by_doc, ["origin", "doc", "sk"])
    x = _looked_up(x, staged(by_sk.filter("docs + within > 1"), "repeats"), ["sk"])
    length = F.length(F.trim("line"))
    t, size = F.col("title"), F.length("sk")  # the title's skeleton
    tail = F.substr("sk", size - 11, F.lit(12))  # a header may begin with an author
    titled = F.when(F.col("edge") & (size >= 10), (F.levenshtein(F.substr(t, F.lit(1), size), F.col("sk")) <= size * 0.2) | ((size >= 14) & F.contains(t, tail))).otherwise(F.lit(False))
    digits = F.regexp_extract_all(F.translate("line", "loIS", "1015"), F.lit(r"\d+"), F.lit(0))
    letters = F.length(F.regexp_replace("line", r"[^\p{L}]", ""))
    return x.select(
        "origin",
        "item_id",
        "doc",
        "ord",
        "page",
        "line_no",
        "line",
        "edge",
        F.log1p(F.coalesce("pages", F.when(F.col("edge"), F.lit(1)).otherwise(F.lit(0)))).alias("pages"),
        F.log1p(F.coalesce("docs", F.when(F.col("edge") & (size >= 4), F.lit(1)).otherwise(F.lit(0)))).alias("docs"),
        F.log1p(F.coalesce("within", F.lit(0))).alias("within"),
        (F.col("line").rlike(PAGE_NUMBER)).cast("double").alias("number"),
        F.array_contains(digits, F.col("page").cast("string")).cast("double").alias("is_page"),
        F.col("line").rlike(ROMAN).cast("double").alias("roman"),
        F.least("top", F.lit(9)).cast("double").alias("top"),
        F.least("bottom", F.lit(9)).cast("double").alias("bottom"),
        titled.cast("double").alias("titled"),
        (length / F.greatest("typical", F.lit(1))).alias("long"),
        F.trim("line").rlike(r"[.,;:!?»”\"-]$").cast("double").alias("ends"),
        F.coalesce(F.length(F.regexp_replace("line", r"[^\p{Lu}]", "")) / F.nullif(letters, F.lit(0)), F.lit(0.0)).alias("upper"),
        F.trim("line").rlike(r"^\d+\s{2,}\p{L}|\p{L}.*\s{2,}\d+$").cast("double").alias("apart"),
        F.trim("line").rlike(r"^\p{Ll}").cast("double").alias("lower_start"),
        (letters / F.greatest(length, F.lit(1))).alias("share"),
    )


def _scored(df: DataFrame, names: list[str], model: Boosted, out: str) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(cols: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for series in cols:
            yield pd.Series(sent.value.probability(np.stack([s.to_numpy(float) for s in series], 1)) if len(series[0]) else [])

    return df.withColumn(out, run(*[F.col(n).cast("double") for n in names]))


def _fitted(df: DataFrame, names: list[str], label: Column, order: Column) -> Boosted:
    """A model of a bounded sample of the labelled rows, the same rows every time."""
    known = df.select(*names, label.alias("__y"), order.alias("__o")).filter("__y IS NOT NULL")
    got = pd.concat([known.filter(F.col("__y") == y).orderBy("__o", *names).limit(SAMPLE).toPandas() for y in (1.0, 0.0)], ignore_index=True)
    return Boosted().fit(got[names].to_numpy(float), got["__y"].to_numpy(float))


def furniture(lines: DataFrame) -> DataFrame:
    """The lines with the probability `furniture`, which is 0 beyond a page's edges."""
    lines = staged(lines, "page-lines")
    order = F.xxhash64("item_id", "line_no")
    text = lines.filter("NOT edge").orderBy(order).limit(SAMPLE)  # examples only
    x = staged(_furniture_features(lines.filter("edge").unionByName(text), lines), "line-features")
    edge = F.col("edge")
    several, spread = F.log1p(F.lit(2.5)), F.log1p(F.lit(3.5))
    again = (F.col("ends") == 0) & (F.col("within") == 0) & ((F.col("pages") > several) | (F.col("docs") > spread))
    yes = edge & (again | ((F.col("number") == 1) & (F.col("is_page") == 1)))
    no = ~edge | (edge & (F.col("pages") <= F.log1p(F.lit(1.0))) & (F.col("docs") <= F.log1p(F.lit(1.0))) & (F.col("number") == 0) & (F.col("roman") == 0) & (F.col("titled") == 0) & (F.col("apart") == 0)) | ((F.col("within") > 0) & (F.col("within") >= F.col("docs") - 0.7))
    model = _fitted(x, FURNITURE, F.when(yes, 1.0).when(no, 0.0), order)
    cols = ["origin", "item_id", "doc", "ord", "page", "line_no", "line"]
    return _scored(x.filter("edge"), FURNITURE, model, "furniture").select(*cols, "furniture").unionByName(lines.filter("NOT edge").select(*cols, F.lit(0.0).alias("furniture")))


def lexicon(files: DataFrame, blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(w, n): words of all texts but scanned ones; `x-` counts x as the first part of a compound."""
    scanned = staged(files.filter("file_format = 'paged-text'").select("document_id", "path").distinct(), "scanned-files")
    b = blocks.join(_few(scanned.select("document_id")), "document_id", "left_anti").select(F.col("text").alias("t"))
    c = chunks.join(_few(scanned.select(F.col("path").alias("file_path"))), "file_path", "left_anti").select(F.col("chunk_content").alias("t"))
    tokens = F.regexp_extract_all(F.lower("t"), F.lit(r"[a-z0-9à-öø-ÿœ]+(?:-(?=[a-zà-öø-ÿœ]))?"), F.lit(0))
    counted = staged(b.unionByName(c).filter("t IS NOT NULL").select(F.explode(tokens).alias("w")).groupBy("w").agg(F.count("*").alias("n")), "words")
    part = counted.filter(F.col("w").endswith("-"))
    return counted.unionByName(part.select(F.expr("substring(w, 1, length(w) - 1)").alias("w"), "n")).groupBy("w").agg(F.sum("n").alias("n"))


def _counted(df: DataFrame, words: DataFrame, column: str, name: str) -> DataFrame:
    return df.join(words.select(F.col("w").alias(column), F.col("n").alias(name)), column, "left").withColumn(name, F.coalesce(name, F.lit(0)))


PAIR = ["joined", "part", "first", "second", "capital", "soft", "short_a", "short_b"]


def _pair_features(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """pairs: (row, …, a, b, capital, soft). Adds log counts of the joined word, a as a compound's first part, a, and b."""
    forms = {"joined": F.concat("a", "b"), "part": F.concat("a", F.lit("-")), "first": F.col("a"), "second": F.col("b")}
    asked = pairs.select("row", F.explode(F.array(*[F.struct(F.lit(name).alias("form"), w.alias("w")) for name, w in forms.items()])).alias("q")).select("row", "q.form", "q.w")
    heard = asked.join(words, "w").groupBy("row").agg(*[F.max(F.when(F.col("form") == name, F.col("n"))).alias(name) for name in forms])
    p = pairs.join(heard, "row", "left")
    for name in forms:
        p = p.withColumn(name, F.log1p(F.coalesce(name, F.lit(0))))
    return p.withColumn("short_a", F.length("a").cast("double")).withColumn("short_b", F.length("b").cast("double"))


def cut_words(text_lines: DataFrame, words: DataFrame) -> DataFrame:
    """Line pairs of which the first ends in a hyphen: (origin, item_id, line_no, next_item, next_no, a, b, cut)."""
    page = Window.partitionBy("origin", "doc", "page").orderBy("ord", "item_id", "line_no")
    here = F.struct("item_id", "line_no", F.regexp_extract(F.trim("line"), rf"^[^\p{{L}}\p{{N}}]{{0,3}}({TOKEN})", 1).alias("b"))
    lines = text_lines.withColumn("next", F.lead(here).over(page)).withColumn("rn", F.row_number().over(page))
    first = lines.filter("rn = 1").select("origin", "doc", F.col("page").alias("p"), here.alias("opens"))
    ends = lines.filter(F.col("line").rlike(rf"[\p{{L}}\p{{N}}]{CUT}\s*$"))
    for ahead in (1, 2):
        ends = ends.join(first.select("origin", "doc", (F.col("p") - ahead).alias("page"), F.col("opens").alias(f"o{ahead}")), ["origin", "doc", "page"], "left")
    ends = ends.withColumn("next", F.coalesce("next", "o1", "o2"))
    ends = ends.select("origin", "item_id", "line_no", F.col("next.item_id").alias("next_item"), F.col("next.line_no").alias("next_no"), F.regexp_extract("line", rf"({TOKEN}){CUT}\s*$", 1).alias("raw_a"), F.col("next.b").alias("raw_b"), F.regexp_extract("line", rf"({CUT})\s*$", 1).alias("mark"))
    ends = ends.withColumn("a", F.lower("raw_a")).withColumn("b", F.lower(F.coalesce("raw_b", F.lit("")))).withColumn("capital", F.coalesce(F.col("raw_b").rlike(r"^\p{Lu}"), F.lit(False)).cast("double"))
    ends = ends.withColumn("soft", F.col("mark").isin(*SOFT).cast("double")).withColumn("row", F.concat_ws("\n", "origin", "item_id", "line_no"))
    # Weak labels: words of the library cut somewhere, half of them by a mark that only cuts, against first parts of its compounds before whole words.
    known = words.filter((F.length("w") >= 6) & (F.col("n") >= KNOWN) & ~F.col("w").endswith("-") & ~F.col("w").rlike(r"\d"))
    at = F.lit(2) + F.pmod(F.xxhash64("w"), F.length("w") - 3).cast("int")
    order = F.xxhash64("w", F.lit(3))
    yes = known.orderBy(order).limit(SAMPLE).select(F.substr("w", F.lit(1), at).alias("a"), F.substr("w", at + 1).alias("b"), F.lit(0.0).alias("capital"), F.pmod(F.xxhash64("w", F.lit(5)), F.lit(2)).cast("double").alias("soft"), F.lit(1.0).alias("y"))
    parts = words.filter(F.col("w").endswith("-") & (F.col("n") >= 1)).orderBy(F.col("n").desc(), "w").limit(SAMPLE // 2).select(F.expr("substring(w, 1, length(w) - 1)").alias("a"), F.row_number().over(Window.orderBy("w")).alias("k"))
    whole = known.orderBy(F.xxhash64("w", F.lit(4))).limit(SAMPLE // 2).select(F.col("w").alias("b"), F.row_number().over(Window.orderBy("w")).alias("k"))
    no = parts.join(whole, "k").select("a", "b", (F.pmod(F.col("k"), F.lit(3)) == 0).cast("double").alias("capital"), F.lit(0.0).alias("soft"), F.lit(0.0).alias("y"))
    ends = staged(ends, "line-ends")
    drawn = yes.unionByName(no).withColumn("row", F.concat_ws("\n", F.lit("drawn"), "a", "b", "y"))
    both = staged(_pair_features(ends.unionByName(drawn, allowMissingColumns=True), words), "line-pairs")
    model = _fitted(both, PAIR, F.col("y"), F.xxhash64("a", "b"))
    scored = _scored(both.filter("y IS NULL"), PAIR, model, "p_cut")
    return scored.select("origin", "item_id", "line_no", "next_item", "next_no", "a", "b", (F.col("p_cut") >= 0.5).alias("cut"))


def _grams(word: Column) -> Column:
    padded = F.concat(F.lit("##"), word, F.lit("#"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


RANK = ["equal", "shared", "edits", "folded_edits", "heard", "own", "longer", "size", "digit", "first_same"]


def candidates(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked: (kind, w, own). Known words that share OVERLAP of the folded 3-grams, found through the rarest grams of each word asked for only."""
    k = known.select(F.col("w").alias("c"), F.col("n").alias("heard"), folded(F.col("w")).alias("fc"))
    posting = k.select("c", "heard", "fc", F.explode(_grams(F.col("fc"))).alias("g"))
    freq = posting.groupBy("g").agg(F.count("*").alias("df"))
    r = asked.withColumn("fw", folded(F.col("w"))).withColumn("gw", _grams(F.col("fw")))
    probes = r.select("kind", "w", "own", "fw", F.size("gw").alias("m"), F.explode_outer("gw").alias("g")).join(freq, "g")
    place = F.row_number().over(Window.partitionBy("kind", "w").orderBy("df", "g"))
    probes = probes.withColumn("place", place).filter(F.col("place") <= F.col("m") - F.ceil(F.col("m") * OVERLAP) + 1).drop("m", "df", "place")
    near = (F.abs(F.length("fw") - F.length("fc")) <= 3) & (F.col("w") != F.col("c")) & (F.col("own") <= MISREAD_SHARE * F.col("heard"))
    met = probes.join(posting, "g").filter(near).groupBy("kind", "w", "own", "fw", "c", "heard", "fc").agg(F.count("*").alias("times"))
    met = met.filter(F.when(F.col("times") > 0, F.levenshtein("fw", "fc", 3)) >= 0)  # tied to the count, so it isn't worked out for each shared gram
    both = F.array(F.struct(_grams(F.col("fw")).alias("gw"), _grams(F.col("fc")).alias("gc")))
    counted = F.transform(both, lambda s: F.struct(F.size(F.array_intersect(s["gw"], s["gc"])).alias("together"), F.greatest(F.size(s["gw"]), F.size(s["gc"])).alias("most")))
    kept = F.filter(counted, lambda s: s["together"] >= F.ceil(s["most"] * OVERLAP))  # one expression, so the 3-grams are worked out once
    x = met.select("*", F.explode(kept).alias("s")).select("*", "s.together", "s.most")
    return x.select(
        "kind",
        "w",
        "c",
        (F.col("fw") == F.col("fc")).cast("double").alias("equal"),
        (F.col("together") / F.col("most")).alias("shared"),
        F.levenshtein("w", "c").cast("double").alias("edits"),
        F.levenshtein("fw", "fc").cast("double").alias("folded_edits"),
        F.log1p("heard").alias("heard"),
        F.log1p("own").alias("own"),
        (F.length("w") - F.length("c")).cast("double").alias("longer"),
        F.length("w").cast("double").alias("size"),
        F.col("w").rlike(r"\d").cast("double").alias("digit"),
        (F.substring("w", 1, 1) == F.substring("c", 1, 1)).cast("double").alias("first_same"),
    )


def _spoilt(words: DataFrame) -> DataFrame:
    """Words of the library with one confusion each, the first from a hashed one on that the word has room for: (source, w)."""

    @F.pandas_udf("string")
    def spoil(word: pd.Series, pick: pd.Series) -> pd.Series:
        def one(w: str, k: int) -> str | None:
            for right, wrong in CONFUSIONS[k:] + CONFUSIONS[:k]:
                if right in w:
                    return w.replace(right, wrong, 1)
            return None

        return pd.Series([one(w, int(k)) for w, k in zip(word, pick)])

    pick = F.pmod(F.xxhash64("w", F.lit(9)), F.lit(len(CONFUSIONS)))
    return words.select(F.col("w").alias("source"), spoil(F.col("w"), pick).alias("w")).filter("w IS NOT NULL AND w <> source")


def corrections(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """tokens: (w). The best replacement of each misread word: (w, c, p)."""
    total = words.agg(F.sum("n")).first()[0] or 0
    known = words.filter((F.col("n") >= max(KNOWN, KNOWN_SHARE * total)) & (F.length("w") >= 3) & ~F.col("w").endswith("-") & ~F.col("w").rlike(r"\d"))
    known = staged(known, "known-words")
    rare = _counted(tokens.select("w").distinct(), words, "w", "own").filter((F.col("own") < max(KNOWN, RARE_SHARE * total)) & (F.length("w") >= 3) & F.col("w").rlike(r"\p{L}"))
    # Weak labels: spoilt words against their sources; and words that only look alike.
    drawn = known.filter(F.col("n") >= 2 * KNOWN).orderBy(F.xxhash64("w", F.lit(7))).limit(WORDS)
    bad = staged(_spoilt(drawn), "spoilt-words")
    asked = rare.select(F.lit("met").alias("kind"), "w", F.col("own").cast("long").alias("own"))
    for kind, ws in (("spoilt", bad.select("w").distinct()), ("alike", drawn.select("w"))):
        asked = asked.unionByName(ws.select(F.lit(kind).alias("kind"), "w", F.lit(0).cast("long").alias("own")))
    found = staged(candidates(staged(asked, "asked-words"), known), "candidates")
    spoilt = found.filter("kind = 'spoilt'").join(bad, "w").withColumn("y", (F.col("c") == F.col("source")).cast("double")).drop("source")
    taught = spoilt.unionByName(found.filter("kind = 'alike'").withColumn("y", F.lit(0.0)))
    model = _fitted(taught, RANK, F.col("y"), F.xxhash64("w", "c"))
    scored = _scored(found.filter("kind = 'met'"), RANK, model, "p")
    return scored.groupBy("w").agg(F.max(F.struct("p", "heard", "c")).alias("best")).select("w", F.col("best.c").alias("c"), F.col("best.p").alias("p")).filter("p >= 0.5")


def defects(files: DataFrame, blocks: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines with their furniture flag, cut line pairs, misread tokens with their correction)."""
    lines = staged(furniture(scanned_lines(files, blocks, chunks)), "scanned-lines")
    words = staged(lexicon(files, blocks, chunks), "lexicon")
    text = lines.filter("furniture < 0.5")
    cuts = staged(cut_words(text, words), "cut-words").filter("cut")
    # Tokens of a line, without the halves of cut words; joined words stand for their first line.
    halves = cuts.select("origin", "item_id", "line_no", F.lit(True).alias("head_cut"))
    tails = cuts.filter("next_item IS NOT NULL").select("origin", F.col("next_item").alias("item_id"), F.col("next_no").alias("line_no"), F.lit(True).alias("tail_cut")).distinct()
    key = ["origin", "item_id", "line_no"]
    marked = _looked_up(_looked_up(text, halves, key), tails, key)
    plain = F.when(F.col("head_cut"), F.regexp_replace("line", rf"{TOKEN}{CUT}\s*$", "")).otherwise(F.col("line"))
    plain = F.when(F.col("tail_cut"), F.regexp_replace(plain, rf"^[^\p{{L}}\p{{N}}]{{0,3}}{TOKEN}", "")).otherwise(plain)
    plain = F.replace(F.replace(F.lower(plain), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    spoilt = F.when(F.col("plain").rlike(r"[0-9][0-9.,]*[lo]|[lo][lo.,]*[0-9]"), F.regexp_extract_all("plain", F.lit(f"({SPOILT_NUMBER})"), F.lit(1)))
    words_of = F.array_distinct(F.regexp_extract_all("plain", F.lit(TOKEN), F.lit(0)))
    read = staged(marked.select(*key, plain.alias("plain")).select(*key, words_of.alias("ws"), spoilt.alias("ns")), "line-words")
    numbers = read.select(*key, F.explode("ns").alias("w")).withColumn("c", F.translate("w", "lo", "10"))
    tokens = read.select(*key, F.explode("ws").alias("w"))
    letters = _counted(tokens.filter(F.col("w").rlike("^[lo]{2,4}$")), words, "w", "n").filter(F.col("n") < KNOWN)  # numbers read as letters only
    numbers = numbers.unionByName(letters.select("origin", "item_id", "line_no", "w", F.translate("w", "lo", "10").alias("c")))
    joined = cuts.filter("next_item IS NOT NULL").select("origin", "item_id", "line_no", "next_item", "next_no", "a", F.concat("a", "b").alias("w"))
    better = staged(corrections(tokens.select("w").unionByName(joined.select("w")), words), "corrections").select("w", "c")
    better = _few(better)
    whole = tokens.join(better, "w").select("origin", "item_id", "line_no", "w", "c")
    behind = F.substr("c", F.lit(1), F.length("a")) == F.col("a")  # the first half is right, so the second is not
    split = joined.join(better, "w").select("origin", F.when(behind, F.col("next_item")).otherwise(F.col("item_id")).alias("item_id"), F.when(behind, F.col("next_no")).otherwise(F.col("line_no")).alias("line_no"), "w", "c")
    return lines, cuts, whole.unionByName(split).unionByName(numbers).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defects of every line."""
    lines, cuts, misread = defects(*[table(spark, sf_dir, t) for t in ("files", "blocks", "chunks")])
    parts = [
        lines.filter("furniture >= 0.5").select("origin", "item_id", "line_no", F.lit("furniture").alias("defect")),
        cuts.select("origin", "item_id", "line_no", F.lit("hyphen").alias("defect")),
        misread.select("origin", "item_id", "line_no", F.lit("misread").alias("defect")).distinct(),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("line_no", F.col("line_no").cast("int"))


def repaired(lines: DataFrame, cuts: DataFrame, misread: DataFrame) -> DataFrame:
    """(origin, doc, page, text, goes_on): each page without furniture, words joined and put right, paragraphs parted by
    a blank line. `goes_on`: the page ends within a sentence, so its last paragraph goes on on the next page."""
    key = ["origin", "item_id", "line_no"]
    better = staged(misread.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("w", "c"))).alias("fixes")), "fixes")  # of one line
    heads = cuts.filter("next_item IS NOT NULL").select(*key, "b", F.lit(True).alias("head_cut"))
    tails = cuts.filter("next_item IS NOT NULL").select("origin", F.col("next_item").alias("item_id"), F.col("next_no").alias("line_no"), F.lit(True).alias("tail_cut")).distinct()
    x = lines.filter("furniture < 0.5")
    for facts in (better, heads, tails):
        x = _looked_up(x, facts, key)
    text = F.rtrim("line")
    text = F.when(F.col("tail_cut"), F.regexp_replace(text, rf"^[^\p{{L}}\p{{N}}]{{0,3}}{TOKEN}", "")).otherwise(F.ltrim(text))
    text = F.when(F.col("head_cut"), F.concat(F.regexp_replace(text, rf"{CUT}\s*$", ""), "b")).otherwise(text)

    def put_right(done: Column, fix: Column) -> Column:
        word = lambda w: F.concat(F.lit(r"(?<![\p{L}\p{N}])"), w, F.lit(r"(?![\p{L}\p{N}])"))
        lower = F.regexp_replace(done, word(fix["w"]), fix["c"])
        return F.regexp_replace(lower, word(F.initcap(fix["w"])), F.initcap(fix["c"]))

    none = F.array().cast("array<struct<w:string,c:string>>")
    x = x.withColumn("text", F.aggregate(F.coalesce("fixes", none), text, put_right))
    order = Window.partitionBy("origin", "doc", "page").orderBy("ord", "item_id", "line_no")
    gap = (F.lag("item_id").over(order) == F.col("item_id")) & (F.col("line_no") > F.lag("line_no").over(order) + 1)
    hyphen = F.lag("line").over(order).rlike(r"\p{L}-\s*$")  # a compound's own
    part = F.when(F.col("tail_cut") | hyphen, F.lit("")).when(gap, F.lit("\n\n")).when(F.lag("line_no").over(order).isNull(), F.lit("")).otherwise(F.lit(" "))
    placed = x.withColumn("text", F.concat(part, "text"))
    rows = F.sort_array(F.collect_list(F.struct("ord", "item_id", "line_no", "text")))  # the lines of one page
    pages = placed.groupBy("origin", "doc", "page").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "").alias("text"))
    return pages.withColumn("goes_on", ~F.rtrim("text").rlike(r"[.!?:»”\"]$"))


def p3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired text of every scanned page."""
    return repaired(*defects(*[table(spark, sf_dir, t) for t in ("files", "blocks", "chunks")]))


QUERIES = {"p3_found": p3_found, "p3_pages": p3_pages}
SQL: dict[str, str] = {}
