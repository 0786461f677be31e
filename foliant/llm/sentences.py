"""Sentence boundaries across languages and scripts, in SQL expressions only.

Marks that end no sentence (decimals, versions, file names, addresses, abbreviations, initials, ordinals, quoted
sentences that their sentence goes on after) are masked by private-use placeholders of the same length; regular
expressions for the scripts' end marks, and for lines that are units by themselves, then insert a separator; the text
is split there and the marks are put back. Since masks keep lengths, offsets are those of the given text.

Everything is a chain of built-in expressions over one row: the ends of the pieces are running sums over the array of
pieces, in runs of RUN, so their cost grows with the text and nothing is shuffled. (The queries drop repeated rows, which
is one shuffle of what they return.)

Defined results: null, empty and blank texts have no unit; repeated rows give repeated units (the query drops them);
the code points U+E001 to U+E00F, should a text hold them, count as ordinary characters of their unit and are shown as
U+FFFD. Columns of the input that bear an output's name are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.tables import table

# Marks and their placeholders.
MARKS = ".!?。！？…।؟۔։።॥။"
MASKS = "\uE001\uE002\uE003\uE004\uE005\uE006\uE007\uE008\uE009\uE00A\uE00B\uE00C\uE00D\uE00E"
DOT, CUT = "\uE001", "\uE00F"

# Abbreviations that always go on; those that go on before a number; the months after a German ordinal.
# A dot in one stands for any character.
ALWAYS = "dr mr mrs prof sr sra srta mme mlle cf vs vgl bzw al approx aprox ca ex ej e.g i.e c.-à-d resp डॉ st rev capt incl bspw ggf evtl inkl dra"
NUMBERED = "no nos nr núm fig figs eq eqs éq sec secs abb kap vol p pp ch chap art tab bd"
MONTHS = "januar|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember"

THAI = r"฀-๿"
UNIT_LINE = r"(?:[-*•–·][ \t]|#{1,6}[ \t])"


def _mask_where(condition: str, marks: str):
    """A step that masks each of `marks` at which `condition` (what follows the mark) holds."""

    def step(text: Column) -> Column:
        for mark, mask in zip(MARKS, MASKS):
            if mark in marks:
                text = F.regexp_replace(text, ("\\" + mark if mark in ".?" else mark) + condition, mask)
        return text

    return step


def _where(holds: str, step):
    """`step`, on the texts that contain `holds` only."""
    return lambda text: F.when(F.contains(text, F.lit(holds)), step(text)).otherwise(text)


def _replace(pattern: str, by: str):
    return lambda text: F.regexp_replace(text, pattern, by)


def _thai(text: Column) -> Column:
    lines = F.regexp_replace(text, rf"(?m)^([^\n]*[{THAI}][^\n]*?)(?=[ \t{CUT}]*$)", "$1" + CUT)
    spaces = F.regexp_replace(lines, rf"(?:(?<=[{THAI}])[ \t]+(?![0-9%A-Za-z\s])|(?<![0-9%A-Za-z\s•*#>–·{CUT}-])[ \t]+(?=[{THAI}]))", CUT + "$0")
    return F.when(text.rlike(f"[{THAI}]"), spaces).otherwise(text)


def _unit_lines(text: Column) -> Column:
    """Masks all marks but the last ones within lines that are units, whatever the lines' length."""

    def masked(line: Column) -> Column:
        end = F.regexp_extract(line, rf"[{MARKS}]?\s*+$", 0)
        inner = F.substr(line, F.lit(1), F.length(line) - F.length(end))
        return F.when(line.rlike(rf"^[ \t]*{UNIT_LINE}"), F.concat(F.translate(inner, MARKS, MASKS), end)).otherwise(line)

    return F.array_join(F.transform(F.split(text, r"(?<=[\n\r\u0085\u2028\u2029])", -1), masked), "")


def _quoted(quotes: str, marks: str, *ends: tuple[str, str]):
    """A step that masks `marks` wherever the next of `quotes` ends its piece of text as one of `ends` says: (the piece's end, what the next piece begins with). One pass, whatever the length of a quoted passage."""
    masks = "".join(MASKS[MARKS.index(m)] for m in marks)

    def step(text: Column) -> Column:
        pieces = F.split(text, f"(?<=[{quotes}])", -1)

        def masked(piece: Column, i: Column) -> Column:
            after = F.coalesce(F.get(pieces, i + 1), F.lit(""))
            goes_on = F.lit(False)
            for end, begin in ends:
                goes_on = goes_on | (piece.rlike(end + r"\z") & after.rlike("^" + begin))
            return F.when(goes_on, F.translate(piece, marks, masks)).otherwise(piece)

        return F.array_join(F.transform(pieces, masked), "")

    return step


def _after(words: str) -> str:
    """What holds behind the dot of one of the words. Words of one length share a look back, so each looks at one place only."""
    by: dict[int, list[str]] = {}
    for w in words.split():
        by.setdefault(len(w), []).append(w)
    return "(?:" + "|".join(rf"(?<=(?<![\p{{L}}\p{{N}}])(?i:{'|'.join(ws)})\.)" for _, ws in sorted(by.items())) + ")"


# Each pattern begins with the mark it is about, and looks back from there: a scan then stops only at marks.
STEPS = [
    _replace(r"[\uE001-\uE00F]", "\ufffd"),
    _where(">", lambda t: F.regexp_replace(F.regexp_replace(t, r"(?m)^>>[ ]", "   "), r"(?m)^>[ ]", "  ")),
    _replace(r"\.(?=[\p{L}\p{N}])(?<=[\p{L}\p{N}]\.)", DOT),  # decimals, versions, file names, addresses
    _where("?", _replace(r"\?(?=[A-Za-z0-9=&])(?<=\S\?)", "\uE003")),
    _replace(r"\." + _after(ALWAYS), DOT),
    _replace(r"\.(?=\s*[\d(])" + _after(NUMBERED), DOT),
    _replace(r"\.(?=\s)(?<=(?<![\p{L}\p{N}\p{M}'’])(?<![\d%]\s{1,4})\p{L}\.)", DOT),  # initials; after a number a letter is a unit
    _replace(rf"\.(?=\s{{1,4}}(?i:{MONTHS})\b)(?<=\d\.)", DOT),
    _replace(r"\.(?=[ \t])(?<=(?:^|\n[ \t]{0,8}\n)[ \t]{0,8}\d{1,3}\.)", DOT),  # numbers of headings
    lambda t: F.when(t.rlike(rf"(?m)^[ \t]*{UNIT_LINE}"), _unit_lines(t)).otherwise(t),
    _where("...", _replace(r"\.\.\.(?=\s)(?<=\s\.\.\.)", DOT * 3)),
    # Quoted sentences that are followed by the rest of their sentence.
    _where(',"', _quoted('"', ".!?।…", (',"', ""))),
    _where("»", _quoted("«»", ".!?…", ("»", r"\s{0,2},"))),
    _where("„", _quoted("„“”", ".!?…", ("[“”]", ","))),
    _where("”", _quoted("“”", ".!?。！？…", (",”", ""), ("”", r"[^。！？“”]{1,80}?(?:写|問|问|说|説|答)\s?道?\s?[。，]"))),
    _where("」", _quoted("「」", "。！？.!?…", ("」", r"\s?(?:と|って)"))),
    _where('" ', _mask_where(r'(?="\s{1,4}(?i:and|or|but|wrote|said|asked)\b)', ".!?")),
]
CUTS = [
    # Lines that are units, and the ends of paragraphs.
    _replace(rf"(?m)^[ \t]*{UNIT_LINE}[^\n]*?(?=[ \t]*$)", "$0" + CUT),
    _replace(rf"[ \t]*\n(?=[ \t]*(?:\n|{UNIT_LINE}))", CUT + "$0"),
    _thai,
    # End marks: wide ones anywhere; others before white space, unless a lower-case word goes on in the paragraph.
    _replace(r"[。！？]+(?:\s?[”’」』）》】〉]|[\"'»)\]])*", "$0" + CUT),
    _where("।", _replace(r"[।॥]+[\"'”’»)\]]*(?=\s|$)", "$0" + CUT)),
    _where("॥", _replace(r"[।॥]+[\"'”’»)\]]*(?=\s|$)", "$0" + CUT)),  # those of a text without the other
    _replace(rf"[.!?…؟۔։።။]+(?:[\"'”’»)\]“*_]|[\u00A0\u202F ]»)*(?=[\s{CUT}]|$)(?![ \t]*\n?[ \t]*[*_]*\p{{Ll}}(?!\p{{Lu}}))", "$0" + CUT),
]


def marked(df: DataFrame, name: str) -> DataFrame:
    """The column `name` masked, and with a separator after each unit; a projection a step, so that no step is worked out twice."""
    for step in STEPS + CUTS:
        df = df.withColumn(name, step(F.col(name)))
    return df


OUT = ("sent_no", "sent_start", "sent_end", "sentence")
RUN = 64  # pieces that are added up at a time
BLANK = " \t\n\x0b\f\r"


def _running(sizes: Column) -> Column:
    """Running sums of an array, RUN values at a time: what is before a run is carried on."""

    def more(done: Column, run: Column) -> Column:
        part = F.slice(sizes, run * RUN + 1, RUN)
        here = F.transform(part, lambda _, i: done["upto"] + F.aggregate(F.slice(part, 1, i + 1), F.lit(0), lambda n, x: n + x))
        return F.struct(F.element_at(here, -1).alias("upto"), F.concat(done["sums"], here).alias("sums"))

    none = F.struct(F.lit(0).alias("upto"), F.array().cast("array<int>").alias("sums"))
    return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / RUN).cast("int")), none, more)["sums"]


def _pieces(df: DataFrame, text: str) -> tuple[DataFrame, list[str], Column]:
    """The rows with an array of (piece, its end), and the other columns' names."""
    rest = [c for c in df.columns if c not in (text, *OUT)]
    rows = df.filter(F.length(text) > 0).select(*rest, F.col(text).alias("__t"))
    cut = marked(rows, "__t").select(*rest, F.split("__t", CUT).alias("__p"))
    sized = cut.withColumn("__z", F.transform("__p", F.length))
    ended = sized.select(*rest, F.arrays_zip(F.col("__p").alias("s"), _running(F.col("__z")).alias("e")).alias("__u"))
    return ended, rest, F.filter("__u", lambda u: F.length(F.trim(u["s"], F.lit(BLANK))) > 0)


def sentence_ends(df: DataFrame, text: str = "text") -> DataFrame:
    """One row a unit: the other columns of `df`, and sent_end."""
    pieces, rest, units = _pieces(df, text)
    ends = F.transform(units, lambda u: (u["e"] - F.length(u["s"]) + F.length(F.rtrim(u["s"], F.lit(BLANK)))).cast("long"))
    return pieces.select(*rest, F.explode(ends).alias("sent_end"))


def sentences(df: DataFrame, text: str = "text") -> DataFrame:
    """One row a unit: the other columns of `df`, and sent_no, sent_start, sent_end, sentence (offsets in code points)."""
    pieces, rest, units = _pieces(df, text)

    def unit(u: Column) -> Column:
        s = u["s"]
        begin, end = u["e"] - F.length(F.ltrim(s, F.lit(BLANK))), u["e"] - F.length(s) + F.length(F.rtrim(s, F.lit(BLANK)))
        return F.struct(begin.cast("long").alias("sent_start"), end.cast("long").alias("sent_end"), F.translate(F.trim(s, F.lit(BLANK)), MASKS, MARKS).alias("sentence"))

    return pieces.select(*rest, F.posexplode(F.transform(units, unit)).alias("n", "u")).select(*rest, (F.col("n") + 1).alias("sent_no"), "u.*")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of all units."""
    return sentence_ends(table(spark, sf_dir, "documents").select("doc_id", "text")).distinct()


def p8_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units themselves."""
    return sentences(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).dropDuplicates(["doc_id", "sent_end"])


QUERIES = {"p8_found": p8_found, "p8_sentences": p8_sentences}
SQL: dict[str, str] = {}
