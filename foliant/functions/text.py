"""Column functions over text. All are built-in expressions and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as one token each.
WIDE = r"㐀-鿿豈-﫿぀-ヿ가-힯"
# Fixed value: the white space that patterns below treat as such (ASCII, without the vertical tab).
BLANK = r"[\t\n\f\r ]"


def token_estimate(text: Column) -> Column:
    """Wide code points count 1 each, the others together a quarter rounded up; at least 1; null for null."""
    wide = F.regexp_count(text, F.lit(f"[{WIDE}]"))
    return F.when(text.isNotNull(), F.greatest(F.lit(1), wide + F.floor((F.length(text) - wide + 3) / 4))).cast("int")


def squeeze(text: Column) -> Column:
    """Each run of white space becomes one space; ends trimmed."""
    return F.trim(F.regexp_replace(text, BLANK + "+", " "))


def short_hash(text: Column) -> Column:
    """The first 12 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 12)


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def heading(title: Column, section: Column) -> Column:
    """`title > section`, of the parts that are not empty."""
    return F.concat_ws(" > ", F.nullif(title, F.lit("")), F.nullif(section, F.lit("")))


def normal_doi(doi: Column) -> Column:
    """Lower-cased DOI without resolver address, `doi:` mark and closing punctuation; null where none is left."""
    bare = F.regexp_extract(F.lower(F.trim(doi)), r"(10\.\d{4,9}/\S+)", 1)
    return F.nullif(F.regexp_replace(bare, r"[\s.,;]+$", ""), F.lit(""))


def year_of(text: Column) -> Column:
    """The first free-standing four-digit year from 1000 to 2999, else null."""
    return F.nullif(F.regexp_extract(text, r"(?:^|\D)([12][0-9]{3})(?:\D|$)", 1), F.lit("")).cast("int")
