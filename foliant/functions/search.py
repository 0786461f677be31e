"""Tokens and query terms of lexical search, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with one mark and the letters they stand for in search.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def fold(text: Column) -> Column:
    """Case-folded, with single Latin marks removed."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text, in order."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(query: Column) -> Column:
    """Terms between white space; each stands for the phrase of its tokens."""
    return F.filter(F.split(F.trim(F.regexp_replace(query, r"[\t\n\f\r ]+", " ")), " "), lambda t: t != "")


def han_runs(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{IsHan}+"), F.lit(0))


def _grams(run: Column, n: int) -> Column:
    return F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda i: F.substr(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def han_index_terms(text: Column) -> Column:
    """Every Han character and every pair of neighbours of each run."""
    return F.flatten(F.transform(han_runs(text), lambda r: F.concat(_grams(r, 1), _grams(r, 2))))


def han_bigrams(text: Column) -> Column:
    return F.flatten(F.transform(han_runs(text), lambda r: _grams(r, 2)))


def han_query_terms(query: Column) -> Column:
    """Pairs of a run of two or more Han characters, the character of a run of one, and other runs of letters and digits."""
    runs = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"\p{IsHan}+|[\p{L}\p{N}_&&[^\p{IsHan}]]+"), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"^\p{IsHan}"), F.when(F.length(r) > 1, _grams(r, 2)).otherwise(F.array(r))).otherwise(F.array(r))))
