import pytest
from pyspark.sql import functions as F

from foliant.functions import search, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("value,want", [("", 1), ("abcd", 1), ("abcde", 2), ("漢字", 2), ("漢字ab", 3), (None, None)])
def test_token_estimate(spark, value, want):
    assert one(spark, value, text.token_estimate) == want


@pytest.mark.parametrize("value,want", [("https://doi.example/10.5550/Ab.1.", "10.5550/ab.1"), ("DOI: 10.1234/x", "10.1234/x"), ("none", None), (None, None)])
def test_normal_doi(spark, value, want):
    assert one(spark, value, text.normal_doi) == want


@pytest.mark.parametrize("value,want", [("Spring 2009", 2009), ("c. 1850", 1850), ("12345", None), ("", None)])
def test_year(spark, value, want):
    assert one(spark, value, text.year_of) == want


def test_han_terms(spark):
    assert one(spark, "量测a场", search.han_index_terms) == ["量", "测", "量测", "场"]
    assert one(spark, "量测场 kalman 谱", search.han_query_terms) == ["量测", "测场", "kalman", "谱"]
    assert one(spark, "Naïve x_1", search.tokens) == ["naive", "x", "1"]
