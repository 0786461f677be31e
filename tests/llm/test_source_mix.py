import pytest

from foliant.llm.source_mix import copy_counts, cut_poisson, mix, mix_rates, mix_report, sized_documents


@pytest.mark.parametrize("rate,cap", [(0.3, 1), (0.9, 1), (1.7, 4), (3.9, 4), (0.0, 3), (800.0, 1000)])
def test_cut_distribution_keeps_its_mean(rate, cap):
    below = cut_poisson(rate, cap)
    assert abs(cap - sum(below) - rate) < 1e-3 * max(1, rate)


def tables(spark):
    docs = [(i, "word " * 40, "A " if i % 3 else "b") for i in range(6000)] + [(9000, None, "a"), (9001, "  ", "a"), (9002, "x", None), (9003, "y", "unlisted"), (0, "word " * 40, "b")]
    targets = [("a", 1.0, 3), ("B", 3.0, 2), ("empty", 1.0, 5), (None, 9.0, 1), ("zero", None, 2), ("nan", float("nan"), None)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(targets, "source string, weight double, max_repeats int")


def test_shares_are_met_or_capped(spark):
    docs, targets = tables(spark)
    got = {r["source"]: r for r in mix_report(docs, targets).collect()}
    assert set(got) == {"a", "B", "empty", "zero", "nan"}
    assert got["empty"]["capped"] and got["empty"]["mixed_size"] == 0 and not got["a"]["capped"]
    a, b = got["a"], got["B"]
    assert abs(a["mixed_size"] / (0.2 * (a["size"] + b["size"])) - 1) < 0.05
    assert abs(b["mixed_size"] / (0.6 * (a["size"] + b["size"])) - 1) < 0.05 and b["most_copies"] <= 2
    assert abs(sum(r["reached_share"] for r in got.values()) - 1) < 1e-6


def test_draws_repeat_and_copies_come_out(spark):
    docs, targets = tables(spark)
    sized = sized_documents(docs)
    rates = mix_rates(sized, targets)
    one, two = (sorted(map(tuple, copy_counts(sized, rates).select("doc_id", "copies").collect())) for _ in range(2))
    assert one == two and len(one) == len({d for d, _ in one})
    mixed = mix(docs, targets).collect()
    assert len(mixed) == sum(c for _, c in one) and [r["place"] for r in mixed] == sorted(r["place"] for r in mixed)
    assert mix(docs.limit(0), targets).count() == 0 and mix_report(docs, targets.limit(0)).count() == 0
