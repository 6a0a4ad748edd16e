import pytest

from cohortloom.operators.balance import balance
from cohortloom.operators.impute import complete, impute
from cohortloom.operators.membership import classify, describe, filter_members, label
from cohortloom.plans.identities import IDENTITIES


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def abcd(spark):
    data = [("A", y) for y in range(2019, 2024)] + [("B", y) for y in range(2021, 2024)] + [("C", y) for y in range(2019, 2022)] + [("D", 2019), ("D", 2023)]
    return spark.createDataFrame([(o, y, i) for i, (o, y) in enumerate(data)] + [(None, 2020, 99), ("A", 2019, 100)], "ORG string, YEAR int, value int")


def test_classify(abcd):
    got = {r["ORG"]: r for r in classify(abcd, "YEAR", "ORG").collect()}
    assert {k: (r.panel_type, r.panel_spell) for k, r in got.items()} == {
        "A": ("persistent", "seamless"), "B": ("entrant", "seamless"), "C": ("exit", "seamless"), "D": ("persistent", "segmented")}
    assert (got["D"].panel_gap_count, got["D"].panel_gap_size_max, got["D"].panel_year_count) == (1, 3, 2)
    assert (got["A"].panel_gap_count, got["A"].panel_gap_size_max) == (0, 0)


def test_gap_needs_an_observed_year(spark):
    df = spark.createDataFrame([("A", 2019), ("A", 2021), ("B", 2019)], "id string, t int")
    assert {r.panel_spell for r in classify(df, "t", "id").collect()} == {"seamless"}


def test_describe_label_filter(abcd):
    s = describe(abcd, "YEAR", "ORG")
    assert (s.n_orgs, s.n_years, s.years) == (4, 5, [2019, 2020, 2021, 2022, 2023])
    assert rows(s.by_type(), "panel_type", "seamless", "segmented", "total", "pct") == [
        ("entrant", 1, 0, 1, 25.0), ("exit", 1, 0, 1, 25.0), ("persistent", 1, 1, 2, 50.0)]
    by_year = s.by_year()
    assert by_year.columns == ["year", "persistent", "entrant", "exit"]
    assert rows(by_year, "year", "persistent", "exit")[0] == (2019, 2, 1)
    labelled = label(label(abcd, "YEAR", "ORG"), "YEAR", "ORG")
    assert labelled.count() == abcd.count() and labelled.where("ORG is null and panel_type is null").count() == 1
    assert {r.ORG for r in filter_members(abcd, min_obs=3, time="YEAR", id="ORG").collect()} == {"A", "B", "C"}
    assert {r.ORG for r in filter_members(abcd, "persistent", "segmented", time="YEAR", id="ORG").collect()} == {"D"}
    with pytest.raises(ValueError):
        filter_members(abcd, "steady", time="YEAR", id="ORG")


def test_balance(spark):
    data = [(o, y) for o in "AB" for y in range(2019, 2023)] + [("C", y) for y in range(2019, 2022)] + [("D", 2019), ("D", 2020)]
    df = spark.createDataFrame(data, "EIN2 string, TAX_YEAR int")
    b = balance(df)
    assert (b.df.count(), b.orgs_kept, b.orgs_dropped, b.years) == (8, 2, 2, [2019, 2020, 2021, 2022])
    assert balance(df, years=range(2019, 2022)).orgs_kept == 3
    r = balance(df, strategy="max_rectangle")
    assert (r.years, r.orgs_kept, r.df.count()) == ([2019, 2020, 2021], 3, 9)
    two = spark.createDataFrame([("A", 2019), ("B", 2020)], "EIN2 string, TAX_YEAR int")
    assert (balance(two).df.count(), balance(two).orgs_kept) == (0, 0)
    with pytest.raises(ValueError):
        balance(two, strategy="max_rectangle", min_years=3)


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame([("A", 2020, 0.0), ("A", 2023, 30.0), *[("F", y, 1.0) for y in range(2020, 2024)]], "EIN2 string, TAX_YEAR int, amount double")


@pytest.mark.parametrize("method, want", [("interpolate", [10, 20]), ("mean", [15, 15]), ("locf", [0, 0]), ("nocb", [30, 30])])
def test_complete_methods(gaps, method, want):
    got = complete(gaps, method=method).where("imputed_row")
    assert [r[1] for r in rows(got, "TAX_YEAR", "amount")] == want


def test_impute_limits_and_types(spark, gaps):
    assert impute(gaps, max_gap_size=1).where("imputed_row").count() == 0
    assert impute(gaps).count() == 8
    tail = spark.createDataFrame([("A", 2022, 1.0), ("A", 2023, 2.0), *[("B", y, 1.0) for y in range(2020, 2024)]], "EIN2 string, TAX_YEAR int, amount double")
    assert impute(tail, types="entrant").count() == tail.count()
    entrant = spark.createDataFrame([("A", 2020, 0), ("A", 2023, 31), ("C", 2021, 100), ("C", 2023, 201), *[("F", y, 1) for y in range(2020, 2024)]], "EIN2 string, TAX_YEAR int, n int")
    got = complete(entrant).where("imputed_row and EIN2 = 'C'").first()
    assert (got.TAX_YEAR, got.n) == (2022, 150.5)
    assert complete(entrant, as_integers=True).where("imputed_row and EIN2 = 'C'").first().n == 150
    assert impute(entrant).where("imputed_row and EIN2 = 'C'").count() == 0


def test_fill_with_one_end_missing(spark):
    df = spark.createDataFrame([("A", 2020, None, None), ("A", 2022, 5.0, None), *[("F", y, 1.0, 1.0) for y in (2020, 2021, 2022)]], "EIN2 string, TAX_YEAR int, x double, y double")
    got = impute(df, method="interpolate").where("imputed_row").first()
    assert (got.x, got.y) == (5.0, None)


def test_identity_counts():
    nine = [i for i in IDENTITIES if i.form == "990"]
    pf = [i for i in IDENTITIES if i.form == "990PF"]
    assert (len(nine), len({v for i in nine for v in i.variables})) == (58, 214)
    assert (len(pf), len({v for i in pf for v in i.variables})) == (29, 174)
