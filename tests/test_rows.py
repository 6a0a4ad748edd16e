import pytest

from cohortloom.operators.accounting import accounting_check, plan_reconcile, reconcile, reconcile_audit
from cohortloom.operators.dedup import deduplicate
from cohortloom.operators.dimension import join_dimension, prepare
from cohortloom.operators.impute import complete
from cohortloom.operators.normalize import normalize, panel_normalize
from cohortloom.plans.dictionary import Dictionary, concordance


def test_deduplicate(spark):
    df = spark.createDataFrame(
        [("A", 2020, "", "", "", "2021-01-01", 1), ("A", 2020, "X", "", "X", "2023-01-01", 2), ("A", 2020, "", "", "X", "2021-01-02 10:00:00", 3),
         ("B", 2020, "X", "", "", "2021-01-01", 4), ("B", 2020, "X", "", "", "2021-06-01", 5)],
        "EIN2 string, TAX_YEAR int, RETURN_GROUP_X string, RETURN_PARTIAL_X string, RETURN_AMENDED_X string, RETURN_TIME_STAMP string, value int")
    assert sorted(r.value for r in deduplicate(df).collect()) == [3, 5]


def test_mixed_timestamps(spark):
    df = spark.createDataFrame(
        [("A", 1, "2022-01-01", 1), ("A", 1, "2022-12-31", 2), ("B", 1, "2022-01-01 08:00:00 UTC", 3), ("B", 1, "2022-01-01T09:00:00-05:00", 4), ("C", 1, None, 5), ("C", 1, "no", 6)],
        "ORG string, YEAR int, STAMP string, value int")
    got = deduplicate(df, "ORG", "YEAR", timestamp="STAMP").collect()
    assert sorted(r.value for r in got) == [2, 4, 6] or sorted(r.value for r in got) == [2, 4, 5]
    assert len(got) == 3


def test_normalize_blanks_and_boxes(spark):
    df = spark.createDataFrame([("990", None, None, ""), ("990EZ", None, None, "X"), ("990", 10.0, 20.0, "maybe"), ("990EZ", None, 30.0, "")], "RETURN_TYPE string, full double, shared double, box string")
    rules = concordance(["full", "shared", "box"], ["implicit_zero", "implicit_zero", "implicit_false"], ["990", "990|990EZ", "990"])
    n = normalize(df, rules)
    assert [tuple(r) for r in n.df.collect()] == [("990", 0.0, 0.0, False), ("990EZ", None, 0.0, None), ("990", 10.0, 20.0, None), ("990EZ", None, 30.0, None)]
    audit = {r.field: r for r in n.audit().collect()}
    assert (audit["full"].applicable_rows, audit["full"].applicable_blanks, audit["full"].out_of_scope_blanks) == (2, 1, 2)
    assert (audit["box"].unrecognized_count, audit["box"].unrecognized_values, audit["box"].values_normalized) == (1, "maybe", 1)
    with pytest.raises(ValueError):
        normalize(df, concordance("other", "implicit_zero"), strict=True)


def test_concordance_arguments():
    for bad in (dict(field="a", blank_meaning="zero"), dict(field=["a", "a"], blank_meaning="implicit_zero"), dict(field=["a", "b"], blank_meaning=["implicit_zero"] * 3)):
        with pytest.raises(ValueError):
            concordance(**bad)
    rules = {r.field: r for r in concordance()}
    assert rules["F9_08_REV_TOT_TOT"].blank_meaning == "implicit_zero" and rules["F9_08_REV_TOT_TOT"].forms == ("990",)


def test_panel_normalize(spark):
    df = spark.createDataFrame([("A", "990", 5.0, None), ("B", "990EZ", 5.0, None), ("C", "990", None, None), ("D", None, 1.0, None)], "EIN2 string, RETURN_TYPE string, F9_01_REV_TOT_CY double, F9_08_REV_TOT_TOT double")
    n = panel_normalize(df)
    assert [r.F9_08_REV_TOT_TOT for r in n.df.orderBy("EIN2").collect()] == [0.0, None, None, 0.0]
    a = n.audit()
    assert (a["all_missing_rows"], a["ez_rows"], a["values_zeroed"]) == (1, 1, 2)
    pf = spark.createDataFrame([(10.0, None), (None, 5.0), (None, None)], "PF_01_REV_TOT_BOOKS double, PF_01_REV_CONTR_REC_BOOKS double")
    assert [tuple(r) for r in panel_normalize(pf).df.collect()] == [(10.0, 0.0), (0.0, 5.0), (None, None)]


REV = "F9_08_REV_OTH_INVEST_INCOME_"


def test_accounting(spark):
    cols = ", ".join(f"{REV}{c} double" for c in ("RLTD", "UBIZ", "EXCL", "TOT"))
    df = spark.createDataFrame([("A", 2020, 10.0, 5.0, 35.0, 50.0), ("A", 2021, 10.0, 5.0, 35.0, 60.0), ("B", 2021, None, 5.0, 35.0, 60.0)], f"EIN2 string, TAX_YEAR int, {cols}")
    bad = accounting_check(df).collect()
    assert [(r.EIN2, r.TAX_YEAR, r.identity, r.residual) for r in bad] == [("A", 2021, "rev_invest_columns", 10.0)]
    assert accounting_check(df, violations_only=False).count() == 3
    out = reconcile(df, fixed=[REV + "TOT"])
    fixed = out.where("TAX_YEAR = 2021 and EIN2 = 'A'").first()
    assert abs(fixed[REV + "RLTD"] - (10 + 10 / 3)) < 1e-9 and fixed[REV + "TOT"] == 60
    assert accounting_check(out).count() == 0
    plan = plan_reconcile(df)
    assert reconcile_audit(df, plan) == {"rows_adjusted": 1, "rows_skipped": 1}
    heavy = reconcile(df, fixed=REV + "TOT", weights={REV + "RLTD": 1e9}).where("TAX_YEAR = 2021 and EIN2 = 'A'").first()
    assert abs(heavy[REV + "RLTD"] - 10) < 1e-6 and abs(heavy[REV + "UBIZ"] - 10) < 1e-6


def test_complete_reconciles_only_new_rows(spark):
    cols = ", ".join(f"{REV}{c} double" for c in ("RLTD", "UBIZ", "EXCL", "TOT"))
    data = [("A", 2020, 10.0, 5.0, 35.0, 50.0), ("A", 2022, 10.0, 5.0, 35.0, 60.0), *[("F", y, 1.0, 1.0, 1.0, 3.0) for y in (2020, 2021, 2022)]]
    df = spark.createDataFrame(data, f"EIN2 string, TAX_YEAR int, {cols}")
    left = accounting_check(complete(df), tol=0.01).collect()
    assert sorted((r.TAX_YEAR, r.residual) for r in left) == [(2021, 5.0), (2022, 10.0)]
    left = accounting_check(complete(df, reconcile=True), tol=0.01).collect()
    assert [(r.TAX_YEAR, r.residual) for r in left] == [(2022, 10.0)]


def test_dimension(spark):
    dim = spark.createDataFrame(
        [(" ein-01-0000001 ", "old", "1900-01-01", "202301", "current"), ("EIN-01-0000001", "new", "2005-03-01", "202406", "legacy"), ("EIN-01-0000002", "two", "1900-01-01", "202301", "current"), (" ", "none", None, None, None)],
        "EIN2 string, org_name_display string, ruling_date string, bmf_vintage_ym string, bmf_source string")
    p = prepare(dim, vars=["EIN2", "org_name_display", "ruling_year"])
    assert sorted(map(tuple, p.df.collect()), key=str) == [("EIN-01-0000001", "new", 2005), ("EIN-01-0000002", "two", None)]
    d = p.diagnostics()
    assert (d["source_rows"], d["dropped_blank_keys"], d["duplicate_rows_resolved"], d["rows_prepared"]) == (4, 1, 1, 2)
    with pytest.warns(UserWarning):
        prepare(dim, vars=["nothing"])
    with pytest.raises(ValueError):
        prepare(dim, vars=["nothing"], strict=True)
    left = spark.createDataFrame([("ein-01-0000001", 1), ("EIN-01-0000001", 2), ("EIN-01-0000002", 3), ("EIN-09-9999999", 4)], "EIN2 string, n int")
    j = join_dimension(left, p.df)
    assert j.df.count() == 4
    got = j.diagnostics()
    assert (got["matched_rows"], got["unmatched_distinct_ids"]) == (3, 1)


def test_dictionary_selection():
    d = Dictionary()
    assert "F9_08_REV_TOT_TOT" in d.in_scope("990") and "F9_08_REV_TOT_TOT" not in d.in_scope("both")
    assert d.expand_tables(["P08"]) == ["F9-P08-T00-REVENUE"] and d.expand_tables(["PF01"]) == ["PF-P01-T00-REVENUE-EXPENSE"]
    cols = ["EIN2", "mine", "F9_08_REV_TOT_TOT", "F9_01_REV_TOT_CY"]
    assert d.select(cols, scope="both") == ["EIN2", "mine", "F9_01_REV_TOT_CY"]
    assert d.select(cols, tables=["P08"], drop=["mine", "EIN2"]) == ["EIN2", "F9_08_REV_TOT_TOT"]
    assert d.financial(scope="PF", form="990PF") and all(f.startswith("PF_") for f in d.financial(scope="PF", form="990PF"))
