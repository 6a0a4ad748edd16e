import pytest

from cohortloom.plans.frame import apply_frame, conform, create_frame, run_checks, views
from cohortloom.plans.panel import Panel, as_panel, is_panel


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(
        [("A", 2019, "990", "GA", 10.0, 1), ("A", 2020, "990", "GA", 20.0, 2), ("A", 2021, "990", "GA", 30.0, 3),
         ("B", 2020, "990EZ", "FL", 40.0, 4), ("B", 2021, "990EZ", "FL", 50.0, 5), ("C", 2021, "990", "ga ", 60.0, 6)],
        "EIN2 string, TAX_YEAR int, RETURN_TYPE string, geo_state_abbr string, F9_01_REV_TOT_CY double, my_custom int")


def ids(applied):
    return sorted({r.EIN2 for r in applied.df.collect()})


def test_rules_filter_rows(df):
    f = create_frame(state="GA").add_rule("subset", subset=["A", "C"])
    assert ids(apply_frame(df, f)) == ["A", "C"]
    assert apply_frame(df, create_frame().add_rule("filter", column="TAX_YEAR", op="between", values=[2020, 2021])).df.count() == 5
    assert apply_frame(df, create_frame().add_rule("filter", expr="F9_01_REV_TOT_CY > 25")).df.count() == 4
    missing = apply_frame(df, create_frame().add_rule("filter", name="gone", column="nothing", op="==", values=1))
    assert missing.df.count() == 6 and missing.skipped == ("gone",)
    with pytest.warns(UserWarning):
        assert apply_frame(df, create_frame().add_rule("filter", expr="nothing > 1")).df.count() == 6
    assert apply_frame(df, create_frame().add_rule("subset", ids=[])).df.count() == 0
    assert ids(apply_frame(df, create_frame(), formtype="990EZ")) == ["B"]


def test_labels(df):
    f = create_frame().add_rule("label", "cohort", label="cohort", map={"A": "treat", "B": "control", "C": "treat"})
    out = apply_frame(df, f, cohort="treat")
    assert ids(out) == ["A", "C"] and "cohort" not in out.df.columns
    assert ids(apply_frame(df, create_frame().classified(df), panel_type="persistent")) == ["A"]


def test_nulls_in_predicates(spark):
    df = spark.createDataFrame([("a",), (" B",), (None,)], "EIN2 string").selectExpr("EIN2", "1 TAX_YEAR", "EIN2 x")

    def kept(op, values=None):
        return apply_frame(df, create_frame().add_rule("filter", column="x", op=op, values=values)).df.count()

    assert (kept("in", ["A"]), kept("not_in", ["A"]), kept("==", "a"), kept("!=", "a"), kept("is_true"), kept("is_false")) == (1, 2, 1, 1, 0, 3)
    assert kept("in", ["A", None]) == 2 and kept("not_in", ["b", None]) == 1


def test_group_stat_and_select(spark, df):
    f = create_frame().add_rule("filter", column="my_custom", op="<=", values=3).add_refresh(action="group_stat", by="EIN2", value="F9_01_REV_TOT_CY")
    assert {r.F9_01_REV_TOT_CY_mean for r in apply_frame(df, f).df.collect()} == {20.0}
    f = create_frame().add_rule("select", scope="990EZ", drop=["my_custom"])
    assert apply_frame(df, f).df.columns == ["EIN2", "TAX_YEAR", "RETURN_TYPE", "geo_state_abbr", "F9_01_REV_TOT_CY"]
    holes = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0), (None, 9.0)], "g string, v double")
    got = {(r.g, r.v): r.m for r in apply_frame(holes, create_frame().add_refresh(action="group_stat", by="g", value="v", into="m")).df.collect()}
    assert got == {("a", 1.0): None, ("a", None): None, ("b", 3.0): 3.0, (None, 9.0): 9.0}


def test_checks_views_conform(df):
    f = (create_frame().add_rule("check", "big", column="F9_01_REV_TOT_CY", op=">", values=15).add_rule("check", "gone", column="nothing", op="is_true")
         .add_view("n", rows="geo_state_abbr").add_view("sum", rows="RETURN_TYPE", value="my_custom", fun="sum").add_view("cross", rows="EIN2", cols="RETURN_TYPE").add_view("no", rows="nothing"))
    got = {r["check"]: r for r in run_checks(df, f).collect()}
    assert (got["big"]["n"], got["big"]["pass"], got["big"]["fail"], got["big"]["ok"]) == (6, 5, 1, False)
    assert (got["gone"]["pass"], got["gone"]["ok"], got["gone"]["note"]) == (None, None, "column absent")
    v = views(df, f)
    assert v["no"] is None
    assert {r.RETURN_TYPE: r["sum"] for r in v["sum"].collect()} == {"990": 12, "990EZ": 9}
    assert {(r.EIN2, r["990"], r["990EZ"]) for r in v["cross"].collect()} == {("A", 3, 0), ("B", 0, 2), ("C", 1, 0)}
    c = conform(df, create_frame(state="GA"))
    assert (c.conformant, c.rows_total, c.rows_violating, c.missing_keys) == (False, 6, 2, ())
    assert conform(df, create_frame(entity="other")).missing_keys == ("other",)


def test_rule_bookkeeping():
    f = create_frame("f", years=[2020]).add_rule("filter", "a", column="x", op="==", values=1).add_rule("filter", column="y", op="is_true")
    assert [r.name for r in f.rules] == ["filter:TAX_YEAR", "a", "filter_3"]
    g = f.update_rule("a", values=2)
    assert [r.name for r in g.rules] == [r.name for r in f.rules] and g.rule("a").predicate.values == (2,) and f.rule("a").predicate.values == (1,)
    assert len(g.remove_rule("a").rules) == 2
    for bad in (dict(type="filter", column="x", op="between", values=[1]), dict(type="filter", column="x", op="in"), dict(type="nope"), dict(type="refresh"), dict(type="require", present_in=0), dict(type="require", expr="x > 1")):
        with pytest.raises(ValueError):
            f.add_rule(**bad)
    assert "filter:TAX_YEAR" in repr(f)


def test_panel_ledger_and_freshness(spark):
    data = [("A", y) for y in range(2019, 2024)] + [("B", y) for y in range(2021, 2024)] + [("D", 2019), ("D", 2023)]
    p = as_panel(spark.createDataFrame([(o, y, i) for i, (o, y) in enumerate(data)], "EIN2 string, TAX_YEAR int, v int"))
    assert is_panel(p) and as_panel(p) is p and not p.fresh
    described, summary = p.describe()
    assert described.fresh and summary.n_orgs == 3
    kept = described.filter(panel_type="persistent")
    assert {r.EIN2 for r in kept.df.collect()} == {"A", "D"} and kept.frame.rule("filter:panel_type")
    with pytest.warns(UserWarning):
        kept.filter(panel_type="entrant")
    full = kept.impute()
    assert not full.fresh and full.smooth("v").fresh is False and full.update().fresh
    ledger = [tuple(r) for r in full.manifest().collect()]
    assert [r[0] for r in ledger] == ["describe", "filter", "impute"]
    assert ledger[1][2:6] == (10, 7, 3, 30.0) and ledger[2][2:5] == (7, 10, -3)
    assert isinstance(full, Panel)


@pytest.mark.parametrize("n", [999, 1000, 1001, 5000])
def test_subset_means_the_same_for_any_number_of_ids(spark, n):
    """Whole-number ids against text keys, some of them no numbers."""
    df = spark.createDataFrame([("123",), ("0123",), ("none",), ("4",), (None,)], "id string")
    ids = [123, *range(10_000, 10_000 + n - 1)]
    f = create_frame(entity="id", time="t").add_rule("subset", ids=ids)
    assert [r.id for r in apply_frame(df, f).df.collect()] == ["123"]
    got = conform(df.withColumn("t", df.id), f)
    assert (got.rows_total, got.rows_violating) == (5, 4)
    table = spark.createDataFrame([(i,) for i in ids] + [(None,)], "k bigint")
    assert [r.id for r in apply_frame(df, create_frame(entity="id", time="t").add_rule("subset", ids=table)).df.collect()] == ["123"]


def test_group_stat_keeps_rows_without_a_group(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", None), ("b", 2.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    f = create_frame(entity="g", time="t").add_refresh(action="group_stat", by="g", value="v", fun="mean", into="m")
    assert sorted(map(str, [tuple(r) for r in apply_frame(df, f).df.collect()])) == sorted(map(str, [("a", 1.0, 2.0), ("a", 3.0, 2.0), ("b", None, None), ("b", 2.0, None), (None, 5.0, 5.0)]))
    over = create_frame(entity="g", time="t").add_refresh(action="group_stat", by="g", value="v", fun="sum", into="v")
    assert sorted(map(str, [tuple(r) for r in apply_frame(df, over).df.collect()])) == sorted(map(str, [("a", 4.0), ("a", 4.0), ("b", None), ("b", None), (None, 5.0)]))


def test_verbs_after_describe_need_no_second_look(spark):
    """What describe found is passed on: the same rows come out, and it goes once rows change."""
    rows = [(i, y, float(ord(i) + y)) for i in "abcdef" for y in range(2000, 2004) if (i, y) not in (("a", 2001), ("b", 2003), ("c", 2000))]
    p = Panel(spark.createDataFrame(rows, "id string, t int, v double"), create_frame(entity="id", time="t"))
    known, _ = p.describe()
    assert known.summary is not None and known._known()["years"] == [2000, 2001, 2002, 2003]
    for verb in ("impute", "complete", "balance", "label"):
        a, b = getattr(known, verb)(), getattr(p, verb)()
        assert sorted(map(str, a.df.collect())) == sorted(map(str, b.df.collect()))
        assert (a.summary is None) == (verb != "label")
    assert sorted(map(str, known.filter(panel_type="persistent").df.collect())) == sorted(map(str, p.filter(panel_type="persistent").df.collect()))
    assert known.filter(min_obs=2).summary is None and known.update().summary is not None
