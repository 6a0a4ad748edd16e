"""What is refused, what objects say of themselves, and where the rows of a panel come from."""

import pytest

from cohortloom.functions.predicates import Predicate
from cohortloom.plans import requirements
from cohortloom.plans.assemble import panelize
from cohortloom.plans.catalog import data_source
from cohortloom.plans.frame import check_form_scope, create_frame
from cohortloom.plans.panel import Panel, as_panel, is_panel
from cohortloom.plans.requirements import resolve_frame

HEADER = "F9-P00-T00-HEADER"


@pytest.fixture
def source(spark, tmp_path):
    for y in (2021, 2022):
        rows = [(f"EIN-{i}", f"{y}-{i}") for i in range(5 if y == 2021 else 3)] + [("EIN-0", f"{y}-0")]
        spark.createDataFrame(rows, "EIN2 string, OBJECTID string").write.parquet(f"{tmp_path}/{HEADER}-{y}.parquet")
    return data_source(str(tmp_path))


@pytest.mark.parametrize("args", [
    {}, {"column": ""}, {"column": 7}, {"expr": ""}, {"expr": 7}, {"column": "a", "op": "near", "values": 1}, {"column": "a", "op": "between", "values": [1]},
    {"column": "a", "op": "between", "values": [1, 2, 3]}, {"column": "a", "op": ">", "values": [1, 2]}, {"column": "a", "op": "in", "values": []}, {"column": "a", "op": "not_in"},
])
def test_predicates_that_say_nothing_are_refused(args):
    with pytest.raises(ValueError):
        Predicate.of(**args)


def test_predicates_tell_what_they_ask():
    assert Predicate.of("a", "between", [1, 2]).detail() == "a between 1, 2"
    assert Predicate.of("a", "is_true", [1]) == Predicate("a", "is_true", ()) and Predicate.of("a", "is_true").detail() == "a is_true"
    assert Predicate.of("a", values="x") == Predicate("a", "in", ("x",)) and Predicate.of(expr="a > 1").detail() == "a > 1"


def test_form_scopes_have_no_place_in_a_private_foundation_panel():
    frame = create_frame().add_rule("select", scope=["HD", "990EZ"])
    check_form_scope(frame, "990")
    with pytest.raises(ValueError, match="990EZ does not apply"):
        check_form_scope(frame, "990PF")
    check_form_scope(create_frame().add_rule("select", scope=["hd", "sg"]), "990PF")
    check_form_scope(create_frame(), "990PF")


def test_frames_and_panels_print_what_they_hold(spark):
    frame = create_frame("mine", record="OBJECTID").add_rule("filter", column="TAX_YEAR", op="between", values=[2020, 2021])
    assert repr(frame).splitlines()[:2] == ["<frame> mine", "  keys: entity=EIN2, time=TAX_YEAR, unique_record=OBJECTID"]
    assert "TAX_YEAR between 2020, 2021" in repr(frame) and "(inactive)" not in repr(frame)
    df = spark.createDataFrame([("a", 2020, "o"), ("a", 2021, "p")], "EIN2 string, TAX_YEAR int, OBJECTID string")
    p = Panel(df, frame)
    assert repr(p) == "<panel> mine: 3 columns, labels stale, 0 steps"
    assert "labels fresh" in repr(p.update()) and "labels stale" in repr(p.update().deduplicate())
    assert is_panel(as_panel(df)) and not is_panel(df) and as_panel(df, frame).frame is frame


def test_a_filter_that_overrides_another_is_on_record(spark):
    df = spark.createDataFrame([("a", 2020), ("a", 2021), ("b", 2021)], "EIN2 string, TAX_YEAR int")
    first = as_panel(df).filter(panel_type="persistent")
    with pytest.warns(UserWarning, match="overriding the filter on panel_type"):
        second = first.filter(panel_type="entrant")
    steps = [e.step for e in second.frame.ledger.entries]
    assert steps.count("rule_demoted") == 1 and steps.index("rule_demoted") < len(steps) - 1
    rules = [r for r in second.frame.rules if r.type == "filter" and r.predicate.column == "panel_type"]
    assert [r.predicate.values for r in rules] == [("entrant",)]
    assert sum(e.step == "rule_demoted" for e in first.filter(panel_type="persistent").frame.ledger.entries) == 0


def test_captured_ids_have_a_bound(spark, source, monkeypatch):
    frame = create_frame().add_rule("require", table="P00", present_in="all")
    got = resolve_frame(spark, frame, [2021, 2022], source, capture=True)
    assert sorted(got.of("subset")[0].ids) == ["EIN-0", "EIN-1", "EIN-2"]
    monkeypatch.setattr(requirements, "MAX_CAPTURED", 2)
    with pytest.raises(ValueError, match="more than 2 entities"):
        resolve_frame(spark, frame, [2021, 2022], source, capture=True)
    assert resolve_frame(spark, frame, [2021, 2022], source).of("subset")[0].ids.count() == 3


def test_a_panel_tells_its_sources(spark, source):
    p = panelize(spark, "P00", [2021, 2022, 2023], source)
    rows = [(r.year, r.status, r.rows_source, r.rows_selected, r.exact_duplicates_removed) for r in p.deduplicate().sources().sort("year").collect()]
    assert rows == [(2021, "virtual", 6, 5, 1), (2022, "virtual", 4, 3, 1), (2023, "failed", None, None, None)]
    assert as_panel(p.df).sources().count() == 0
