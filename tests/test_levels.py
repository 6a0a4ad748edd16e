import pytest

from cohortloom.operators.levels import drop_levels, factor, levels_of, present, set_levels
from cohortloom.operators.membership import filter_members, label
from cohortloom.plans.frame import apply_frame, create_frame, views


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("b", "y", 3.0), (None, "y", 4.0), ("a", None, None)], "g string, h string, v double")


def table(df):
    return {tuple(r) for r in df.collect()}


def test_levels_are_carried_on(spark, df):
    some = set_levels(df, {"g": ["c", "b", "a"]})
    after = some.where("v < 3").select("v", "g").join(spark.createDataFrame([(1.0,)], "w double"), some["v"] > 0, "left_semi")
    assert levels_of(after, "g") == ["c", "b", "a"] and levels_of(after, "v") is None and levels_of(after, "nothing") is None
    assert levels_of(set_levels(some, {"g": None}), "g") is None
    assert table(set_levels(df, {"g": ["a"]}).select("g")) == {("a",), (None,)}


def test_unused_levels_count_zero_until_dropped(df):
    frame = create_frame().add_view("one", rows="g").add_view("two", rows="g", cols="h").add_view("stat", rows="g", value="v", fun="mean")
    some = set_levels(df, {"g": ["c", "b", "a"], "h": ["y", "z", "x"]})
    got = views(some, frame)
    assert table(got["one"]) == {("a", 2), ("b", 2), ("c", 0)}
    assert got["two"].columns == ["g", "y", "z", "x"] and table(got["two"]) == {("a", 0, 0, 1), ("b", 1, 0, 1), ("c", 0, 0, 0)}
    assert table(got["stat"]) == {("a", None), ("b", 2.5), ("c", None)}
    dropped = views(drop_levels(some), frame)
    assert levels_of(drop_levels(some), "g") == ["b", "a"] and levels_of(drop_levels(some, ["h"]), "g") == ["c", "b", "a"]
    assert table(dropped["one"]) == {("a", 2), ("b", 2)} and dropped["two"].columns == ["g", "y", "x"]
    plain = views(df, frame)
    assert table(plain["one"]) == {("a", 2), ("b", 2)}


def test_no_job_looks_for_a_crosstabs_values(spark, df):
    some = set_levels(df, {"h": ["x", "y"]})
    group = "levels-test"
    spark.sparkContext.setJobGroup(group, "")
    views(some, create_frame().add_view("two", rows="g", cols="h"))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)


def test_refresh_rules(df):
    f = create_frame().add_refresh(action="factor", cols=["g", "h", "absent"])
    out = apply_frame(df, f).df
    assert levels_of(out, "g") == ["a", "b"] and levels_of(out, "h") == ["x", "y"] and table(out) == table(df)
    f = f.add_refresh(fn=lambda d: d.where("h = 'x' AND g = 'b'")).add_refresh(action="droplevels")
    out = apply_frame(df, f).df
    assert (levels_of(out, "g"), levels_of(out, "h")) == (["b"], ["x"])
    assert levels_of(apply_frame(df, create_frame().add_refresh(action="droplevels", cols="g")).df, "g") is None
    with pytest.raises(ValueError):
        apply_frame(df, create_frame().add_refresh(action="factor"))


def test_too_many_values(spark):
    with pytest.raises(ValueError):
        present(spark.range(20).selectExpr("cast(id as string) k"), ["k"], most=10)
    assert present(spark.range(0).selectExpr("cast(id as string) k"), ["k"]) == {"k": []}
    assert levels_of(factor(spark.range(3).selectExpr("id"), ["id"]), "id") == ["0", "1", "2"]


def test_columns_that_look_like_ours(spark):
    rows = [("A", y, 1) for y in (2019, 2020, 2021)] + [("B", 2021, 2)]
    df = spark.createDataFrame(rows, "EIN2 string, TAX_YEAR int, kept_id int").withColumn("label_id", df_col()).withColumn("id", df_col()).withColumn("k", df_col())
    assert filter_members(df, panel_type="persistent").count() == 3 and filter_members(df, "persistent").columns == df.columns
    out = label(df)
    assert out.columns[:6] == df.columns and {r.panel_type for r in out.collect()} == {"persistent", "entrant"}
    assert label(out).columns == out.columns
    f = create_frame().add_refresh(action="group_stat", by="EIN2", value="kept_id", into="by")
    assert {r.by for r in apply_frame(df, f).df.collect()} == {1.0, 2.0}


def df_col():
    from pyspark.sql import functions as F

    return F.lit(7)
