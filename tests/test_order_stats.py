import random
import statistics

import pytest

from cohortloom.operators import order_stats
from cohortloom.operators.order_stats import group_medians
from cohortloom.plans.frame import apply_frame, create_frame, views


@pytest.mark.parametrize("buffered", [0, 50, 10_000])
def test_against_sorted_lists(spark, buffered):
    rnd = random.Random(3)
    groups = {"hot": 901, "warm": 300, "pair": 2, "one": 1, "ties": 200, "even": 100}
    rows = [(g, float(rnd.choice([1, 2])) if g == "ties" else rnd.uniform(-5, 5)) for g, n in groups.items() for _ in range(n)]
    rows += [(None, 3.0), ("hot", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["by"]: r["stat"] for r in group_medians(df, "g", "v", buffered).collect()}
    want = {g: statistics.median(v for k, v in rows if k == g and v is not None) for g in groups}
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx(want)
    assert got.get("empty") is None


def test_one_group_of_very_many_values(spark):
    n = 3_000_000
    df = spark.range(n).selectExpr("'all' AS g", "(id * 7919) % 3000000 AS v")
    assert group_medians(df, "g", "v").first()["stat"] == (n - 1) / 2


def test_views_and_refresh(spark, monkeypatch):
    rows = [("a", 1.0), ("a", 5.0), ("a", 2.0), ("b", 4.0), ("b", None), (None, 9.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    frame = create_frame().add_view("m", rows="g", value="v", fun="median").add_refresh(action="group_stat", by="g", value="v", fun="median", into="m")
    for limit in (100, 0):
        monkeypatch.setattr(order_stats, "BUFFERED", limit)
        assert {tuple(r) for r in views(df, frame)["m"].collect()} == {("a", 2.0), ("b", None)}
        assert {(r.g, r.v, r.m) for r in apply_frame(df, frame).df.collect()} == {("a", 1.0, 2.0), ("a", 5.0, 2.0), ("a", 2.0, 2.0), ("b", 4.0, None), ("b", None, None), (None, 9.0, 9.0)}
