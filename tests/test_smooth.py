import math
import random

import pytest

from cohortloom.operators.smooth import smooth


def frame(spark, data, kind="double"):
    return spark.createDataFrame([(i, t, None if x is None else float(x)) for i, t, x in data], f"EIN2 string, TAX_YEAR int, x {kind}")


def values(df, id="A"):
    return [r.x for r in sorted(df.where(f"EIN2 = '{id}'").collect(), key=lambda r: r.TAX_YEAR)]


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-12)), (a, b)


def years(first, xs, id="A"):
    return [(id, first + i, x) for i, x in enumerate(xs)]


def test_center(spark):
    assert values(smooth(frame(spark, years(2018, [100, float("nan"), 300, 400, 500])), "x"))[1] == 200
    close(values(smooth(frame(spark, years(2020, [1, 2, 3, 4])), "x")), [2, 2, 3, 3])


def test_calendar_and_gap(spark):
    df = frame(spark, list(zip("AAAAA", (2015, 2016, 2019, 2020, 2021), (10, 20, 30, 40, 50))))
    close(values(smooth(df, "x", align="right")), [10, 15, 30, 35, 40])
    close(values(smooth(df, "x", align="left")), [15, 20, 40, 45, 50])
    assert values(smooth(df, "x"))[2] == 30


def test_weights(spark):
    df = frame(spark, years(2018, [1, 2, 4, 8]))
    decay = values(smooth(df, "x", weights="decay", align="right"))
    close(decay[1:3], [(2 + 0.5) / 1.5, (4 + 1 + 0.25) / 1.75])
    half = values(smooth(df, "x", weights="half", align="right"))
    close([half[0], half[3]], [1, 8 * 0.5 + 4 * 0.25 + 2 * 0.25])
    close(values(smooth(df.where("TAX_YEAR <> 2020"), "x", weights="half", align="right"))[-1:], [(8 * 0.5 + 2 * 0.25) / 0.75])
    close(values(smooth(df, "x", 2, align="right")), [1, 1.5, 3, 6])


def test_missing(spark):
    df = frame(spark, years(2018, [10, None, float("nan"), 40]) + years(2018, [None, None], "B"))
    out = smooth(df, "x", align="right")
    close(values(out), [10, 10, 10, 40])
    close(values(out, "B"), [None, None])


def test_arguments(spark):
    df = frame(spark, years(2018, [1, 2]))
    assert smooth(df, "x", 1) is df
    for bad in ({"window": 2}, {"window": 0, "align": "right"}, {"weights": "none"}):
        with pytest.raises(ValueError):
            smooth(df, "x", **bad)
    text = df.selectExpr("EIN2", "concat('FY', TAX_YEAR) TAX_YEAR", "x")
    with pytest.raises(ValueError):
        smooth(text, "x", align="right")
    ok = df.selectExpr("EIN2", "cast(TAX_YEAR as string) TAX_YEAR", "x")
    close([r.x for r in smooth(ok, "x", align="right").orderBy("TAX_YEAR").collect()], [1, 1.5])


def plain_center(xs, window, weights):
    n = len(xs)
    width = min(window, n)
    out = []
    for p in range(n):
        start = max(0, min(p - width // 2, n - width))
        num = den = 0.0
        for q in range(start, start + width):
            w = {"equal": 1.0, "decay": 0.5 ** abs(p - q), "half": (0.5 if width > 1 else 1.0) if p == q else 0.5 / (width - 1 or 1)}[weights]
            if xs[q] is not None and not math.isnan(xs[q]):
                num, den = num + w * xs[q], den + w
        out.append(num / den if den else None)
    return out


@pytest.mark.parametrize("window", [3, 5])
@pytest.mark.parametrize("weights", ["equal", "half", "decay"])
def test_center_against_plain_loop(spark, window, weights):
    rnd = random.Random(7)
    data = [(f"I{i}", y, rnd.choice([None, float("nan"), *[rnd.uniform(-9, 9)] * 5])) for i in range(12) for y in sorted(rnd.sample(range(2010, 2025), rnd.randint(1, 8)))]
    shuffled = data[:]
    rnd.shuffle(shuffled)
    got = smooth(frame(spark, shuffled), "x", window, weights).collect()
    by = {}
    for r in got:
        by.setdefault(r.EIN2, []).append((r.TAX_YEAR, r.x))
    for i, pairs in by.items():
        close([x for _, x in sorted(pairs)], plain_center([x for k, _, x in data if k == i], window, weights))


def test_right_never_looks_ahead(spark):
    rnd = random.Random(3)
    data = [(f"I{i}", y, rnd.random()) for i in range(5) for y in range(2012, 2022)]
    whole = smooth(frame(spark, data), "x", 3, "decay", "right").where("TAX_YEAR <= 2017")
    part = smooth(frame(spark, [d for d in data if d[1] <= 2017]), "x", 3, "decay", "right")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, part.collect()))


@pytest.mark.parametrize("align", ["center", "right", "left"])
def test_rows_without_an_id_stand_in_no_common_window(spark, align):
    rows = [(None, 2000 + i % 5, float(i)) for i in range(500)] + [("a", 2000, 1.0), ("a", 2001, 3.0), ("a", 2002, 5.0)]
    df = spark.createDataFrame(rows, "EIN2 string, TAX_YEAR int, v double")
    out = smooth(df, "v", 3, "equal", align)
    assert sorted(r.v for r in out.where("EIN2 is null").collect()) == [float(i) for i in range(500)]
    assert "CASE WHEN" in out._jdf.queryExecution().optimizedPlan().toString()
