import pytest

from cohortloom.plans import ledger
from cohortloom.plans.frame import create_frame
from cohortloom.plans.ledger import Ledger, observed
from cohortloom.plans.panel import Panel


@pytest.fixture(scope="module")
def df(spark):
    rows = [(f"e{i}", y, f"o{i}{y}{k}", float(i)) for i in range(30) for y in (2019, 2020, 2021) if (i + y) % 4 for k in range(1 + i % 2)]
    return spark.createDataFrame(rows, "EIN2 string, TAX_YEAR int, OBJECTID string, v double")


def rows(m):
    return [(r.step, r.rows_before, r.rows_after, r.rows_dropped) for r in m.collect()]


def chain(df):
    return Panel(df, create_frame(record="OBJECTID")).deduplicate(tie=["OBJECTID"]).filter(panel_type=["persistent", "entrant"]).smooth(["v"], align="right")


def plainly(monkeypatch, p):
    monkeypatch.setattr(ledger, "observed", lambda entries: {})
    out = rows(p.manifest())
    monkeypatch.undo()
    return out


def test_one_run_counts_all_steps(df, monkeypatch):
    p = chain(df)
    asked = []
    monkeypatch.setattr(ledger, "counted", lambda frames, f=ledger.counted: asked.append(len(frames)) or f(frames))
    got = rows(p.manifest())
    monkeypatch.undo()
    assert asked == [0] and got == plainly(monkeypatch, p)
    steps = {s: (a, b) for s, a, b, _ in got}
    assert steps["deduplicate"] == (df.count(), df.select("EIN2", "TAX_YEAR").distinct().count())
    assert steps["smooth"][0] == steps["smooth"][1] == p.df.count()


def test_steps_that_run_jobs_are_counted(df, monkeypatch):
    p = chain(df).balance().label()
    assert rows(p.manifest()) == plainly(monkeypatch, p)


def test_a_repeated_stage_is_not_trusted(df, monkeypatch):
    p = chain(df)
    want = rows(p.manifest())
    monkeypatch.setattr(ledger, "ran_once", lambda sc, group: False)
    assert observed(p.frame.ledger.entries) == {} and rows(p.manifest()) == want


def test_a_counter_that_is_optimized_away(spark, df, monkeypatch):
    monkeypatch.setattr(ledger, "PATIENCE", 1)
    nothing = df.where("v < -1").groupBy("EIN2").count()
    make = lambda d: df.join(d.where("1 = 0"), "EIN2").join(df.groupBy("EIN2").count().withColumnRenamed("count", "m"), "EIN2")
    entry = Ledger().add("a", "", nothing, make(nothing), make)
    assert [r[2:4] for r in entry.rows()] == [(0, 0)]
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None or not spark.sparkContext.getLocalProperty("spark.jobGroup.id").startswith("ledger-")


def test_rules_of_a_frame(spark, df, tmp_path):
    from cohortloom.plans.assemble import panelize
    from cohortloom.plans.catalog import data_source

    for y in (2020, 2021):
        df.where(f"TAX_YEAR = {y}").selectExpr("EIN2", "OBJECTID", "cast(TAX_YEAR as string) TAX_YEAR", "cast(v as string) v").write.parquet(f"{tmp_path}/F9-P00-T00-HEADER-{y}.parquet")
    f = create_frame(record="OBJECTID", years=[2020, 2021]).add_rule("filter", column="v", op="!=", values="3.0").add_rule("dedup")
    p = panelize(spark, "P00", [2020, 2021], data_source(str(tmp_path)), f)
    found = observed(p.frame.ledger.entries)
    assert len(found) == 4
    got = rows(p.manifest())
    n, m = (df.where(f"TAX_YEAR > 2019 {x}").count() for x in ("", "AND v <> 3"))
    assert [g[2] for g in got] == [n, n, m, df.where("TAX_YEAR > 2019 AND v <> 3").select("EIN2", "TAX_YEAR").distinct().count()]


def test_an_empty_ledger():
    assert Ledger().rows() == [] and observed(()) == {}
