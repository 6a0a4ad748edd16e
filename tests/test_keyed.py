import pytest
from plan import nodes, total

from cohortloom.plans.assemble import _narrow, panelize
from cohortloom.plans.catalog import data_source
from cohortloom.plans.frame import create_frame
from cohortloom.sources import keyed
from cohortloom.sources.keyed import FOLDED, keep_entities, stage_keyed, store_keyed, visible
from cohortloom.sources.tables import read_table, read_tables, scan

HEADER = "F9-P00-T00-HEADER"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("keyed") / "t")
    rows = [(f" e-{i:05d}" if i % 2 else f"E-{i:05d} ", i, "x" * 20) for i in range(4000)] + [(None, -1, "")] * 600
    store_keyed(spark.createDataFrame(rows, "EIN2 string, v int, pad string").repartition(3), path, rows_a_file=250)
    return spark.read.parquet(path)


def values(df):
    return sorted(r.v for r in df.collect())


def test_listed_entities_are_pushed(stored):
    df = visible(keep_entities(stored, "EIN2", ["e-00007", " E-00008", "nobody"]))
    assert values(df) == [7, 8] and df.columns == ["EIN2", "v", "pad"]
    text = df._jdf.queryExecution().toString()
    assert f"PushedFilters: [In({FOLDED}" in text
    assert total(df, "FileSourceScanExec", "numOutputRows") <= 1000 < 4600


def test_a_table_of_entities_reads_few_row_groups(spark, stored):
    ids = spark.createDataFrame([(f"e-{i:05d}",) for i in range(100, 120)], "id string")
    df = visible(keep_entities(stored, "EIN2", ids=ids))
    assert values(df) == list(range(100, 120))
    assert f"GreaterThanOrEqual({FOLDED}" in df._jdf.queryExecution().toString()
    assert total(df, "FileSourceScanExec", "numOutputRows") <= 1000


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_many_ids_make_no_literals(spark, stored, limit):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        df = keep_entities(stored, "EIN2", [f"e-{i:05d}" for i in range(0, 60000, 3)])
        assert values(df) == list(range(0, 4000, 3))
        assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 5000
        if limit == "-1":
            assert any(k == "ArrowEvalPythonExec" for k, _ in nodes(df))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_same_without_a_stored_key(spark, stored):
    raw = visible(stored)
    ids = spark.createDataFrame([(" e-00005",), ("E-00006",), (None,)], "__entity_key string")
    assert values(keep_entities(raw, "EIN2", ids=ids)) == values(visible(keep_entities(stored, "EIN2", ids=ids))) == [5, 6]
    assert values(keep_entities(raw, "EIN2", [])) == values(keep_entities(stored, "EIN2", [])) == []
    assert values(keep_entities(stored, "EIN2", ids=ids.limit(0))) == []
    many = [f"e-{i:05d}" for i in range(2000)]
    assert values(read_table(raw, 2020, filters={"EIN2": many, "pad": ["x" * 20] + [f"p{i}" for i in range(3000)]})) == list(range(2000))


def test_all_rows_are_stored(stored):
    assert visible(stored).count() == 4600 and stored.where("EIN2 IS NULL").count() == 600


def test_staged_source_gives_the_same_panel(spark, tmp_path):
    rows = [(f"ein-{i}", f"o{i}", "2021", "990") for i in range(50)] * 2
    spark.createDataFrame(rows, "EIN2 string, OBJECTID string, TAX_YEAR string, RETURN_TYPE string").write.parquet(f"{tmp_path}/a/{HEADER}-2021.parquet")
    source = data_source(f"{tmp_path}/a")
    by_key = stage_keyed(spark, "P00", [2021, 2022], source, f"{tmp_path}/b")
    assert FOLDED in scan(spark, by_key.path(HEADER, 2021)).columns
    frame = create_frame(eins=["EIN-3", " ein-4 "], record="OBJECTID")
    a, b = (panelize(spark, "P00", [2021], s, frame) for s in (source, by_key))
    assert a.df.columns == b.df.columns and sorted(a.df.collect()) == sorted(b.df.collect()) and a.df.count() == 2
    assert [t.raw.columns for t in read_tables(spark, "P00", [2021], by_key)] == [["EIN2", "OBJECTID", "TAX_YEAR", "RETURN_TYPE"]]


def test_entities_of_call_and_frame_in_any_case(spark, tmp_path):
    assert _narrow({"EIN2": ["EIN-1", "x"]}, "EIN2", ["ein-1 ", "X", "y"]) == {"EIN2": ["EIN-1", "X"]}
    big = [f"e{i}" for i in range(50_000)]
    assert len(_narrow({"EIN2": big}, "EIN2", [b.upper() for b in big])["EIN2"]) == 50_000
    spark.createDataFrame([("EIN-1", "o1", "2021"), ("EIN-2", "o2", "2021")], "EIN2 string, OBJECTID string, TAX_YEAR string").write.parquet(f"{tmp_path}/{HEADER}-2021.parquet")
    p = panelize(spark, "P00", [2021], data_source(str(tmp_path)), create_frame(eins="ein-1 ", record="OBJECTID"), filters={"EIN2": ["EIN-1"]})
    assert [r.EIN2 for r in p.df.collect()] == ["EIN-1"]


def test_more_ids_than_are_listed(spark, stored, monkeypatch):
    monkeypatch.setattr(keyed, "LISTED", 1)
    assert values(keep_entities(stored, "EIN2", ["e-00001", "E-00002"])) == [1, 2]
