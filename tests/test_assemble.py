import pytest

from cohortloom.plans.assemble import join_tables, panelize, panelize_pf
from cohortloom.plans.catalog import TABLES, cardinality, data_source, form_family, resolve_tables, table_catalog
from cohortloom.plans.frame import create_frame
from cohortloom.sources.stage import budget, download_manifest, download_tables, fetch, retrieval_log, write_log
from cohortloom.sources.tables import cast_audit, cast_declared, common_kind, read_manifest, read_table, read_tables, stack

HEADER, SUMMARY, MANY = "F9-P00-T00-HEADER", "F9-P01-T00-SUMMARY", "F9-P03-T01-PROGRAMS-OTHER"


def put(spark, root, table, year, rows, schema, csv=False):
    df = spark.createDataFrame(rows, schema)
    if csv:
        df.toPandas().to_csv(f"{root}/{table}-{year}.CSV", index=False)
    else:
        df.toPandas().astype("string").to_parquet(f"{root}/{table}-{year}.parquet", index=False)


@pytest.fixture(scope="module", params=[False, True], ids=["parquet", "csv"])
def source(request, spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("mirror"))
    for y in (2021, 2022):
        put(spark, root, HEADER, y, [("1", "o1", "012345681", "990", "2019" if False else str(y)), ("2", "o2", "2", "990EZ", str(y)), ("2", "o2", "2", "990EZ", str(y))], "EIN2 string, OBJECTID string, ORG_EIN string, RETURN_TYPE string, TAX_YEAR string", request.param)
        put(spark, root, SUMMARY, y, [("1", "o1", str(100 + y)), ("3", "o3", " ")], "EIN2 string, OBJECTID string, F9_01_REV_TOT_CY string", request.param)
        put(spark, root, MANY, y, [("1", "o1", "a"), ("1", "o1", "b")], "EIN2 string, OBJECTID string, item string", request.param)
    return data_source(root, format="csv" if request.param else "parquet")


def test_panelize(spark, source):
    p = panelize(spark, ["P00", "P01"], [2022, 2021], source)
    got = sorted(tuple(r[c] for c in ("EIN2", "TAX_YEAR", "F9_01_REV_TOT_CY", "ORG_EIN")) for r in p.df.collect())
    assert got == [(i, y, v, o) for i, v, o in (("1", None, "012345681"), ("2", None, "2"), ("3", None, None)) for y in (2021, 2022) for v in ([100.0 + y] if i == "1" else [None])]
    assert dict(p.df.dtypes)["TAX_YEAR"] == "int"
    m = read_manifest(spark, list(p.reads)).collect()
    assert {(r.rows_source, r.rows_selected, r.exact_duplicates_removed) for r in m if r.request == "P00"} == {(3, 2, 1)}
    assert p.manifest().first().rows_after == 6


def test_entities_reach_the_scans(spark, source):
    f = create_frame(eins=["1"], record="OBJECTID").add_rule("filter", column="F9_01_REV_TOT_CY", op=">=", values=2122)
    p = panelize(spark, ["P00", "P01"], [2021, 2022], source, f)
    assert [(r.EIN2, r.TAX_YEAR) for r in p.df.collect()] == [("1", 2022)]
    assert {r.rows_selected for r in read_manifest(spark, list(p.reads)).collect()} == {1}


def test_many_rows_and_missing_years(spark, source):
    assert panelize(spark, ["P00", MANY], [2021], source).df.count() == 2
    assert panelize(spark, ["P00", MANY], [2021], source, include_many=True).df.count() == 3
    p = panelize(spark, ["P00"], [2021, 2030], source)
    assert [t.status for t in p.reads] == ["virtual", "failed"]
    with pytest.raises(ValueError):
        panelize(spark, ["P00"], [2030], source)


def test_requirements(spark, tmp_path):
    for y in (2019, 2020, 2021):
        forms = [("01", "990EZ"), ("02", "990"), ("03", "990" if y == 2021 else "990EZ")] + ([("04", "990EZ")] if y == 2021 else [])
        put(spark, tmp_path, HEADER, y, [(i, f"o{i}", str(y), f) for i, f in forms], "EIN2 string, OBJECTID string, TAX_YEAR string, RETURN_TYPE string")
    s = data_source(str(tmp_path))

    def kept(**rule):
        f = create_frame(record="OBJECTID").add_rule("require", **rule)
        return sorted({r.EIN2 for r in panelize(spark, ["P00"], [2019, 2020, 2021, 2022], s, f).df.collect()})

    ez = dict(column="RETURN_TYPE", op="in", values="990EZ")
    assert kept(present_in="all") == ["01", "02", "03"]
    assert kept(present_in="any", **ez) == ["01", "04"]
    assert kept(present_in="any", holds="any", **ez) == ["01", "03", "04"]
    assert kept(present_in="all", **ez) == ["01"]
    assert kept(present_in=1) == ["01", "02", "03", "04"]
    both = create_frame(record="OBJECTID").add_rule("require", present_in="all").add_rule("require", present_in="any", **ez)
    p = panelize(spark, ["P00"], [2019, 2020, 2021], s, both)
    assert {r.EIN2 for r in p.df.collect()} == {"01"} and [r.active for r in p.frame.rules] == [False, False, True]


def test_outer_join_rules(spark):
    a = spark.createDataFrame([("1", None, 1), ("2", "u", 2)], "EIN2 string, URL string, x int")
    b = spark.createDataFrame([("1", None, 3), ("3", "w", 4)], "EIN2 string, URL string, y int")
    assert sorted(map(tuple, join_tables(a, b, "B").collect()), key=str) == [("1", None, 1, 3), ("2", "u", 2, None), ("3", "w", None, 4)]
    c = b.withColumnRenamed("y", "x")
    with pytest.raises(ValueError):
        join_tables(a, c, "C")
    assert join_tables(a, c, "C", collision="prefix").columns == ["EIN2", "URL", "x", "C__x"]
    with pytest.raises(ValueError):
        join_tables(a, b.select("y"), "B")


def test_repeated_keys_are_an_error(spark, tmp_path):
    put(spark, tmp_path, HEADER, 2021, [("1", "o", "a"), ("1", "o", "b")], "EIN2 string, OBJECTID string, x string")
    with pytest.raises(ValueError):
        panelize(spark, ["P00"], [2021], data_source(str(tmp_path)))


def test_casts(spark):
    df = spark.createDataFrame([(" 5.5 ", "5.7", "007"), ("", None, "x"), ("abc", "1e3", "y")], "F9_01_REV_TOT_CY string, RETURN_TAXPER_DAYS string, mine string")
    assert [tuple(r) for r in cast_declared(df).collect()] == [(5.5, 5, "007"), (None, None, "x"), (None, 1000, "y")]
    assert [tuple(r) for r in cast_audit(df).collect()] == [("F9_01_REV_TOT_CY", 1, ["abc"])]


def test_stack_promotes(spark):
    out = stack([spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([("x", 2.5, 1)], "a string, b double, c int")])
    assert [tuple(r) for r in out.collect()] == [("1", 2.0, None), ("x", 2.5, 1)]


def test_catalog(spark):
    assert (len(TABLES["990"]), len(TABLES["990PF"])) == (136, 84)
    assert [cardinality(t) for t in (HEADER, MANY, "SA-P06-T99-SUPPLEMENTAL-INFO", "X")] == ["1x1", "1xm", "supplemental", "unknown"]
    assert table_catalog(spark, "1x1").where("alias = 'P08'").count() == 1
    assert form_family(" 990-pf") == "990PF"
    for bad in ("990EZ", "1040", ""):
        with pytest.raises(ValueError):
            form_family(bad)
    nine, pf = data_source("/x"), data_source("/x", form="PF")
    assert resolve_tables("p08", nine)[0].table == "F9-P08-T00-REVENUE" and not resolve_tables("NEW-TABLE", nine)[0].known
    for source, table in ((nine, "PF01"), (nine, "PF-P01-T00-REVENUE-EXPENSE"), (pf, "P08")):
        with pytest.raises(ValueError):
            resolve_tables(table, source)
    assert data_source(version="efile_v2_3", mirror="/m").root == "/m/efile_v2_3/"
    with pytest.raises(ValueError):
        data_source(version="2.3", mirror="/m")


def test_private_foundations(spark, tmp_path):
    for y in (2021, 2022):
        put(spark, tmp_path, HEADER, y, [("1", "o1"), ("2", "o2")], "EIN2 string, OBJECTID string")
        put(spark, tmp_path, "PF-P01-T00-REVENUE-EXPENSE", y, [("1", "o1", "5")], "EIN2 string, OBJECTID string, PF_01_REV_TOT_BOOKS string")
    p = panelize_pf(spark, ["P00", "PF01"], [2021, 2022], str(tmp_path))
    assert p.df.count() == 4 and dict(p.df.dtypes)["PF_01_REV_TOT_BOOKS"] == "double"
    with pytest.raises(ValueError):
        panelize_pf(spark, ["P00"], [2021], str(tmp_path), frame=create_frame().add_rule("select", scope="990EZ"))
    assert data_source("/x", form="PF").cache_path("/c", HEADER, 2021) == f"/c/990PF/2021/{HEADER}-2021.parquet"


def test_staging(spark, tmp_path):
    (tmp_path / "src").mkdir()
    put(spark, tmp_path / "src", HEADER, 2021, [("1", "o")], "EIN2 string, OBJECTID string")
    s = data_source(str(tmp_path / "src"))
    first = download_tables([2021, 2022], "P00", s, str(tmp_path / "cache"), retry_max=2, backoff=0)
    assert [x.status for x in first] == ["downloaded", "failed"]
    assert [x.status for x in download_tables([2021], "P00", s, str(tmp_path / "cache"))] == ["reused"]
    assert download_manifest(spark, first).count() == 2
    write_log(str(tmp_path / "log"), first)
    write_log(str(tmp_path / "log"), first[:1])
    assert [r.failed for r in retrieval_log(spark, str(tmp_path / "log")).collect()] == [1, 0]
    with pytest.raises(OSError):
        fetch(s.path(HEADER, 2021), str(tmp_path / "x"), 1, expected_bytes=1, backoff=0)
    assert not (tmp_path / "x").exists() and not (tmp_path / "x.part").exists()
    assert (budget(10), budget(10, 512 * 1024 * 100), budget(10, floor=50), budget(1e12)) == (10, 100, 50, 2147483)
    assert [r.status for r in read_tables(spark, "P00", [2021], s, first)] == ["downloaded"]


@pytest.mark.parametrize("kinds_of, want", [
    ({"decimal(10,2)", "decimal(12,2)"}, "decimal(12,2)"), ({"decimal(10,4)", "decimal(12,2)"}, "decimal(14,4)"), ({"decimal(10,2)", "double"}, "double"), ({"decimal(10,2)", "bigint"}, "decimal(21,2)"),
    ({"decimal(38,0)", "decimal(38,10)"}, "double"), ({"int", "bigint"}, "double"), ({"decimal(10,2)", "string"}, "string"), ({"date", "int"}, "string"),
])
def test_common_kinds(kinds_of, want):
    assert common_kind(kinds_of) == want


def test_decimals_stack_exactly(spark):
    a = spark.sql("select cast(1.25 as decimal(10,2)) x")
    b = spark.sql("select cast(9999999999.99 as decimal(12,2)) x")
    out = stack([a, b])
    assert dict(out.dtypes)["x"] == "decimal(12,2)" and sorted(str(r.x) for r in out.collect()) == ["1.25", "9999999999.99"]


def test_listed_and_tabled_entities_read_the_same(spark):
    raw = spark.createDataFrame([(" ein-1",), ("EIN-1 ",), ("EIN-2",), (None,)], "EIN2 string")
    listed = read_table(raw, 2020, filters={"EIN2": ["Ein-1"]})
    tabled = read_table(raw, 2020, ids=spark.createDataFrame([("eIN-1 ",)], "k string"))
    assert sorted(r.EIN2 for r in listed.collect()) == sorted(r.EIN2 for r in tabled.collect()) == [" ein-1", "EIN-1 "]


def test_staged_sizes_are_verified(spark, tmp_path):
    (tmp_path / "src").mkdir()
    put(spark, tmp_path / "src", HEADER, 2021, [("1", "o")], "EIN2 string, OBJECTID string")
    s = data_source(str(tmp_path / "src"))
    name = s.filename(HEADER, 2021)
    bad = download_tables([2021], "P00", s, str(tmp_path / "cache"), retry_max=1, backoff=0, expected_bytes={name: 1})
    assert [x.status for x in bad] == ["failed"] and "expected 1 bytes" in bad[0].error
    import os

    size = os.path.getsize(s.path(HEADER, 2021))
    assert [x.status for x in download_tables([2021], "P00", s, str(tmp_path / "cache"), expected_bytes={name: size})] == ["downloaded"]
    assert [x.status for x in download_tables([2021], "P00", s, str(tmp_path / "cache"), expected_bytes={name: size})] == ["reused"]


def test_staged_dimension(spark, tmp_path):
    import json

    from cohortloom.sources.dimension import retrieve, stage_dimension

    root = tmp_path / "build"
    root.mkdir()
    (root / "bmf_unified_geocoded.csv").write_text("EIN2,org_name_display\nein-1,one\n")
    (root / "_manifest.json").write_text(json.dumps({"files": {"bmf_unified_geocoded.csv": {"bytes": 3}}}))
    assert stage_dimension(spark, str(root), str(tmp_path / "cache"), "csv", retry_max=1, backoff=0).status == "failed"
    (root / "_manifest.json").write_text(json.dumps({"files": {"bmf_unified_geocoded.csv": {"bytes": (root / "bmf_unified_geocoded.csv").stat().st_size}}}))
    got = stage_dimension(spark, str(root), str(tmp_path / "cache"), "csv", retry_max=1, backoff=0)
    assert got.status == "downloaded"
    assert [tuple(r) for r in retrieve(spark, got.path, ("EIN2", "org_name_display")).df.collect()] == [("EIN-1", "one")]


def test_state_files_that_lag_or_lack(spark, tmp_path, monkeypatch):
    from cohortloom.sources import dimension

    for s in ("CA", "NY"):
        spark.createDataFrame([(f"ein-{s}", "x")], "EIN2 string, org_name_display string").write.parquet(str(tmp_path / f"state={s}.parquet"))
    with pytest.warns(UserWarning, match="left out"):
        assert dimension.retrieve(spark, str(tmp_path), ("EIN2", "org_name_display"), states=["CA", "NY", "TX"]).df.count() == 2
    with pytest.raises(ValueError):
        dimension.retrieve(spark, str(tmp_path), ("EIN2",), states=["TX"])
    monkeypatch.setattr(dimension, "STATES", ("CA", "NY"))
    with pytest.warns(UserWarning, match="3 rows less"):
        dimension.retrieve(spark, str(tmp_path), ("EIN2", "org_name_display"), states=["CA", "NY"], manifest={"rows": 5})
    with pytest.warns(UserWarning, match="may be older"):
        dimension.retrieve(spark, str(tmp_path), ("EIN2", "org_name_display"), states=["CA", "NY"])


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    from cohortloom.sources import shared

    class Far:
        master = "spark://far:7077"

    class Session:
        sparkContext = Far()

        class conf:
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(RuntimeError):
        shared.shared_folder(Session(), "x")


def test_published_layouts_and_fallbacks(spark, tmp_path):
    import json

    from cohortloom.sources import dimension

    vars = ("EIN2", "org_name_display")
    rows = [(f"EIN-12-000000{i}", f"n{i}", "2026-06" if i else "2025-01", "current") for i in range(4)]
    df = spark.createDataFrame(rows, "EIN2 string, org_name_display string, bmf_vintage_ym string, bmf_source string")
    df.write.parquet(str(tmp_path / "bmf_unified_geocoded.parquet"))
    df.limit(3).coalesce(1).toPandas().to_csv(tmp_path / "bmf_unified_geocoded.csv", index=False)
    (tmp_path / "_manifest.json").write_text(json.dumps({"vintage": "2026_08", "files": {}}))
    (tmp_path / "state=CA").mkdir()
    df.limit(2).toPandas().to_parquet(tmp_path / "state=CA" / "part-0.parquet", index=False)
    df.limit(1).toPandas().to_csv(tmp_path / "bmf_master_NY.csv", index=False)

    def got(**options):
        p = dimension.retrieve(spark, str(tmp_path), vars, **options)
        d = p.diagnostics()
        return p.df.count(), d["source_type"], d["format"], d["states"], d["bmf_vintage"]

    assert got() == (4, "unified_parquet", "parquet", None, "2026_08")
    assert got(format="csv") == (3, "unified_csv", "csv", None, "2026_08")
    assert got(states="ca") == (2, "state_marts", "states", "CA", "2026-06")
    assert got(states="ny") == (1, "state_marts", "states", "NY", "2025-01")
    assert got(states="ny", ids=["nobody"]) == (0, "state_marts", "states", "NY", "2025-01")
    with pytest.warns(UserWarning, match="left out"):
        assert got(format="states") == (2, "state_marts", "states", "CA,NY", "2026-06")
    only = tmp_path / "only"
    only.mkdir()
    df.toPandas().to_csv(only / "bmf_unified_geocoded.csv", index=False)
    p = dimension.retrieve(spark, str(only), vars)
    assert (p.df.count(), p.diagnostics()["source_type"], p.vintage()) == (4, "unified_csv", "2026-06")
    assert dimension.retrieve(spark, df, vars).diagnostics()["source_type"] == "memory"
    with pytest.raises(ValueError):
        dimension.retrieve(spark, str(only), vars, format="xml")
    with pytest.raises(ValueError):
        dimension.retrieve(spark, str(tmp_path / "none"), vars)


def test_a_log_that_two_drivers_write(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from cohortloom.sources.stage import Staged

    at = str(tmp_path / "cache")
    assert retrieval_log(spark, at).count() == 0
    one = Staged(2021, "P00", HEADER, "1x1", "a", "b", "downloaded", 1, 100, 1.26)
    with ThreadPoolExecutor(4) as pool:
        runs = list(pool.map(lambda k: write_log(at, [one] * (k + 1) + [Staged(2022, "P00", HEADER, "1x1", "a", "c", "failed", 3, None, 0.5, "gone")], "bmf" if k else "download"), range(4)))
    (tmp_path / "cache" / "logs" / "download-unfinished").mkdir()  # a driver that died before its marker
    got = retrieval_log(spark, at).collect()
    assert sorted(r.run_id for r in got) == sorted(set(runs)) and [r.recorded_at for r in got] == sorted(r.recorded_at for r in got)
    assert sorted((r.resources, r.downloaded, r.failed, r.bytes, r.elapsed_seconds) for r in got) == [(k + 2, k + 1, 1, 100 * (k + 1), round(1.26 * (k + 1) + 0.5, 1)) for k in range(4)]
    assert {r.log_file for r in got if r.kind == "bmf"} == {f"bmf-{r.run_id}" for r in got if r.kind == "bmf"}
