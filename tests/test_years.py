"""All years of a panel in one shuffle: what is written, verified, merged and kept doesn't grow with the number of table-years."""

import pytest
from plan import count

from cohortloom.plans.assemble import merge_tables, panelize, repeating, single_years
from cohortloom.plans.catalog import data_source
from cohortloom.plans.dictionary import FILING_KEYS
from cohortloom.plans.frame import create_frame
from cohortloom.sources.shared import write_each
from cohortloom.sources.tables import read_tables, stack

HEADER, SUMMARY = "F9-P00-T00-HEADER", "F9-P01-T00-SUMMARY"
KEYS = "EIN2 string, OBJECTID string, TAX_YEAR string"


def put(spark, root, name, year, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}-{year}.parquet")


@pytest.fixture
def no_broadcast(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


@pytest.fixture
def source(spark, tmp_path):
    """A form in the header alone, so that the tables share but a part of their keys; repeated rows, null keys, filings in one table alone."""
    for y in (2019, 2020, 2021, 2022):
        head = [(f"e{i}", f"o{i}", str(y), "990") for i in range(40) if (i + y) % 3] + [(" E1 ", "x", str(y), None), (None, "n", str(y), "990")]
        more = [(f"e{i}", f"o{i}", str(y), str(i)) for i in range(20, 60)] + [(None, "n", str(y), "7"), ("e1", None, str(y), None)]
        put(spark, tmp_path, HEADER, y, head + head[:5], f"{KEYS}, RETURN_TYPE string")
        put(spark, tmp_path, SUMMARY, y, more + more[-3:], f"{KEYS}, F9_01_REV_TOT_CY string")
    return data_source(str(tmp_path))


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())


def required():
    return create_frame(record="OBJECTID").add_rule("require", present_in=2)


def test_shuffles_do_not_grow_with_years(spark, source, no_broadcast):
    two, four = (panelize(spark, ["P00", "P01"], years, source, required()).df for years in ([2019, 2020], [2019, 2020, 2021, 2022]))
    assert count(two, "ShuffleExchangeExec") == count(four, "ShuffleExchangeExec")
    plain = panelize(spark, ["P00", "P01"], [2019, 2020, 2021, 2022], source).df
    assert count(plain, "ShuffleExchangeExec") == 1


def test_the_same_as_joins_of_each_year(spark, source):
    years = [2019, 2020, 2021, 2022]
    reads = read_tables(spark, ["P00", "P01"], years, source)
    keys = list(dict.fromkeys(["EIN2", "TAX_YEAR", "OBJECTID", *FILING_KEYS]))  # the frame's own come first
    joined = stack(list(merge_tables(reads, keys, verify=False)[0].values()))
    merged = panelize(spark, ["P00", "P01"], years, source).df
    assert merged.columns == joined.columns and merged.dtypes == joined.dtypes
    assert rows(merged) == rows(joined)


def test_kept_at_the_scan_or_after_the_merge(spark, source):
    def made():
        p = panelize(spark, ["P00", "P01"], [2019, 2020, 2021], source, required())
        return rows(p.df), [tuple(r) for r in p.manifest().collect()], [tuple(r) for r in p.sources().drop("path").collect()]

    small = made()
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert made() == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_repeated_shared_keys_are_joined(spark, tmp_path):
    """The header's own keys are single, those that it shares aren't: a summary goes to both of its rows."""
    for y in (2021, 2022):
        put(spark, tmp_path, HEADER, y, [("1", "o", str(y), "990"), ("1", "o", str(y), "990EZ"), ("2", "p", str(y), "990")], f"{KEYS}, RETURN_TYPE string")
        put(spark, tmp_path, SUMMARY, y, [("1", "o", str(y), "5")] if y == 2021 else [("2", "p", str(y), "6")], f"{KEYS}, F9_01_REV_TOT_CY string")
    df = panelize(spark, ["P00", "P01"], [2021, 2022], data_source(str(tmp_path))).df
    got = {(r.EIN2, r.TAX_YEAR, r.RETURN_TYPE, r.F9_01_REV_TOT_CY) for r in df.collect()}
    assert df.count() == 6 and got == {("1", 2021, "990", 5.0), ("1", 2021, "990EZ", 5.0), ("2", 2021, "990", None), ("1", 2022, "990", None), ("1", 2022, "990EZ", None), ("2", 2022, "990", 6.0)}


def test_repeated_keys_raise_but_for_entities_that_go(spark, tmp_path, no_broadcast):
    for y in (2021, 2022):
        bad = [("9", "o9", str(y), "990", "a"), ("9", "o9", str(y), "990", "b")] if y == 2022 else []
        put(spark, tmp_path, HEADER, y, [("1", "o", str(y), "990", "a"), *bad], f"{KEYS}, RETURN_TYPE string, x string")
        put(spark, tmp_path, SUMMARY, y, [("1", "o", str(y), "5")], f"{KEYS}, F9_01_REV_TOT_CY string")
    s = data_source(str(tmp_path))
    for columns in (None, ["RETURN_TYPE"]):  # also where the column that tells them apart isn't read
        with pytest.raises(ValueError, match="1 repeated keys in F9-P00-T00-HEADER of 2022"):
            panelize(spark, ["P00", "P01"], [2021, 2022], s, columns=columns)
    kept = panelize(spark, ["P00", "P01"], [2021, 2022], s, create_frame(record="OBJECTID").add_rule("require", present_in="all"))
    assert sorted((r.EIN2, r.TAX_YEAR) for r in kept.df.collect()) == [("1", 2021), ("1", 2022)]


def test_repeats_count_where_they_are_kept(spark, source):
    whole, each = (read_tables(spark, ["P00", "P01"], [2021], source, unique_rows=u) for u in (True, False))
    by = ["EIN2", "OBJECTID", "TAX_YEAR"]
    assert repeating([(t, by) for t in whole]) == set() and repeating([(t, by) for t in each]) == {0, 1}
    assert single_years(whole) == {2021: by}
    with pytest.raises(ValueError, match="repeated keys"):
        single_years(each)


def test_years_written_in_one_scan(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "id % 3 as y")
    at = {y: f"{tmp_path}/t-{y}.parquet" for y in (0, 2)}
    write_each(df, "y", at)
    assert {y: sorted(r.id for r in spark.read.parquet(p).collect()) for y, p in at.items()} == {y: list(range(y, 100, 3)) for y in at}
    assert spark.read.parquet(at[0]).columns == ["id"] and sorted(p.name for p in tmp_path.iterdir()) == ["t-0.parquet", "t-2.parquet"]
    with pytest.raises(FileExistsError):
        write_each(df, "y", {1: f"{tmp_path}/t-1.parquet", **at})
    with pytest.raises(ValueError, match="no rows of y 7"):
        write_each(df, "y", {1: f"{tmp_path}/u-1.parquet", 7: f"{tmp_path}/u-7.parquet"})
