import random

import pytest
from plan import count, total

from cohortloom.plans.catalog import data_source
from cohortloom.sources import distinct
from cohortloom.sources.distinct import count_rows, distinct_rows, profile_rows
from cohortloom.sources.tables import read_manifest, read_table, read_tables

HEADER = "F9-P00-T00-HEADER"
SCHEMA = ", ".join(f"c{i} string" for i in range(10)) + ", n double, `dot.ted` int"


def wide_rows(spark, n, repeats, seed=1):
    rnd = random.Random(seed)
    rows = [tuple(rnd.choice([None, "", "a", f"v{rnd.random()}" * 10]) for _ in range(10)) + (rnd.choice([None, 0.0, -0.0, float("nan")]), i) for i in range(n)]
    rows += [rnd.choice(rows) for _ in range(repeats)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def got(df):
    return sorted(str(r).replace("n=-0.0", "n=0.0") for r in df.collect())  # equal numbers


@pytest.mark.parametrize("n,repeats", [(500, 0), (500, 30), (100, 300), (0, 0), (1, 1)])
@pytest.mark.parametrize("limit", ["10m", "-1"], ids=["broadcast", "shuffled"])
def test_same_as_whole_rows(spark, n, repeats, limit):
    df = wide_rows(spark, n, repeats)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        p = profile_rows([df])[0]
        assert (p.rows, p.distinct) == (n + repeats, df.distinct().count()) == count_rows([df])[0]
        assert got(distinct_rows(df)) == got(df.dropDuplicates())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_nulls_in_other_places_are_other_rows(spark):
    rows = [tuple("x" if i == k else None for i in range(9)) for k in range(9)] * 2 + [(None,) * 9] * 3
    df = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(9)))
    assert count_rows([df]) == [(21, 10)]
    assert distinct_rows(df).count() == 10


def test_rows_that_share_a_hash_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(distinct, "row_hash", lambda df: [distinct.F.lit(1).cast("long").alias("h1"), distinct.F.col("`c0`").isNull().cast("long").alias("h2")])
    monkeypatch.setattr(distinct, "OFTEN", 0)
    df = wide_rows(spark, 60, 9)
    assert got(distinct_rows(df)) == got(df.dropDuplicates())


def test_what_is_shuffled(spark, tmp_path):
    wide_rows(spark, 4000, 20).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    whole = total(df.dropDuplicates(), "ShuffleExchangeExec", "dataSize")
    hashes = total(distinct._hash_counts([df]), "ShuffleExchangeExec", "dataSize")
    few = total(distinct_rows(df, profile_rows([df])[0]), "ShuffleExchangeExec", "dataSize")
    assert hashes < whole / 5 and few < whole / 50


def test_projection_reaches_the_scan(spark, tmp_path):
    wide_rows(spark, 200, 0).write.parquet(f"{tmp_path}/t")
    df = read_table(spark.read.parquet(f"{tmp_path}/t"), 2020, columns=["c1"])
    assert count(df, "ShuffleExchangeExec") == 0
    assert "ReadSchema: struct<c1:string>" in df._jdf.queryExecution().toString()


def test_counts_of_table_years(spark, tmp_path):
    for y, n, repeats in ((2020, 50, 5), (2021, 0, 0), (2022, 40, 0)):
        wide_rows(spark, n, repeats, y).withColumnRenamed("c0", "EIN2").write.parquet(f"{tmp_path}/{HEADER}-{y}.parquet")
    tables = read_tables(spark, "P00", [2020, 2021, 2022, 2023], data_source(str(tmp_path)))
    rows = [(r.year, r.status, r.rows_source, r.rows_selected, r.exact_duplicates_removed) for r in read_manifest(spark, tables).collect()]
    assert rows == [(2020, "virtual", 55, 50, 5), (2021, "virtual", 0, 0, 0), (2022, "virtual", 40, 40, 0), (2023, "failed", None, None, None)]
    some = read_tables(spark, "P00", [2020, 2022], data_source(str(tmp_path)), filters={"EIN2": ["a"]})
    want = {y: spark.read.parquet(f"{tmp_path}/{HEADER}-{y}.parquet").where("upper(EIN2) = 'A'").distinct().count() for y in (2020, 2022)}
    assert [(r.rows_source, r.rows_selected) for r in read_manifest(spark, some).collect()] == [(55, want[2020]), (40, want[2022])]
