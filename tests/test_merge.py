import random
from functools import reduce

import pytest
from plan import count

from cohortloom.plans.assemble import panelize
from cohortloom.plans.catalog import data_source
from cohortloom.plans.merge import join_tables, merge_unique


def some_tables(spark, n, seed=1):
    """Tables with one row a key, of which each holds a part; null keys and null values among them."""
    rnd = random.Random(seed)
    keys = [(None if i % 9 == 0 else f"e{i}", i // 3 if i % 5 else None) for i in range(60)]
    keys = list(dict.fromkeys(keys))
    parts = []
    for t in range(n):
        rows = [(e, o, rnd.choice([None, "a", "b"]), rnd.choice([None, 1.5, float("nan")])) for e, o in rnd.sample(keys, 40)]
        parts.append((f"T{t}", spark.createDataFrame(rows, f"EIN2 string, OBJECTID int, x{t} string, `y.{t}` double")))
    return parts


def got(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def one_by_one(parts, **options):
    return reduce(lambda left, p: join_tables(left, p[1], p[0], **options), parts[1:], parts[0][1])


@pytest.mark.parametrize("n", [2, 4, 8])
def test_same_as_joins_with_one_shuffle(spark, n):
    parts = some_tables(spark, n)
    merged, joined = merge_unique(parts), one_by_one(parts)
    assert merged.columns == joined.columns and merged.dtypes == joined.dtypes
    assert got(merged) == got(joined)
    assert count(merged, "ShuffleExchangeExec") == 1


def test_collisions_kinds_and_columns_that_look_like_ours(spark):
    a = spark.createDataFrame([("1", 1, "p"), ("2", 2, "q"), (None, 3, "r")], "EIN2 string, OBJECTID int, k0 string")
    b = spark.createDataFrame([("1", "1", "s", 7), (None, "3", "t", 8), ("4", "4", "u", 9)], "EIN2 string, OBJECTID string, k0 string, t1 int")
    c = spark.createDataFrame([("4", 4), ("5", 5)], "EIN2 string, OBJECTID int")
    parts = [("A", a), ("B", b), ("C", c)]
    with pytest.raises(ValueError, match="k0"):
        merge_unique(parts)
    merged = merge_unique(parts, collision="prefix")
    assert merged.columns == ["EIN2", "OBJECTID", "k0", "B__k0", "t1"]
    assert got(merged) == got(one_by_one(parts, collision="prefix"))
    with pytest.raises(ValueError, match="shared join keys"):
        merge_unique([("A", a), ("Z", c.select("OBJECTID").withColumnRenamed("OBJECTID", "z"))])


def test_tables_without_the_same_keys_are_joined(spark):
    parts = some_tables(spark, 2) + [("P", spark.createDataFrame([(1, "z"), (2, "w")], "OBJECTID int, p string"))]
    assert got(merge_unique(parts)) == got(one_by_one(parts))


def test_no_rows_and_keys_only(spark):
    none = spark.createDataFrame([], "EIN2 string, v int")
    some = spark.createDataFrame([("1",), (None,)], "EIN2 string")
    assert got(merge_unique([("A", none), ("B", some)])) == [("1", "None"), ("None", "None")]
    assert got(merge_unique([("A", some), ("B", some)])) == [("1",), ("None",)]
    assert merge_unique([("A", none), ("B", none.withColumnRenamed("v", "w"))]).count() == 0


def test_panel_of_four_tables_is_one_shuffle_a_year(spark, tmp_path):
    names = ["F9-P00-T00-HEADER", "F9-P01-T00-SUMMARY", "F9-P08-T00-REVENUE", "F9-P09-T00-EXPENSES"]
    for t, name in enumerate(names):
        df = spark.createDataFrame([(f"e{i}", f"o{i}", "2021", str(i * t)) for i in range(t, 30)], f"EIN2 string, OBJECTID string, TAX_YEAR string, c{t} string")
        df.write.parquet(f"{tmp_path}/{name}-2021.parquet")
    p = panelize(spark, ["P00", "P01", "P08", "P09"], [2021], data_source(str(tmp_path)), unique_rows=False)
    assert count(p.df, "ShuffleExchangeExec") == 1
    assert p.df.count() == 30 and [j["left"].count("+") for j in p.joins] == [0, 1, 2]
    assert {r.EIN2: (r.c0, r.c3) for r in p.df.collect()}["e2"] == ("0", None)
