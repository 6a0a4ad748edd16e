import random

import pytest

from cohortloom.operators.balance import balance
from cohortloom.operators.incremental import MembershipStore, classify_state, covering, membership_state, merge_states, state_years
from cohortloom.operators.membership import classify

SCHEMA = "EIN2 string, TAX_YEAR int, v double"


def some_rows(seed=1, years=(2010, 2011, 2013, 2014, 2015)):
    rnd = random.Random(seed)
    rows = [(f"e{i}", y, 1.0) for i in range(120) for y in years if rnd.random() < 0.6]
    return rows + rnd.sample(rows, 30) + [(None, 2011, 1.0), ("e1", None, 1.0)]


def got(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def test_state_and_one_year_more(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    old, new = df.where("TAX_YEAR < 2015"), df.where("TAX_YEAR = 2015")
    state = merge_states(membership_state(old, 2000), membership_state(new, 2000))
    assert state_years(state, 2000) == [2010, 2011, 2013, 2014, 2015]
    assert got(classify_state(state, 2000)) == got(classify(df)) and classify_state(state, 2000).dtypes == classify(df).dtypes
    # states merge in any order, and rows that come again change nothing
    again = merge_states(membership_state(new, 2000), membership_state(df, 2000), state)
    assert got(again) == got(state)


def test_windows(spark):
    df = spark.createDataFrame(some_rows(2), SCHEMA)
    want = {r.EIN2 for r in balance(df, years=[2013, 2014, 2015]).df.select("EIN2").distinct().collect()}
    assert {r.id for r in covering(membership_state(df, 2005), 2005, 2013, 2015).collect()} == want


def test_odd_rows(spark):
    df = spark.createDataFrame([("a", 1999, 1.0)], SCHEMA)
    with pytest.raises(Exception, match="not one of the 63 years from 2000"):
        membership_state(df, 2000).collect()
    none = membership_state(df.where("v > 5"), 2000)
    assert none.count() == 0 and classify_state(none, 2000).count() == 0
    assert [r.years for r in membership_state(spark.createDataFrame([("a", 2062, 1.0)], SCHEMA), 2000).collect()] == [1 << 62]


def test_store_takes_each_batch_once(spark, tmp_path):
    df = spark.createDataFrame(some_rows(3), SCHEMA)
    store = MembershipStore(spark, str(tmp_path / "state"), 2000)
    with pytest.raises(ValueError):
        store.classify()
    years = [2010, 2011, 2013, 2014, 2015]
    for n, y in enumerate(years):
        store.update(df.where(f"TAX_YEAR = {y}"), n)
        assert got(store.classify()) == got(classify(df.where(f"TAX_YEAR <= {y}")))
    before = got(store.state())
    store.update(spark.createDataFrame([("zz", 2012, 1.0)], SCHEMA), 2)  # a batch that has been taken in
    assert got(store.state()) == before and store.versions() == [3, 4]
    (tmp_path / "state" / "batch=9").mkdir()  # one that a driver left unfinished
    assert store.versions() == [3, 4]
    store.update(df, 9)
    assert store.versions() == [4, 9] and got(store.state()) == before


def test_a_stream_of_table_years(spark, tmp_path):
    df = spark.createDataFrame(some_rows(4), SCHEMA)
    store = MembershipStore(spark, str(tmp_path / "state"), 2000)
    for y in (2010, 2011, 2013):
        df.where(f"TAX_YEAR = {y}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.foreachBatch(store.update)
             .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start())
        q.awaitTermination(120)
        assert got(store.classify()) == got(classify(df.where(f"TAX_YEAR <= {y}")))
