import datetime as dt

from equitylake import schemas
from equitylake.sources.store import Store

T0 = dt.datetime(2024, 1, 1)


def test_versions_and_uncommitted_leftovers(spark, tmp_dir):
    store = Store(spark, f"{tmp_dir}/s")
    assert store.head() is None
    assert all(df.count() == 0 for df in store.tables().values())
    hub = spark.createDataFrame([("IT0001233417", "A2A", T0)], schemas.HUB)
    assert store.write({"share_isins": hub}) == 1
    # a run that died after writing data but before committing
    hub2 = spark.createDataFrame([("IT0000000001", "X", T0)], schemas.HUB)
    hub2.write.parquet(f"{tmp_dir}/s/share_isins/v=2-deadbeef")
    assert [r.isin for r in store.tables()["share_isins"].collect()] == ["IT0001233417"]
    # the next write still succeeds and becomes version 2
    assert store.write({"share_isins": hub.unionByName(hub2)}) == 2
    assert store.tables()["share_isins"].count() == 2
    # unchanged tables keep pointing at their earlier version
    assert store.head()["share_details"] is None


def test_empty_table_version(spark, tmp_dir):
    store = Store(spark, f"{tmp_dir}/e")
    empty = spark.createDataFrame([], schemas.DETAILS)
    store.write({"share_details": empty}, shuffle=False)
    assert store.tables()["share_details"].count() == 0
    hub = spark.createDataFrame([("IT0001233417", "A2A", T0)], schemas.HUB)
    store.write({"share_isins": hub})
    t = store.tables()
    assert t["share_isins"].count() == 1 and t["share_details"].count() == 0


def test_path_with_quote(spark, tmp_dir):
    store = Store(spark, f"{tmp_dir}/it's here")
    hub = spark.createDataFrame([("IT0001233417", "A2A", T0)], schemas.HUB)
    store.write({"share_isins": hub})
    assert store.tables()["share_isins"].count() == 1


def test_unreadable_commits_are_an_error(spark, tmp_dir):
    import os

    import pytest
    store = Store(spark, f"{tmp_dir}/broken")
    hub = spark.createDataFrame([("IT0001233417", "A2A", T0)], schemas.HUB)
    store.write({"share_isins": hub})
    with open(f"{tmp_dir}/broken/_commits/part-x.parquet", "wb") as f:
        f.write(b"half-written")
    assert os.path.exists(f"{tmp_dir}/broken/_commits/part-x.parquet")
    with pytest.raises(Exception):
        store.tables()
    with pytest.raises(Exception):
        store.write({"share_isins": hub})


def test_commit_carries_the_batch(spark, tmp_dir):
    store = Store(spark, f"{tmp_dir}/b")
    hub = spark.createDataFrame([("IT0001233417", "A2A", T0)], schemas.HUB)
    store.write({"share_isins": hub}, batch=("s1", 0))
    assert store.has_batch("s1", 0) and not store.has_batch("s2", 0) and not store.has_batch("s1", 1)


def test_rebucket(spark, tmp_dir):
    store = Store(spark, f"{tmp_dir}/r")
    hub = spark.createDataFrame([(f"IT{i:010d}", "A", T0) for i in range(50)], schemas.HUB)
    store.write({"share_isins": hub})
    assert store.head()["buckets"] == 8  # the least, for so few rows
    assert store.rebucket(3) == 2 and store.head()["buckets"] == 3
    assert store.tables()["share_isins"].count() == 50 and store.head()["share_details"] is None
