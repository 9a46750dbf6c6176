import datetime as dt

from pyspark.sql import functions as F

from equitylake import schemas
from equitylake.plans import views
from equitylake.plans.layout import Layout
from equitylake.sources.store import Store

T0 = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(days=1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_due_set_and_prefix_read_matching_directories(spark, tmp_dir):
    store = Store(spark, f"{tmp_dir}/store", buckets=2)
    assert Layout.of(store) is None
    countries = ["IT", "it", "FR", "FI", "DE"]
    hub = [(f"{countries[k % 5]}{k:010d}", f"N{k}", T0) for k in range(60)]
    stamps = [(i, 1.0, "c", T0 + DAY * (k % 20 * 5 - 20) + dt.timedelta(hours=k % 3)) for k, (i, _, _) in enumerate(hub) if k % 7]
    store.write({"share_isins": spark.createDataFrame(hub, schemas.HUB),
                 "share_details": spark.createDataFrame(stamps, schemas.DETAILS)})
    assert Layout.write(store).path == Layout.of(store).path
    layout, tables = Layout.of(store), store.tables()
    for days, hours in ((0, 0), (3, 2), (31, 1), (60, 23), (-20_000, 0), (400, 0)):
        as_of = T0 + DAY * days + dt.timedelta(hours=hours)
        want = views.stale_set(tables, DAY, as_of).collect()
        assert sorted(map(tuple, layout.due(DAY, as_of).collect())) == sorted(map(tuple, want))
    due = layout.due(DAY, T0 + DAY * 3)
    assert "PartitionFilters: [isnotnull(month" in plan(due) and "PushedFilters: [IsNotNull(updated_at), LessThan" in plan(due)
    read = {f.split("month=")[1].split("/")[0] for f in due.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert read == {"1970-01-01", "2023-12-01", "2024-01-01"}
    for lang in ("IT", "it0", "f", "FI", "xx", "%", "_T", "it00000000"):
        q = views.ShareQuery(lang=lang)
        got = views.query_shares(tables, q, layout=layout).select("isin", "updated_at").collect()
        want = [r for r in views.query_shares(tables, q).select("isin", "updated_at").collect()]
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)), lang
    q = views.ShareQuery(lang="it", name="n1")
    assert views.query_shares(tables, q, layout=layout).count() == views.query_shares(tables, q).count() > 0
    assert "PartitionFilters: [isnotnull(country" in plan(layout.with_prefix("IT"))
    assert layout.with_prefix("I%") is None and layout.with_prefix("") is None
    # another version has no layout until one is written
    store.write({"share_isins": spark.createDataFrame(hub[:5], schemas.HUB)})
    assert Layout.of(store) is None
    Layout.write(store)
    assert Layout.of(store).due(DAY, T0 + DAY * 400).count() == 5
