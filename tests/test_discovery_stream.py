import datetime as dt

from pyspark.sql import functions as F

from equitylake import schemas
from equitylake.plans import views
from equitylake.plans.names import NameIndex
from equitylake.sources.store import Store
from equitylake.streaming import discovery, ingest

T0 = dt.datetime(2024, 1, 1)


def listing(*links):
    body = "".join(f'<a class="u-hidden -xs" href="/s/{isin}.html"><span class="t-text">{name}</span></a>' for isin, name in links)
    return f'<div data-bb-view="list-aZ-stream"><table class="m-table -firstlevel"><tr><td>{body}</td></tr></table></div>'


def write(spark, d, *pages):
    rows = [(k, f"u{k}", html) for k, html in enumerate(pages)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(d)


def hub(store):
    return sorted((r.isin, r.share_name, r.updated_at) for r in store.tables()["share_isins"].collect())


def test_discovery_on_a_stream(spark, tmp_dir):
    store, names = Store(spark, f"{tmp_dir}/store", buckets=2), NameIndex(spark, f"{tmp_dir}/names", parts=2)
    known = spark.createDataFrame([("IT0000000001", "Known", T0)], schemas.HUB)
    store.write({"share_isins": known})
    names.add(known)
    d, ck = f"{tmp_dir}/pages", f"{tmp_dir}/ck"
    a, b, old = ("IT0000000011", "Alfa"), ("IT0000000022", "Beta"), ("IT0000000001", "Renamed")

    def run():
        q = discovery.start_discovery(store, d, ck, available_now=True, as_of=T0, max_files_per_trigger=1, names=names)
        assert q.awaitTermination(240) and q.exception() is None
    write(spark, d, listing(a, old), listing(a, ("ITbad", "x")), "")
    run()
    assert hub(store) == [("IT0000000001", "Known", T0), (*a, T0)]
    write(spark, d, listing(("IT0000000011", "Alfa again"), b))  # a known ISIN keeps its first name
    run()
    everything = hub(store)
    assert everything == [("IT0000000001", "Known", T0), (*a, T0), (*b, T0)]
    version, path = store.head()["version"], store.head()["share_isins"]
    # a replayed batch changes nothing, neither hub nor rejects nor runs
    before = store.rejects().count(), store.runs().count()
    discovery.discover_batch(store, spark.read.parquet(d), ingest.stream_id(spark, ck), 0, T0)
    assert store.head()["version"] == version and (store.rejects().count(), store.runs().count()) == before
    # a batch of known instruments commits its mark and rewrites nothing
    write(spark, d, listing(a, b))
    run()
    assert store.head()["version"] == version + 1 and store.head()["share_isins"] == path and hub(store) == everything
    assert store.runs().where(F.col("job") == "stream_discover").count() == 3
    assert views.query_shares(store.tables(), views.ShareQuery(name="beta"), names).first().isin == "IT0000000022"
