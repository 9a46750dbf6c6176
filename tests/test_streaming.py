import datetime as dt

from pyspark.sql import functions as F

from equitylake.sources.pages import detail_url
from equitylake.sources.store import Store
from equitylake.streaming import ingest
from equitylake import schemas


def page(price):
    return ("<table><tr><td><strong>Prezzo Ultimo Contratto</strong></td>"
            f'<td><span class="t-text -right">{price}</span></td></tr></table>')


def write_pages(spark, d, rows):
    (spark.createDataFrame(rows, "isin string, html string")
     .select(F.xxhash64("isin").alias("page_id"), detail_url(F.col("isin")).alias("url"), "html")
     .coalesce(1).write.mode("append").parquet(d))


def test_stream_refresh(spark, tmp_dir):
    store = Store(spark, f"{tmp_dir}/store")
    hub = spark.createDataFrame([("IT0001233417", "A2A", dt.datetime(2024, 1, 1))], schemas.HUB)
    store.write({"share_isins": hub})
    pages_dir = f"{tmp_dir}/pages"
    write_pages(spark, pages_dir, [("IT0001233417", page("1,50")), ("XX0000000000", page("9,99"))])
    q = ingest.start_page_ingest(store, pages_dir, f"{tmp_dir}/ckpt", available_now=True)
    q.awaitTermination(120)
    p = store.tables()["price_data"].collect()
    assert [(r.isin, r.prezzo_ultimo_contratto) for r in p] == [("IT0001233417", 1.5)]
    # a second file arrives: a new micro-batch, a new version
    write_pages(spark, pages_dir, [("IT0001233417", page("2,00"))])
    q = ingest.start_page_ingest(store, pages_dir, f"{tmp_dir}/ckpt", available_now=True)
    q.awaitTermination(120)
    assert store.tables()["price_data"].collect()[0].prezzo_ultimo_contratto == 2.0
    v = store.head()["version"]
    # replaying a recorded batch id changes nothing
    stream = ingest.stream_id(spark, f"{tmp_dir}/ckpt")
    ingest.refresh_batch(store, spark.read.parquet(pages_dir), stream, 0)
    assert store.head()["version"] == v
    # another stream (or a fresh checkpoint) starts at batch 0 and is not skipped
    other = f"{tmp_dir}/other"
    write_pages(spark, other, [("IT0001233417", page("3,00"))])
    ingest.start_page_ingest(store, other, f"{tmp_dir}/ckpt2", available_now=True).awaitTermination(120)
    assert store.tables()["price_data"].collect()[0].prezzo_ultimo_contratto == 3.0
    assert store.head()["version"] == v + 1


def test_parse_stream_memory_sink(spark, tmp_dir):
    d = f"{tmp_dir}/p"
    write_pages(spark, d, [("IT0001233417", page("1.234,5"))])
    q = (ingest.parse_stream(ingest.page_stream(spark, d)).writeStream.format("memory")
         .queryName("parsed_rows").trigger(availableNow=True).start())
    q.awaitTermination(120)
    rows = spark.sql("SELECT label, as_number FROM parsed_rows").collect()
    assert [(r.label, r.as_number) for r in rows] == [("prezzo ultimo contratto", 1234.5)]


def test_page_streams_deal_the_pages_of_a_micro_batch_over_files(spark, monkeypatch):
    """A micro-batch whose pages lie in one small file is scanned by one task."""
    from types import SimpleNamespace

    from conftest import SF001

    from equitylake.plans import catalog
    from equitylake.streaming import discovery
    seen = []

    def start(store, pages_dir, checkpoint, max_files_per_trigger, **how):
        pages = spark.read.parquet(pages_dir)
        seen.append((pages.count(), len(pages.inputFiles()), max_files_per_trigger))
        return SimpleNamespace(awaitTermination=lambda: None)
    monkeypatch.setattr(ingest, "start_page_ingest", start)
    monkeypatch.setattr(discovery, "start_discovery", start)
    catalog.stream_refresh_view(spark, SF001)
    catalog.stream_discovery(spark, SF001)
    assert seen[0][0] == seen[1][0] > 0  # every page in either ingest
    assert [-(-files // trigger) for _, files, trigger in seen[:2]] == [1, 2]
    assert min(trigger for _, _, trigger in seen[:2]) >= 2 and seen[2][1] > 3
