import datetime as dt

from equitylake.plans import jobs
from equitylake.sources.pages import detail_url
from equitylake.sources.store import Store


def listing(links):
    a = "".join(f'<a class="u-hidden -xs" href="/borsa/azioni/scheda/{i}.html?lang=it">'
                f'<span class="t-text">{n}</span></a>' for i, n in links)
    return ('<div data-bb-view="list-aZ-stream"><table class="m-table -firstlevel"><tr><td>'
            + a + "</td></tr></table></div>")


def detail(price, cap, perf):
    def row(label, v):
        return (f"<tr><td><strong>{label}</strong></td><td>"
                f'<span class="t-text -right">{v}</span></td></tr>')
    return ("<table>" + row("Prezzo Ultimo Contratto", price)
            + row("Capitalizzazione di mercato", cap) + row("Performance 1 anno", perf)
            + row("Max Anno", "12,5 - 29/11/24") + "</table>")


def test_discover_then_refresh(spark, tmp_dir):
    store = Store(spark, f"{tmp_dir}/store")
    lp = spark.createDataFrame([
        (1, "l1", listing([("IT0001233417", "A2A"), ("IT0005218380", "Banco BPM")])),
        (2, "l2", listing([("IT0001233417", "A2A"), ("IT00052183", "Bad")])),
        (3, "l3", ""),
    ], "page_id bigint, url string, html string")
    run = jobs.discover(store, lp, dt.datetime(2024, 1, 1)).collect()[0]
    assert (run.scrape.total, run.scrape.successful, run.scrape.parsing_error,
            run.scrape.invalid_page) == (4, 3, 1, 1)
    assert (run.insert.total, run.insert.successful) == (2, 2)
    # rediscovery: known ISINs are refused, the hub is unchanged
    run2 = jobs.discover(store, lp, dt.datetime(2024, 1, 2)).collect()[0]
    assert (run2.insert.total, run2.insert.successful) == (2, 0)
    rej = sorted((r.isin, r.reason, r.job) for r in store.rejects().collect())
    assert rej == [("IT0001233417", "isin_exists", "discover"), ("IT0005218380", "isin_exists", "discover")]
    hub = {r.isin: r for r in store.tables()["share_isins"].collect()}
    assert sorted(hub) == ["IT0001233417", "IT0005218380"]
    assert hub["IT0001233417"].updated_at == dt.datetime(2024, 1, 1)

    from pyspark.sql import functions as F
    dp = spark.createDataFrame([
        ("IT0001233417", detail("1.234,56", "1.000.000", "-3,5%")),
        ("IT0005218380", ""),                      # empty body
    ], "isin string, html string").select(
        F.xxhash64("isin").alias("page_id"), detail_url(F.col("isin")).alias("url"), "html")
    run3 = jobs.refresh(store, dp, dt.timedelta(minutes=15), as_of=dt.datetime(2024, 1, 3)).collect()[0]
    assert (run3.scrape.total, run3.scrape.successful, run3.scrape.invalid_page) == (2, 1, 1)
    assert (run3.insert.total, run3.insert.successful) == (1, 1)
    t = store.tables()
    pd_ = t["price_data"].collect()
    assert len(pd_) == 1 and pd_[0].prezzo_ultimo_contratto == 1234.56
    assert (pd_[0].max_anno, pd_[0].max_anno_date) == (12.5, dt.date(2024, 11, 29))
    assert t["market_information"].collect()[0].capitalizzazione_di_mercato == 1_000_000.0
    assert t["performance_metrics"].collect()[0].performance_1_anno == -3.5
    assert t["share_details"].count() == 1  # all four written together

    # a later refresh with a NULL value keeps the stored one
    dp2 = spark.createDataFrame([("IT0001233417", detail("2,00", "n/d", "1,0"))],
                                "isin string, html string").select(
        F.xxhash64("isin").alias("page_id"), detail_url(F.col("isin")).alias("url"), "html")
    jobs.refresh_all(store, dp2, as_of=dt.datetime(2024, 1, 4))
    t = store.tables()
    m = t["market_information"].collect()[0]
    assert m.capitalizzazione_di_mercato == 1_000_000.0 and m.updated_at == dt.datetime(2024, 1, 4)
    assert t["price_data"].collect()[0].prezzo_ultimo_contratto == 2.0
    assert store.runs().count() == 4
    assert store.head()["version"] == 4


def test_refresh_from_attempt_log(spark, tmp_dir):
    from equitylake import schemas
    from equitylake.plans import api
    store = Store(spark, f"{tmp_dir}/store2")
    isins = ["IT0001233417", "IT0005218380", "IT0003128367", "IT0000062072"]
    hub = spark.createDataFrame([(i, f"n{i}", dt.datetime(2024, 1, 1)) for i in isins], schemas.HUB)
    store.write({"share_isins": hub})
    t0 = dt.datetime(2024, 1, 2)
    sec = lambda s: t0 + dt.timedelta(seconds=s)
    from equitylake.sources.pages import DETAIL_URL
    url = lambda i: DETAIL_URL % i
    rows = [
        (url(isins[0]), 1, 503, False, None, sec(0), sec(1)),
        (url(isins[0]), 2, 200, False, detail("1,50", "10", "2"), sec(3), sec(4)),
        (url(isins[1]), 1, 404, False, None, sec(0), sec(1)),          # exit
        (url(isins[2]), 1, 200, False, "", sec(0), sec(1)),            # empty body
        (url(isins[3]), 1, 500, False, None, sec(0), sec(1)),
        (url(isins[3]), 2, 200, False, detail("3", "1", "1"), sec(300), sec(301)),  # too late
    ]
    log = spark.createDataFrame(rows, "url string, attempt_no int, status int, net_error boolean, "
                                      "body string, started_at timestamp_ntz, ended_at timestamp_ntz")
    run = api.run_scrape_and_insert(store, attempts=log).collect()[0]
    assert (run.scrape.total, run.scrape.successful, run.scrape.network_error,
            run.scrape.invalid_page, run.scrape.timeout) == (4, 1, 1, 1, 1)
    p = store.tables()["price_data"].collect()
    assert [(r.isin, r.prezzo_ultimo_contratto) for r in p] == [(isins[0], 1.5)]
    import json
    docs = [json.loads(r.json) for r in api.share(store, isin=isins[0]).collect()]
    assert docs[0]["price_data"]["prezzo_ultimo_contratto"] == 1.5
    assert api.all_isins(store).count() == 4 and api.all_shares(store).count() == 4
    api.export_shares(store, f"{tmp_dir}/export-shares")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_dir}/export-shares").collect()]
    assert len(lines) == 4 and all("price_data" in d and "share_id" in d for d in lines)


def test_page_copies_and_missing_pages(spark):
    from pyspark.sql import functions as F
    inst = spark.createDataFrame([("IT0001233417",), ("IT0005218380",)], "isin string")
    url = detail_url(F.lit("IT0001233417"))
    copies = spark.range(30).select((F.col("id") + 1).alias("page_id"), url.alias("url"),
                                    F.lit(detail("1,50", "10", "2")).alias("html"))
    for bc in (False, True):
        scanned = jobs.scan_requested(inst, copies, broadcast_requests=bc)
        rows = scanned.collect()
        assert sum(1 for r in rows if r.isin == "IT0001233417") == 30
        missing = [r for r in rows if r.isin == "IT0005218380"]
        assert len(missing) == 1 and missing[0].page_id is None
        out = {r.isin: r.error for r in jobs.outcomes_of(scanned).collect()}
        assert out == {"IT0001233417": None, "IT0005218380": "network_error"}
        recs = jobs.records_of(scanned, dt.datetime(2024, 1, 5))
        assert recs.count() == 30 and recs.select("isin").distinct().count() == 1
