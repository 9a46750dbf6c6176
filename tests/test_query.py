import datetime as dt

from equitylake import schemas
from equitylake.plans import views

T = dt.datetime


def store(spark):
    hub = spark.createDataFrame([
        ("IT0001233417", "A2A", T(2024, 1, 1)),
        ("IT0000000001", "Banca 50% Spa", T(2024, 1, 1)),
        ("FR0000000002", "Air_Lines", T(2024, 1, 1)),
        ("DE0000000003", "Never", T(2024, 1, 1)),
    ], schemas.HUB)
    sd = spark.createDataFrame([("IT0001233417", 1.0, "c", T(2024, 3, 1))], schemas.DETAILS)
    pm = spark.createDataFrame([("IT0000000001", 1.0, 2.0, 3.0, T(2024, 2, 1)),
                                ("FR0000000002", None, None, None, T(2024, 5, 1))], schemas.PERFORMANCE)
    empty = lambda s: spark.createDataFrame([], s)
    return {"share_isins": hub, "share_details": sd, "market_information": empty(schemas.MARKET),
            "price_data": empty(schemas.PRICE), "performance_metrics": pm}


def isins(df):
    return sorted(r.isin for r in df.collect())


def test_dispatch_arms(spark):
    s = store(spark)
    Q = views.ShareQuery
    assert isins(views.query_shares(s, Q(isin="IT0001233417", name="zz", lang="FR"))) == ["IT0001233417"]
    assert isins(views.query_shares(s, Q(lang="it"))) == ["IT0000000001", "IT0001233417"]
    assert isins(views.query_shares(s, Q(name="a"))) == ["FR0000000002", "IT0000000001", "IT0001233417"]
    assert isins(views.query_shares(s, Q(name="air", lang="fr"))) == ["FR0000000002"]
    assert len(isins(views.query_shares(s, Q()))) == 4
    assert isins(views.query_shares(s, Q(isin="it0001233417"))) == []  # exact, case-sensitive


def test_wildcards_and_backslash(spark):
    s = store(spark)
    Q = views.ShareQuery
    # '%' and '_' typed by the caller stay wildcards
    assert isins(views.query_shares(s, Q(name="50%spa"))) == ["IT0000000001"]
    assert isins(views.query_shares(s, Q(name="r_l"))) == ["FR0000000002"]
    # escaped wildcard is literal
    assert isins(views.query_shares(s, Q(name=r"50\%"))) == ["IT0000000001"]
    assert isins(views.query_shares(s, Q(name=r"a\_l"))) == []
    # backslash before an ordinary character is dropped, not an error
    assert isins(views.query_shares(s, Q(name=r"\a2a"))) == ["IT0001233417"]


def test_empty_string_params(spark):
    s = store(spark)
    assert views.ShareQuery.from_request(name="", isin="", lang="") == views.ShareQuery()
    # constructed directly, "" is kept: isin = '' matches nothing
    assert isins(views.query_shares(s, views.ShareQuery(isin=""))) == []


def test_view_newest_stamp(spark):
    v = {r.isin: r for r in views.current_view(store(spark)).collect()}
    assert v["IT0001233417"].updated_at == T(2024, 3, 1)
    assert v["FR0000000002"].updated_at == T(2024, 5, 1)
    assert v["DE0000000003"].updated_at == T(2024, 1, 1)


def test_stale_set_boundaries(spark):
    s = store(spark)
    # never refreshed -> epoch -> always due; boundary is inclusive
    got = views.stale_set(s, dt.timedelta(days=1), as_of=T(2024, 3, 2))
    assert isins(got) == ["DE0000000003", "IT0000000001", "IT0001233417"]
    got = views.stale_set(s, dt.timedelta(days=1), as_of=T(2024, 3, 1, 23, 59, 59))
    assert isins(got) == ["DE0000000003", "IT0000000001"]
    # hub stamp is not part of the staleness
    row = [r for r in got.collect() if r.isin == "DE0000000003"][0]
    assert row.updated_at == T(1970, 1, 1)
    # an overflowing duration counts as zero
    assert len(isins(views.stale_set(s, dt.timedelta(days=999_999_999), as_of=T(2024, 6, 1)))) == 4


def test_nested_json(spark):
    import json
    s = store(spark)
    j = {json.loads(r.json)["share_id"]["share_name"]: json.loads(r.json)
         for r in views.shares_json(views.current_view(s)).collect()}
    a = j["A2A"]
    assert a["share_id"]["isin"] == {"country": "IT", "nna": "000123341", "check": 7}
    assert a["price_data"]["max_anno"] == {"price": None, "date": None}
    assert a["performance_metrics"]["performance_1_mese"] is None
    assert a["share_details"]["updated_at"] == a["updated_at"]


def test_nested_bad_isin(spark):
    s = store(spark)
    s["share_isins"] = s["share_isins"].union(
        spark.createDataFrame([("BAD", "x", T(2024, 1, 1))], schemas.HUB))
    v = views.current_view(s)
    assert views.nested_shares(v).count() == 4
    assert [r.isin for r in views.nested_rejects(v).collect()] == ["BAD"]


def test_json_timestamp_text(spark):
    import json
    s = store(spark)
    docs = [json.loads(r.json) for r in views.shares_json(views.current_view(s)).collect()]
    a = [d for d in docs if d["share_id"]["share_name"] == "A2A"][0]
    assert a["updated_at"] == "2024-03-01T00:00:00"
    from pyspark.sql import functions as F
    from equitylake.functions.parsers import iso_ntz
    got = spark.sql("select timestamp_ntz'2024-11-29 16:07:46.12' a, timestamp_ntz'2024-11-29 16:07:46.123456' b") \
        .select(iso_ntz(F.col("a")).alias("a"), iso_ntz(F.col("b")).alias("b")).first()
    assert (got.a, got.b) == ("2024-11-29T16:07:46.120", "2024-11-29T16:07:46.123456")


def test_result_summary_logs(spark, caplog):
    import logging
    s = store(spark)
    with caplog.at_level(logging.INFO, logger="equitylake"):
        assert views.result_summary(views.query_shares(s, views.ShareQuery(isin="none"))) == 0
        assert views.result_summary(views.query_shares(s)) == 4
    assert "found no share" in caplog.text and "got a total of 4 shares" in caplog.text


def test_cluster_conf_is_valid(spark):
    from equitylake.session import CLUSTER_CONF
    old = {k: spark.conf.get(k, None) for k in CLUSTER_CONF}
    try:
        for k, v in CLUSTER_CONF.items():
            spark.conf.set(k, v)
            assert spark.conf.get(k) == v
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_current_time_is_utc(spark):
    """Without ``as_of`` the current UTC wall-clock time counts, whatever the zone of the machine."""
    from equitylake.plans import jobs
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    hub = spark.createDataFrame([(f"IT000000000{k}", f"N{k}", now) for k in range(3)], schemas.HUB)
    tables = {"share_isins": hub, **{t: spark.createDataFrame([], s) for t, s in schemas.SATELLITES.items()}}
    tables["share_details"] = spark.createDataFrame(
        [("IT0000000000", 1.0, "c", now - dt.timedelta(minutes=40)), ("IT0000000001", 1.0, "c", now - dt.timedelta(minutes=10))],
        schemas.DETAILS)
    due = {r.isin for r in views.stale_set(tables, dt.timedelta(minutes=30)).collect()}
    assert due == {"IT0000000000", "IT0000000002"}  # the last has no stamp at all
    pages = spark.createDataFrame([(1, "u", "<table></table>")], "page_id long, url string, html string")
    scanned = jobs.X.scan_properties(pages).withColumn("isin", jobs.F.lit("IT0000000000"))
    stamp = jobs.records_of(scanned).first().updated_at
    assert abs(stamp - dt.datetime.now(dt.UTC).replace(tzinfo=None)) < dt.timedelta(minutes=5)
