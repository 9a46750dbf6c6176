"""Stand-in store built from the driver's TPC-H-style tables.

The driver ships no equity data, so the five store tables are derived from
``customer``, ``nation`` and ``orders`` with fixed rules (each customer is
one listed instrument, its orders are its trades). The rules only shape
rows into the store's schema; every query then runs the library's own
operators on them. The DuckDB oracle repeats the same rules as CTEs
(``equitylake.oracle``).

hub ``share_isins`` (one row per customer)
    isin = first two letters of the market segment, the key left-padded to
    nine digits, and the key's last digit as check digit (keys below 10^9);
    share_name = c_name; updated_at = 1995-01-01 + key minutes.
``share_details``: customers with a non-negative balance.
``market_information``: customers joined to their nation.
``price_data``: one snapshot per customer of its orders up to ``as_of``;
    the "year" fields look at the 365 days before ``as_of``.
``performance_metrics``: customers with an order in that year window.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_input
from ..functions.parsers import ntz_lit

EPOCH_1995 = dt.datetime(1995, 1, 1)
SNAPSHOT_AS_OF = dt.datetime(2001, 12, 31)
CUT = dt.datetime(2000, 1, 1)


def _ts(x: dt.datetime) -> Column:
    return ntz_lit(x)


def isin_of(segment: Column, key: Column) -> Column:
    return F.concat(F.upper(F.substring(segment, 1, 2)),
                    F.lpad(key.cast("string"), 9, "0"),
                    (key % 10).cast("string"))


def _minutes_after_1995(m: Column) -> Column:
    return F.timestamp_add("MINUTE", m, _ts(EPOCH_1995))


def hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_input(spark, sf_dir, "customer")
    return c.select(isin_of(F.col("c_mktsegment"), F.col("c_custkey")).alias("isin"),
                    F.col("c_name").alias("share_name"),
                    _minutes_after_1995(F.col("c_custkey")).alias("updated_at"))


def listed_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hub as known before a write batch: instruments with a
    non-negative balance are listed, the others not yet."""
    c = read_input(spark, sf_dir, "customer").where(F.col("c_acctbal") >= 0)
    return c.select(isin_of(F.col("c_mktsegment"), F.col("c_custkey")).alias("isin"),
                    F.col("c_name").alias("share_name"),
                    _minutes_after_1995(F.col("c_custkey")).alias("updated_at"))


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_input(spark, sf_dir, "customer").where(F.col("c_acctbal") >= 0)
    return c.select(
        isin_of(F.col("c_mktsegment"), F.col("c_custkey")).alias("isin"),
        F.col("c_custkey").cast("double").alias("id_strumento"),
        F.concat(F.upper(F.substring("c_mktsegment", 1, 3)), F.lit("-"),
                 F.col("c_nationkey").cast("string")).alias("codice_alfanumerico"),
        _minutes_after_1995(F.col("c_custkey") + 60).alias("updated_at"))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_input(spark, sf_dir, "customer")
    n = read_input(spark, sf_dir, "nation")
    # nation is a fixed 25-row dimension: broadcasting it is size-bounded
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return j.select(
        isin_of(F.col("c_mktsegment"), F.col("c_custkey")).alias("isin"),
        F.col("n_name").alias("super_sector"),
        F.col("c_mktsegment").alias("mercato_segmento"),
        (F.col("c_acctbal") * F.lit(1000.0)).alias("capitalizzazione_di_mercato"),
        ((F.col("n_regionkey") + 1) * 100).cast("double").alias("lotto_minimo"),
        _minutes_after_1995(F.col("c_custkey") + 120).alias("updated_at"))


def _trade_aggs(window_start: Column, window_end: Column) -> list[Column]:
    """Per-instrument trade-tape aggregates; all are partial-aggregatable
    (map-side combine), so a customer holding a third of all orders still
    reduces to one small row per task before the shuffle."""
    d, k, p = F.col("o_orderdate"), F.col("o_orderkey"), F.col("o_totalprice")
    in_year = d >= window_start
    since = lambda days: d >= window_end - F.make_dt_interval(F.lit(days))
    return [
        F.max(F.struct(d.alias("d"), k.alias("k"), p.alias("p"),
                       F.col("o_orderstatus").alias("s"))).alias("last"),
        F.min(F.struct(d.alias("d"), k.alias("k"), p.alias("p"))).alias("first"),
        F.max(F.struct(p.alias("p"), d.alias("d"), k.alias("k"))).alias("hi_all"),
        F.min(F.struct(p.alias("p"), d.alias("d"), k.alias("k"))).alias("lo_all"),
        F.max(F.when(in_year, F.struct(p.alias("p"), d.alias("d"), k.alias("k")))).alias("hi"),
        F.min(F.when(in_year, F.struct(p.alias("p"), d.alias("d"), k.alias("k")))).alias("lo"),
        F.min(F.when(in_year, F.struct(d.alias("d"), k.alias("k"), p.alias("p")))).alias("first_y"),
        F.min(F.when(since(182), F.struct(d.alias("d"), k.alias("k"), p.alias("p")))).alias("first_6m"),
        F.min(F.when(since(30), F.struct(d.alias("d"), k.alias("k"), p.alias("p")))).alias("first_1m"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(in_year).alias("n_y"),
        F.round(F.sum(p), 2).alias("total"),
    ]


def _closing(d: Column) -> Column:
    return F.timestamp_add("HOUR", F.lit(18), d)


def _price_cols() -> list[Column]:
    last, first = F.col("last"), F.col("first")
    chg = last["p"] - first["p"]
    return [
        F.when(last["s"] == "O", F.lit("Negoziazione continua"))
         .when(last["s"] == "F", F.lit("Chiusura")).alias("fase_di_mercato"),
        last["p"].alias("prezzo_ultimo_contratto"),
        (chg / first["p"] * 100).alias("var_percentuale"),
        chg.alias("var_assoluta"),
        (F.col("total") / F.col("n")).alias("pr_medio_progr"),
        last["d"].alias("data_ora_ultimo_contratto"),
        F.col("n_y").cast("double").alias("quantita_ultimo"),
        F.col("n").cast("double").alias("quantita_totale"),
        F.col("n").cast("int").alias("numero_contratti"),
        F.col("total").alias("controvalore"),
        F.greatest(last["p"], first["p"]).alias("max_oggi"),
        F.col("hi")["p"].alias("max_anno"),
        F.col("hi")["d"].cast("date").alias("max_anno_date"),
        F.least(last["p"], first["p"]).alias("min_oggi"),
        F.col("lo")["p"].alias("min_anno"),
        F.col("lo")["d"].cast("date").alias("min_anno_date"),
        F.col("lo_all")["p"].alias("chiusura_precedente"),
        F.col("hi_all")["p"].alias("prezzo_riferimento"),
        F.col("hi_all")["d"].alias("data_ora_prezzo_rifermento"),
        last["p"].alias("prezzo_ufficiale"),
        last["d"].cast("date").alias("data_prezzo_ufficiale"),
        first["p"].alias("apertura_odierna"),
        _closing(last["d"]).alias("updated_at"),
    ]


def _perf_cols() -> list[Column]:
    last = F.col("last")
    pct = lambda ref: (last["p"] - F.col(ref)["p"]) / F.col(ref)["p"] * 100
    return [pct("first_1m").alias("performance_1_mese"),
            pct("first_6m").alias("performance_6_mesi"),
            pct("first_y").alias("performance_1_anno"),
            _closing(last["d"]).alias("updated_at")]


def _with_isin(spark, sf_dir, per_cust: DataFrame) -> DataFrame:
    c = read_input(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return per_cust.join(c, per_cust.o_custkey == c.c_custkey) \
        .withColumn("isin", isin_of(F.col("c_mktsegment"), F.col("c_custkey")))


def _trades_of(spark, sf_dir, agg: DataFrame) -> dict[str, DataFrame]:
    """The price and performance tables of one frame of trade snapshots."""
    snapshot = _with_isin(spark, sf_dir, agg)
    return {"price_data": snapshot.select("isin", *_price_cols()),
            "performance_metrics": snapshot.where(F.col("n_y") > 0).select("isin", *_perf_cols())}


def _orders_snapshot(spark, sf_dir, as_of: dt.datetime) -> DataFrame:
    o = read_input(spark, sf_dir, "orders").where(F.col("o_orderdate") <= _ts(as_of))
    agg = o.groupBy("o_custkey").agg(
        *_trade_aggs(_ts(as_of - dt.timedelta(days=365)), _ts(as_of)))
    return _with_isin(spark, sf_dir, agg)


def price(spark: SparkSession, sf_dir: str, as_of: dt.datetime = SNAPSHOT_AS_OF) -> DataFrame:
    return _orders_snapshot(spark, sf_dir, as_of).select("isin", *_price_cols())


def performance(spark: SparkSession, sf_dir: str,
                as_of: dt.datetime = SNAPSHOT_AS_OF) -> DataFrame:
    return (_orders_snapshot(spark, sf_dir, as_of).where(F.col("n_y") > 0)
            .select("isin", *_perf_cols()))


def _yearly_orders(spark, sf_dir, after: dt.datetime) -> DataFrame:
    """One trade snapshot per (customer, calendar year) of orders after
    ``after``: several records per instrument in one batch."""
    o = (read_input(spark, sf_dir, "orders").where(F.col("o_orderdate") >= _ts(after))
         .withColumn("yr", F.year("o_orderdate")))
    start = F.make_timestamp_ntz(F.col("yr"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    end = F.make_timestamp_ntz(F.col("yr"), F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0))
    agg = o.groupBy("o_custkey", "yr").agg(*_trade_aggs(start, end))
    return _with_isin(spark, sf_dir, agg)


def price_batch(spark: SparkSession, sf_dir: str, after: dt.datetime = CUT) -> DataFrame:
    return _yearly_orders(spark, sf_dir, after).select("isin", *_price_cols())


def performance_batch(spark: SparkSession, sf_dir: str, after: dt.datetime = CUT) -> DataFrame:
    return _yearly_orders(spark, sf_dir, after).select("isin", *_perf_cols())


def share_batch(spark: SparkSession, sf_dir: str, after: dt.datetime = CUT) -> DataFrame:
    """All records of a write batch in one frame, each marked with the
    satellites it has (``_has_<table>``): the orders are read once for both
    trade tables."""
    no_stamp = lambda cols: cols[:-1]  # noqa: E731  the stamp comes last, the same in both
    trades = _yearly_orders(spark, sf_dir, after).select("isin", *no_stamp(_price_cols()), *_perf_cols())
    mark = lambda df, *ts: df.withColumns({f"_has_{t}": F.lit(True) for t in ts})
    return (mark(trades, "price_data", "performance_metrics")
            .unionByName(mark(details_batch(spark, sf_dir), "share_details"), allowMissingColumns=True)
            .unionByName(mark(market_batch(spark, sf_dir), "market_information"), allowMissingColumns=True))


def details_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New detail records for customers with a balance below 1000 (some
    known, some not yet in ``details``); building-segment codes are absent."""
    c = read_input(spark, sf_dir, "customer").where(F.col("c_acctbal") < 1000)
    return c.select(
        isin_of(F.col("c_mktsegment"), F.col("c_custkey")).alias("isin"),
        (F.col("c_custkey") + F.lit(0.5)).alias("id_strumento"),
        F.when(F.col("c_mktsegment") != "BUILDING",
               F.concat(F.lit("N-"), F.col("c_custkey").cast("string"))).alias("codice_alfanumerico"),
        _minutes_after_1995(F.col("c_custkey") + 1440).alias("updated_at"))


def market_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New market records for customers of European nations; the market
    cap is absent for negative balances."""
    c = read_input(spark, sf_dir, "customer")
    n = read_input(spark, sf_dir, "nation")
    r = read_input(spark, sf_dir, "region").where(F.col("r_name") == "EUROPE")
    nr = n.join(r, n.n_regionkey == r.r_regionkey)
    j = c.join(F.broadcast(nr), c.c_nationkey == nr.n_nationkey)
    return j.select(
        isin_of(F.col("c_mktsegment"), F.col("c_custkey")).alias("isin"),
        F.col("r_name").alias("super_sector"),
        F.lit(None).cast("string").alias("mercato_segmento"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") * F.lit(2000.0)).alias("capitalizzazione_di_mercato"),
        F.lit(None).cast("double").alias("lotto_minimo"),
        _minutes_after_1995(F.col("c_custkey") + 2880).alias("updated_at"))


def store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All five store tables."""
    return {"share_isins": hub(spark, sf_dir),
            "share_details": details(spark, sf_dir),
            "market_information": market(spark, sf_dir),
            "price_data": price(spark, sf_dir),
            "performance_metrics": performance(spark, sf_dir)}


# ---- stand-in detail pages -------------------------------------------------

def _esc(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")),
                               F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _label(term: str) -> str:
    # the site's row labels: title-cased terms, accented letters as entities
    return term.title().replace("à", "&agrave;")


def _it(c: Column, decimals: int = 20) -> Column:
    return F.translate(F.format_number(c, decimals), ",.", ".,")


def _rendered_value(name: str, kind: str) -> Column:
    from ..schemas import PRICE_STRUCTS
    c = F.col(name)
    if kind == "float":
        return _it(c)
    if kind == "text":
        return _esc(c)
    if kind == "datetime":
        return F.date_format(c, "dd/MM/yy HH.mm.ss")
    if kind == "int":
        return F.translate(F.format_number(c, 0), ",", ".")
    _, tcol, tname = PRICE_STRUCTS[name]
    fmt = "dd/MM/yy" if tname == "date" else "dd/MM/yy HH.mm.ss"
    both_null = c.isNull() & F.col(tcol).isNull()
    return F.when(~both_null, F.concat(F.coalesce(_it(c), F.lit("")), F.lit(" - "),
                                       F.coalesce(F.date_format(tcol, fmt), F.lit(""))))


def _row(label: str, value: Column) -> Column:
    head = f"<tr><td><strong>{label}</strong></td><td>"
    return F.when(value.isNull(), F.lit(head + "</td></tr>")).otherwise(
        F.concat(F.lit(head + '<span class="t-text -right">'), value, F.lit("</span></td></tr>")))


def render_detail_pages(view: DataFrame) -> DataFrame:
    """One site-like detail page per instrument of the current view.

    Stand-in fetch results: instruments of the AUTOMOBILE segment have no
    page (never fetched), instruments without a details record have an
    empty body. The page lists every property as a labelled row (a row
    without a value when the stored value is NULL), starts with an older
    duplicate of the last-price row, has a row without a label and keeps
    the three performance rows in a nested table.
    """
    from ..schemas import PROPERTIES
    from .pages import detail_url
    main = [_row(_label(term), _rendered_value(name, kind))
            for name, term, table, kind in PROPERTIES if table != "performance_metrics"]
    perf = [_row(_label(term), _rendered_value(name, kind))
            for name, term, table, kind in PROPERTIES if table == "performance_metrics"]
    html = F.concat(
        F.lit('<!DOCTYPE html><html><head><title>Scheda</title><script>var t="</td>";</script>'
              '</head><body><div class="l-box"><table class="m-table">'),
        _row(_label("prezzo ultimo contratto"), F.lit("0,00")),
        *main,
        F.lit('<tr><td>Nota</td><td><span class="t-text -right">n/d</span></td></tr>'
              '<tr><td colspan="2"><table class="m-table -nested">'),
        *perf,
        F.lit("</table></td></tr></table></div></body></html>"))
    # a stored page table arrives in many file splits: deal out the instruments'
    # rows (not their HTML) likewise before they are rendered
    parts = int(view.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (view.where(F.col("mercato_segmento").isNull() | (F.col("mercato_segmento") != "AUTOMOBILE"))
            .repartition(parts, F.substring("isin", 3, 9))
            .select(F.substring("isin", 3, 9).cast("bigint").alias("page_id"),
                    detail_url(F.col("isin")).alias("url"),
                    F.when(F.col("id_strumento").isNull(), F.lit("")).otherwise(html).alias("html")))


# ---- stand-in fetch log ------------------------------------------------------

def fetch_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawler's attempt log shaped from ``events``: each run of eight
    consecutive event ids is one URL and its attempts 1-8; the event type
    gives the HTTP answer (view 200, click 503, error 500, purchase 429,
    signup 404, or a transport error when its value is below 50); a 200
    with a value below 5 has an empty body. An attempt lasts value/10 s and
    the crawler waits 2^(k-1) s before attempt k; the first attempt starts
    at the earliest event time of the URL.
    """
    from pyspark.sql import Window
    e = read_input(spark, sf_dir, "events")
    url = F.format_string("https://fetch.example.org/u/%d", F.expr("event_id div 8"))
    net = (F.col("event_type") == "signup") & (F.col("value") < 50)
    status = (F.when(net, F.lit(None))
              .when(F.col("event_type") == "view", F.lit(200))
              .when(F.col("event_type") == "click", F.lit(503))
              .when(F.col("event_type") == "error", F.lit(500))
              .when(F.col("event_type") == "purchase", F.lit(429))
              .otherwise(F.lit(404))).cast("int")
    a = e.select(url.alias("url"), (F.col("event_id") % 8 + 1).cast("int").alias("attempt_no"),
                 status.alias("status"), net.alias("net_error"),
                 F.when(status == 200, F.when(F.col("value") < 5, F.lit("")).otherwise(F.col("props")))
                 .alias("body"),
                 F.round(F.col("value") * 100).cast("bigint").alias("dur_ms"), "ts")
    # each URL has at most eight attempts: these windows are bounded
    w = Window.partitionBy("url")
    prev = F.coalesce(F.sum("dur_ms").over(
        w.orderBy("attempt_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    waits = (F.expr("shiftleft(1, attempt_no)") - 2) * 1000
    start = F.timestamp_add("MILLISECOND", prev + waits, F.min("ts").over(w))
    return a.select("url", "attempt_no", "status", "net_error", "body",
                    start.alias("started_at"),
                    F.timestamp_add("MILLISECOND", F.col("dur_ms"), start).alias("ended_at"))


# ---- stand-in listing pages -------------------------------------------------

LINKS_PER_PAGE = 50


def render_listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site-like A-Z listing pages of every customer-instrument.

    A page holds the instruments of one initial (first letter of the market
    segment) among 50 consecutive keys, so at most 50 links. Instruments
    with a negative balance link to an 11-character ISIN (a parsing
    error), those of nation 0 have no name span (an invalid link). Every
    page also carries a decoy link outside the listing block, and the last
    page of each initial is served twice (as the site does for pages past
    the end).
    """
    from .pages import LISTING_URL
    c = read_input(spark, sf_dir, "customer")
    isin = isin_of(F.col("c_mktsegment"), F.col("c_custkey"))
    href = F.concat(F.lit("/borsa/azioni/scheda/"),
                    F.when(F.col("c_acctbal") >= 0, isin).otherwise(F.substring(isin, 1, 11)),
                    F.lit(".html?lang=it"))
    name = F.when(F.col("c_nationkey") != 0,
                  F.concat(F.lit('<span class="t-text">'), _esc(F.col("c_name")), F.lit("</span>")))
    link = F.concat(F.lit('<a class="u-hidden -xs" href="'), href, F.lit('">'),
                    F.coalesce(name, F.lit("")), F.lit("</a>"))
    keyed = c.select(F.upper(F.substring("c_mktsegment", 1, 1)).alias("letter"),
                     (F.expr("c_custkey div 50") + 1).cast("int").alias("page"),
                     F.struct(F.col("c_custkey").alias("k"), link.alias("html")).alias("l"))
    # at most 50 links per (letter, page) by construction
    pages = keyed.groupBy("letter", "page").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    body = F.concat(
        F.lit('<html><body><nav><a class="u-hidden -xs" href="/borsa/azioni/scheda/IT0000000000.html">'
              '<span class="t-text">Fuori lista</span></a></nav>'
              '<div data-bb-view="list-aZ-stream"><table class="m-table -firstlevel"><tr><td>'),
        F.array_join(F.transform("ls", lambda x: x["html"]), ""),
        F.lit("</td></tr></table></div></body></html>"))
    out = pages.select("letter", "page", body.alias("html"))
    last = out.groupBy("letter").agg(F.max("page").alias("page"))
    repeat = out.join(last, ["letter", "page"]).withColumn("page", F.col("page") + 1)
    both = out.unionByName(repeat)
    return both.select(
        (F.ascii("letter").cast("bigint") * 1_000_000 + F.col("page")).alias("page_id"),
        F.format_string(LISTING_URL, F.col("letter"), F.col("page")).alias("url"), "html")
