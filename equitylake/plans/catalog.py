"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the input tables of ``sf_dir`` through the stand-in
store (``sources.adapter``) and runs the library's operators on all of
their rows; ``equitylake.oracle`` holds the matching DuckDB SQL.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsers as P
from ..operators import merge as M
from ..operators import metrics as MT
from ..operators import extract as X
from ..operators import fetchlog as FL
from ..operators import html_scan
from ..sources import adapter
from ..sources.pages import detail_url
from ..sources.tables import read_input
from . import jobs, views

# Lookup parameters of the registered view queries.
LOOKUP_ISIN = "MA0000000011"
LOOKUP_LANG = "fu"
LOOKUP_NAME = "r#00000001"
STALE_AS_OF = dt.datetime(2001, 9, 1, 12, 0, 0)
STALE_MIN_AGE = dt.timedelta(days=120)
RUN_AS_OF = dt.datetime(2002, 1, 15, 9, 30, 0)
REFRESH_MIN_AGE = dt.timedelta(days=120)


def _store(spark, sf_dir):
    return adapter.store(spark, sf_dir)


def current_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every instrument with all attributes and its newest update time."""
    return views.current_view(_store(spark, sf_dir))


def stored_view(spark, sf_dir):
    """The store written as a new version of a bucketed, versioned store
    (under spark.checkpoint.dir), read back and joined into the current
    view -- the five joins run without a shuffle."""
    from ..session import staging_path
    from ..sources.store import Store
    st = Store(spark, staging_path(spark, "store"))
    st.write(_store(spark, sf_dir))
    return views.current_view(st.tables())


def _name_index(spark, hub):
    from ..session import staging_path
    from .names import NameIndex
    names = NameIndex(spark, staging_path(spark, "names"), parts=16)
    names.add(hub)
    return names


def view_by_name_indexed(spark, sf_dir):
    """Lookup by a part of the name in a stored trigram index: the hub is not read."""
    store = _store(spark, sf_dir)
    return views.query_shares(store, views.ShareQuery(name=LOOKUP_NAME), _name_index(spark, store["share_isins"]))


def view_by_prefix_and_name_indexed(spark, sf_dir):
    """Prefix and part of the name, by the index."""
    store = _store(spark, sf_dir)
    return views.query_shares(store, views.ShareQuery(lang="Ho", name=LOOKUP_NAME),
                              _name_index(spark, store["share_isins"]))


def _laid_out(spark, sf_dir):
    from ..session import staging_path
    from ..sources.store import Store
    from .layout import Layout
    st = Store(spark, staging_path(spark, "laid-out"))
    st.write(_store(spark, sf_dir))
    Layout.write(st)
    return st, Layout.of(st)


def stale_set_layout(spark, sf_dir):
    """The due set from a stored layout by month of the newest stamp."""
    _, layout = _laid_out(spark, sf_dir)
    return layout.due(STALE_MIN_AGE, STALE_AS_OF)


def view_by_prefix_layout(spark, sf_dir):
    """Lookup by ISIN prefix in a stored layout by country."""
    st, layout = _laid_out(spark, sf_dir)
    return views.query_shares(st.tables(), views.ShareQuery(lang=LOOKUP_LANG), layout=layout)


def view_by_isin(spark, sf_dir):
    """Lookup by exact ISIN."""
    return views.query_shares(_store(spark, sf_dir), views.ShareQuery(isin=LOOKUP_ISIN))


def view_by_prefix(spark, sf_dir):
    """Lookup by case-insensitive ISIN prefix (country)."""
    return views.query_shares(_store(spark, sf_dir), views.ShareQuery(lang=LOOKUP_LANG))


def view_by_name(spark, sf_dir):
    """Lookup by case-insensitive name substring."""
    return views.query_shares(_store(spark, sf_dir), views.ShareQuery(name=LOOKUP_NAME))


def view_by_prefix_and_name(spark, sf_dir):
    """Lookup by ISIN prefix and name substring together."""
    return views.query_shares(_store(spark, sf_dir),
                              views.ShareQuery(name=LOOKUP_NAME, lang="Ho"))


def view_isin_wins(spark, sf_dir):
    """isin given together with name and lang: only isin filters."""
    q = views.ShareQuery.from_request(name="zzz", isin=LOOKUP_ISIN, lang="XX")
    return views.query_shares(_store(spark, sf_dir), q)


def view_prefix_backslash(spark, sf_dir):
    """A prefix that ends in a backslash: it escapes the wildcard that follows,
    so only instruments with a percent sign there would match."""
    return views.query_shares(_store(spark, sf_dir), views.ShareQuery(lang="ma\\"))


def view_request_empty_params(spark, sf_dir):
    """Request parameters that are empty strings mean 'absent': the lang
    prefix alone filters."""
    q = views.ShareQuery.from_request(name="", isin="", lang="ma")
    return views.query_shares(_store(spark, sf_dir), q)


def stale_set(spark, sf_dir):
    """Instruments whose newest satellite stamp is 120 days old or more."""
    return views.stale_set(_store(spark, sf_dir), STALE_MIN_AGE, STALE_AS_OF)


_JSON_BACK = ("share_id STRUCT<share_name STRING, isin STRUCT<country STRING, nna STRING, "
              "`check` INT>>, share_details STRUCT<codice_alfanumerico STRING>, "
              "price_data STRUCT<max_anno STRUCT<price DOUBLE, date DATE>, "
              "prezzo_riferimento STRUCT<price DOUBLE, datetime TIMESTAMP_NTZ>, "
              "numero_contratti BIGINT>, performance_metrics STRUCT<performance_1_anno DOUBLE>, "
              "market_information STRUCT<updated_at TIMESTAMP_NTZ>")


def nested_share_json(spark, sf_dir):
    """Nested JSON of every share (null fields written), read back."""
    return json_read_back(_store(spark, sf_dir))


def json_read_back(tables: dict[str, DataFrame]) -> DataFrame:
    j = views.shares_json(views.current_view(tables))
    r = j.select(F.from_json("json", _JSON_BACK).alias("r"), "json")
    return r.select(
        F.col("r.share_id.isin.country").alias("country"),
        F.col("r.share_id.isin.nna").alias("nna"),
        F.col("r.share_id.isin.check").alias("check_digit"),
        F.col("r.share_id.share_name").alias("share_name"),
        F.col("r.share_details.codice_alfanumerico").alias("codice_alfanumerico"),
        F.col("r.price_data.max_anno.price").alias("max_anno_price"),
        F.col("r.price_data.max_anno.date").alias("max_anno_date"),
        F.col("r.price_data.prezzo_riferimento.datetime").alias("rif_datetime"),
        F.col("r.price_data.numero_contratti").alias("numero_contratti"),
        F.col("r.performance_metrics.performance_1_anno").alias("perf_1_anno"),
        F.col("r.market_information.updated_at").alias("market_stamp"),
        F.col("r.performance_metrics").isNotNull().alias("has_perf_object"),
        (F.locate('"performance_1_mese":null', F.col("json")) > 0).alias("perf_1m_null"),
    )


def isins_json(spark, sf_dir):
    """Instrument list as JSON ({share_name, isin{country, nna, check},
    updated_at}), read back."""
    j = views.isins_json(adapter.hub(spark, sf_dir))
    r = j.select(F.from_json("json", "share_name STRING, isin STRUCT<country STRING, nna STRING, "
                                     "`check` INT>, updated_at TIMESTAMP_NTZ").alias("r"))
    return r.select(F.col("r.share_name").alias("share_name"),
                    F.col("r.isin.country").alias("country"), F.col("r.isin.nna").alias("nna"),
                    F.col("r.isin.check").alias("check_digit"),
                    F.col("r.updated_at").alias("updated_at"))


# ---- typed value parsers ---------------------------------------------------

def it_number(c, decimals: int = 2):
    """Render a number the Italian way: dots for thousands, comma for decimals."""
    return F.translate(F.format_number(c, decimals), ",.", ".,")


def number_parse(spark, sf_dir):
    """Every lineitem price rendered as '1.234,56', '1,234.56' and
    '-1.234,56 %' and parsed back, plus the return flag as '+R' (not a
    number: NULL)."""
    li = read_input(spark, sf_dir, "lineitem")
    it = it_number(F.col("l_extendedprice"))
    us = F.format_number(F.col("l_extendedprice"), 2)
    neg = F.concat(F.lit("  -"), it, F.lit(" %"))
    return li.select("l_orderkey", "l_linenumber",
                     P.parse_float(it).alias("price_it"),
                     P.parse_float(us).alias("price_us"),
                     P.parse_float(neg).alias("price_neg"),
                     P.parse_float(F.concat(F.lit("+"), F.col("l_returnflag"))).alias("junk"))


def int_parse(spark, sf_dir):
    """Every order key rendered with dot thousands separators and parsed
    back, plus the same with a minus sign (unsigned: NULL)."""
    o = read_input(spark, sf_dir, "orders")
    dots = lambda n: F.translate(F.format_number(n, 0), ",", ".")
    dotted = dots(F.col("o_orderkey"))
    return o.select("o_orderkey",
                    P.parse_int(dotted).alias("parsed"),
                    P.parse_int(F.concat(F.lit("-"), dotted)).alias("negative"),
                    P.int_overflow(dots(F.col("o_orderkey") * 1000000)).alias("past_int"))


def parse_defaults(spark, sf_dir):
    """The default flavour of every parser, on order prices as they are and on
    status letters that are no value of any kind."""
    o = read_input(spark, sf_dir, "orders")
    junk = F.col("o_orderstatus")
    pair = P.parse_or_default("price_date", junk)
    return o.select("o_orderkey",
                    P.parse_or_default("float", it_number(F.col("o_totalprice"))).alias("price"),
                    P.parse_or_default("float", junk).alias("float_default"),
                    P.parse_or_default("int", junk).alias("int_default"),
                    P.parse_or_default("text", F.nullif(junk, F.lit("O"))).alias("text_default"),
                    P.parse_or_default("datetime", junk).alias("datetime_default"),
                    (pair.isNotNull() & pair["price"].isNull() & pair["date"].isNull()).alias("pair_default"))


def datetime_parse(spark, sf_dir):
    """Every event time rendered 'dd/MM/yy HH.mm.ss' and 'd/M/yy - H.m.s'
    and parsed back, plus the first form with trailing text (NULL)."""
    e = read_input(spark, sf_dir, "events")
    f1 = F.date_format("ts", "dd/MM/yy HH.mm.ss")
    f2 = F.date_format("ts", "d/M/yy - H.m.s")
    return e.select("event_id",
                    P.parse_datetime(f1).alias("dt1"),
                    P.parse_datetime(f2).alias("dt2"),
                    P.parse_datetime(F.concat(f1, F.lit(" x"))).alias("trailing"),
                    P.parse_datetime(F.concat(f1, F.lit("\n"))).alias("newline"))


def date_parse(spark, sf_dir):
    """Every ship date rendered 'd/M/yy' (years 1995-2001 cross the
    two-digit-year pivot) and parsed back."""
    li = read_input(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     P.parse_date(F.date_format("l_shipdate", "d/M/yy")).alias("ship_date"),
                     P.parse_date(F.concat(F.date_format("l_shipdate", "d/M/yy"), F.lit("\n"))).alias("newline"))


def price_date_split(spark, sf_dir):
    """Every order as 'price - dd/MM/yy' split into {price, date}, plus
    the price alone (no separator: NULL pair)."""
    o = read_input(spark, sf_dir, "orders")
    s = P.price_date(F.concat(it_number(F.col("o_totalprice")), F.lit(" - "),
                              F.date_format("o_orderdate", "dd/MM/yy")))
    nosep = P.price_date(it_number(F.col("o_totalprice")))
    newline = P.price_date(F.concat(it_number(F.col("o_totalprice")), F.lit(" - "),
                                    F.date_format("o_orderdate", "dd/MM/yy"), F.lit("\n")))
    return o.select("o_orderkey", s["price"].alias("price"), s["date"].alias("date"),
                    newline["date"].alias("newline"),
                    nosep.isNull().alias("no_separator_is_null"))


def price_datetime_split(spark, sf_dir):
    """Every event as 'value - dd/MM/yy HH.mm.ss' split into {price,
    datetime}; error events carry a leading minus, which is taken as the
    separator (both fields NULL, struct present)."""
    e = read_input(spark, sf_dir, "events")
    sign = F.when(F.col("event_type") == "error", F.lit("-")).otherwise(F.lit(""))
    s = P.price_datetime(F.concat(sign, it_number(F.col("value")), F.lit(" - "),
                                  F.date_format("ts", "dd/MM/yy HH.mm.ss")))
    return e.select("event_id", s["price"].alias("price"), s["datetime"].alias("datetime"),
                    s.isNotNull().alias("present"))


def isin_parse(spark, sf_dir):
    """Every stored ISIN plus two corrupted copies (13 bytes; letter as
    check digit) parsed into {country, nna, check} and formatted back."""
    hub = adapter.hub(spark, sf_dir)
    variants = hub.select(F.explode(F.array(
        F.col("isin"), F.concat("isin", F.lit("X")),
        F.concat(F.substring("isin", 1, 11), F.lit("Z")))).alias("raw"))
    parsed = variants.select("raw", P.parse_isin(F.col("raw")).alias("p"),
                             P.isin_error(F.col("raw")).alias("error"))
    return parsed.select("raw", F.col("p.country").alias("country"), F.col("p.nna").alias("nna"),
                         F.col("p.check").cast("int").alias("check_digit"), "error",
                         P.format_isin(F.col("p")).alias("formatted"))


# ---- write path -------------------------------------------------------------

def upsert_price(spark, sf_dir):
    """Price snapshot at the cut date, then every later yearly snapshot of
    each instrument collapsed in order (last non-NULL per column) and
    merged null-preservingly."""
    stored = adapter.price(spark, sf_dir, adapter.CUT)
    batch = M.collapse_batch(adapter.price_batch(spark, sf_dir), "price_data")
    return M.merge_satellite(stored, batch, "price_data")


def upsert_performance(spark, sf_dir):
    stored = adapter.performance(spark, sf_dir, adapter.CUT)
    batch = M.collapse_batch(adapter.performance_batch(spark, sf_dir), "performance_metrics")
    return M.merge_satellite(stored, batch, "performance_metrics")


def upsert_details(spark, sf_dir):
    batch = M.collapse_batch(adapter.details_batch(spark, sf_dir), "share_details")
    return M.merge_satellite(adapter.details(spark, sf_dir), batch, "share_details")


def upsert_market(spark, sf_dir):
    batch = M.collapse_batch(adapter.market_batch(spark, sf_dir), "market_information")
    return M.merge_satellite(adapter.market(spark, sf_dir), batch, "market_information")


def _listed_hub(spark, sf_dir):
    return adapter.listed_hub(spark, sf_dir)


def _judged_batch(spark, sf_dir):
    return M.judge_shares(M.collapse_shares(adapter.share_batch(spark, sf_dir)), _listed_hub(spark, sf_dir))


def fk_rejects(spark, sf_dir):
    """Share payloads whose ISIN is not in the hub (all four tables refused)."""
    return M.rejects_of(_judged_batch(spark, sf_dir))


def share_write_accepted(spark, sf_dir):
    """All-or-nothing per share: the accepted ISINs' merged price rows."""
    batch = M.payload(M.accepted_shares(_judged_batch(spark, sf_dir)), "price_data")
    return M.merge_satellite(adapter.price(spark, sf_dir, adapter.CUT), batch, "price_data")


def write_metrics(spark, sf_dir):
    """Insertion metrics of a share batch: total ISINs, committed ISINs."""
    return MT.insertion_metrics(_judged_batch(spark, sf_dir).where(F.col("isin").isNotNull())
                                .select((F.size("_why") == 0).alias("inserted")))


def write_validation(spark, sf_dir):
    """Rejects of a batch in which every third instrument breaks a limit: a
    market segment over 50 characters, a record without a stamp, or a contract
    count past the INT range."""
    key = F.substring("isin", 3, 9).cast("long")
    wide = M.collapse_shares(adapter.share_batch(spark, sf_dir))
    wide = (wide.withColumn("super_sector", F.when(key % 3 == 0, F.repeat("isin", 5)).otherwise(F.col("super_sector")))
            .withColumn("updated_at", F.when(key % 9 != 1, F.greatest(*[f"_at_{t}" for t in M.schemas.SATELLITES])))
            .withColumn("_numero_contratti_overflow",
                        P.int_overflow(F.translate(F.format_number(
                            F.col("numero_contratti").cast("long") * key * 1000000, 0), ",", "."))))
    return M.rejects_of(M.judge_shares(wide, adapter.hub(spark, sf_dir)))


def empty_records(spark, sf_dir):
    """The all-NULL price record of every instrument: key and stamp only."""
    return M.empty_records(adapter.hub(spark, sf_dir), "price_data", P.ntz_lit(RUN_AS_OF))


def price_flatten(spark, sf_dir):
    """The nested price records of the shares flattened to the store's columns."""
    nested = views.nested_prices(adapter.price(spark, sf_dir))
    return M.flatten_price(nested).select("isin", "max_anno", "max_anno_date", "min_anno", "min_anno_date",
                                          "prezzo_riferimento", "data_ora_prezzo_rifermento",
                                          "prezzo_ufficiale", "data_prezzo_ufficiale")


def share_count(spark, sf_dir):
    """Size of two lookups: all shares, and those of a prefix that none has."""
    every = views.count_shares(views.current_view(_store(spark, sf_dir)))
    none = views.count_shares(views.query_shares(_store(spark, sf_dir), views.ShareQuery(lang="0")))
    return every.withColumn("lookup", F.lit("all")).unionByName(none.withColumn("lookup", F.lit("0")))


def metrics_total(spark, sf_dir):
    """Field-wise sum of the listing and the detail run's metrics and the zero
    row."""
    return MT.add_metrics(discovery_metrics(spark, sf_dir), scrape_metrics(spark, sf_dir), MT.zero_metrics(spark))


def insert_absent(spark, sf_dir):
    """Hub insert of every instrument into the listed hub: only the absent
    ones become new rows."""
    new_rows, _ = M.insert_absent(_listed_hub(spark, sf_dir), adapter.hub(spark, sf_dir))
    return new_rows


def insert_metrics(spark, sf_dir):
    _, outcome = M.insert_absent(_listed_hub(spark, sf_dir), adapter.hub(spark, sf_dir))
    return MT.insertion_metrics(outcome)


# ---- page extraction --------------------------------------------------------

def _detail_run(spark, sf_dir):
    store = _store(spark, sf_dir)
    pages = adapter.render_detail_pages(views.current_view(store))
    hub = store["share_isins"]
    return jobs.extract_shares(hub, pages, RUN_AS_OF, broadcast_requests=M.fits_broadcast(hub))


def detail_extract(spark, sf_dir):
    """Detail pages of every instrument scanned, labelled rows assigned to
    the 27 properties (last match wins), values parsed into the four
    satellite records (flat store columns)."""
    wide, _, _ = _detail_run(spark, sf_dir)
    return wide.drop("page_id", "updated_at", "fetched_at", "_numero_contratti_overflow")


def requested_extract(spark, sf_dir):
    """The instruments due for refresh and their detail pages, found among the
    pages of all instruments by the Bloom filter of the requested URLs (the way of
    request sets too large to broadcast)."""
    store = _store(spark, sf_dir)
    pages = adapter.render_detail_pages(views.current_view(store))
    due = jobs._stage(views.stale_set(store, REFRESH_MIN_AGE, RUN_AS_OF), "due")
    wide, _, _ = jobs.extract_shares(due, pages, RUN_AS_OF, broadcast_requests=False)
    return wide.drop("page_id", "updated_at", "fetched_at", "_numero_contratti_overflow")


def scrape_metrics(spark, sf_dir):
    """Metrics of the detail run: requested, fetched, error kinds."""
    _, _, metrics = _detail_run(spark, sf_dir)
    return metrics


def _refresh_run(spark, sf_dir):
    # staged like the job: intermediate results are written under
    # spark.checkpoint.dir, which keeps the plan (and its lineage) small
    store = _store(spark, sf_dir)
    pages = adapter.render_detail_pages(views.current_view(store))
    return store, jobs.refresh_frames(store, pages, REFRESH_MIN_AGE, RUN_AS_OF,
                                      stage=jobs._stage, check=M.fits_broadcast)


def refresh_view(spark, sf_dir):
    """Incremental refresh end to end: instruments not updated for 120
    days are looked up on their detail pages, scanned, typed, validated
    and merged into the four satellites; the current view after it."""
    store, (new, _, _) = _refresh_run(spark, sf_dir)
    return views.current_view({"share_isins": store["share_isins"], **new})


def refresh_metrics(spark, sf_dir):
    """Run metrics of that refresh: scrape counts and insertion counts."""
    _, (_, scrape, insert) = _refresh_run(spark, sf_dir)
    run = MT.run_record(spark, "refresh", scrape, insert, RUN_AS_OF, RUN_AS_OF)
    return run.select(*[F.col(f"scrape.{c}").alias(f"scrape_{c}") for c in scrape.columns],
                      *[F.col(f"insert.{c}").alias(f"insert_{c}") for c in insert.columns])


def refresh_all_view(spark, sf_dir):
    """Full refresh: every instrument is looked up on its detail page; the
    current view after it."""
    store = _store(spark, sf_dir)
    pages = adapter.render_detail_pages(views.current_view(store))
    new, _, _ = jobs.refresh_frames(store, pages, REFRESH_MIN_AGE, RUN_AS_OF, all_shares=True,
                                    stage=jobs._stage, check=M.fits_broadcast)
    return views.current_view({"share_isins": store["share_isins"], **new})


def page_copies_newest(spark, sf_dir):
    """Two copies of every detail page in one run, the one fetched last with an
    official price of 1: it wins wherever the page has a price row."""
    store = _store(spark, sf_dir)
    view = views.current_view(store)
    at = lambda x: P.ntz_lit(RUN_AS_OF + dt.timedelta(minutes=x))
    old = adapter.render_detail_pages(view).withColumn("fetched_at", at(0))
    new = (adapter.render_detail_pages(view.withColumn("prezzo_ultimo_contratto", F.lit(1.0)))
           .withColumn("fetched_at", at(1)))
    wide, _, _ = jobs.extract_shares(store["share_isins"], new.unionByName(old), RUN_AS_OF)
    cols = [c for t in M.schemas.SATELLITES for c in M.schemas.non_key_columns(t)]
    return M.collapse_records(wide, cols).select("isin", "prezzo_ultimo_contratto")


def _page_files(pages, name, batches):
    """Pages written as files, one per partition that has rows: (folder, files a
    trigger takes), so that the folder is read in ``batches`` micro-batches whose
    pages lie in as many files as there are partitions to scan them (in fewer
    micro-batches only if there are fewer files)."""
    from ..session import staging_path
    spark = pages.sparkSession
    path = staging_path(spark, name)
    pages.write.parquet(path)
    files = len(spark.read.schema(pages.schema).parquet(path).inputFiles())
    return path, -(-files // batches)


def stream_refresh_view(spark, sf_dir):
    """Detail pages arriving as files refresh a stored, bucketed store through
    two streaming ingests, each with a fresh checkpoint (scan, validate, merge,
    commit a micro-batch): the first brings every page with a price of 1 in one
    micro-batch, the second the true pages in two. The current view afterwards."""
    from ..session import staging_path
    from ..sources.store import Store
    from ..streaming import ingest
    st = Store(spark, staging_path(spark, "stream-store"))
    st.write(_store(spark, sf_dir))
    view = views.current_view(_store(spark, sf_dir))
    for batches, pages in ((1, view.withColumn("prezzo_ultimo_contratto", F.lit(1.0))), (2, view)):
        pages_dir, files = _page_files(adapter.render_detail_pages(pages), "stream-pages", batches)
        ingest.start_page_ingest(st, pages_dir, staging_path(spark, "stream-ckpt"), available_now=True,
                                 as_of=RUN_AS_OF, max_files_per_trigger=files).awaitTermination()
    return views.current_view(st.tables())


def _nav_links(spark, sf_dir):
    pages = read_input(spark, sf_dir, "pages")
    return X.links_only(X.scan_links(pages, html_scan.NAV_LINKS, None))


def link_extract(spark, sf_dir):
    """Every 'nav a' link of every page: href and first text node."""
    return _nav_links(spark, sf_dir)


def link_dedupe(spark, sf_dir):
    """Instrument-set semantics over link candidates: (name, last path
    segment of the href) pairs, duplicates collapsed, earliest stamp kept."""
    c = X.classify_links(_nav_links(spark, sf_dir), P.ntz_lit(RUN_AS_OF))
    return M.dedupe_instruments(c.where(F.col("error").isNull() | (F.col("error") == "parsing_error"))
                                .where(F.col("share_name").isNotNull()))


def listing_metrics(spark, sf_dir):
    """Discovery metrics over all pages read as listing pages ('nav a')."""
    _, _, metrics = jobs.extract_instruments(read_input(spark, sf_dir, "pages"), RUN_AS_OF,
                                             html_scan.NAV_LINKS, None)
    return metrics


def _discovery(spark, sf_dir):
    return jobs.extract_instruments(adapter.render_listing_pages(spark, sf_dir), RUN_AS_OF)


def discovery_instruments(spark, sf_dir):
    """Listing pages in the site's layout scanned with its selector, links
    turned into instruments, invalid ones dropped, repeats collapsed."""
    instruments, _, _ = _discovery(spark, sf_dir)
    return instruments


def discovery_metrics(spark, sf_dir):
    """Discovery metrics: link elements before de-duplication, successes,
    invalid links, parsing errors."""
    _, _, metrics = _discovery(spark, sf_dir)
    return metrics


def discovery_run(spark, sf_dir):
    """A whole discovery run with the API's defaults into an empty store: every
    instrument of every listing page."""
    from ..session import staging_path
    from ..sources.store import Store
    from . import api
    st = Store(spark, staging_path(spark, "discovered"))
    api.run_scrape_and_insert_isins(st, adapter.render_listing_pages(spark, sf_dir))
    return st.tables()["share_isins"].select("isin", "share_name")


def stream_discovery(spark, sf_dir):
    """The listing pages in three micro-batches of files, discovered into an
    empty store: the same hub as of the batch run."""
    from ..session import staging_path
    from ..sources.store import Store
    from ..streaming import discovery
    st = Store(spark, staging_path(spark, "stream-discovered"))
    parts = max(3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pages_dir, files = _page_files(adapter.render_listing_pages(spark, sf_dir).repartition(parts, "page_id"),
                                   "listing-files", 3)
    discovery.start_discovery(st, pages_dir, staging_path(spark, "discovery-ckpt"), available_now=True,
                              as_of=RUN_AS_OF, max_files_per_trigger=files).awaitTermination()
    return st.tables()["share_isins"].select("isin", "share_name")


def discovery_grid_metrics(spark, sf_dir):
    """Discovery metrics of a run that asks for the site's listing grid alone
    (initials A-Z, pages 1-9)."""
    pages = jobs.grid_pages(adapter.render_listing_pages(spark, sf_dir))
    _, _, metrics = jobs.extract_instruments(pages, RUN_AS_OF)
    return metrics


def detail_urls(spark, sf_dir):
    """The detail-page URL of every instrument."""
    return adapter.hub(spark, sf_dir).select("isin", detail_url(F.col("isin")).alias("url"))


# ---- fetch log --------------------------------------------------------------

def fetch_outcome(spark, sf_dir):
    """Every URL of the attempt log resolved by the retry rules."""
    return FL.resolve(adapter.fetch_attempts(spark, sf_dir))


def fetch_outcome_stream(spark, sf_dir):
    """The attempt log replayed as a stream, dealt over eight files, a micro-batch
    each, so that the attempts of a URL arrive apart and in any order; through
    the streaming aggregation into a folder under spark.checkpoint.dir: the
    newest row of every URL."""
    from ..session import staging_path
    from ..streaming import fetch_stream
    log_path = staging_path(spark, "attempt-log")
    log = adapter.fetch_attempts(spark, sf_dir)
    log.repartition(8).write.parquet(log_path)
    out = staging_path(spark, "resolved-stream")
    attempts = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(log_path)
    fetch_stream.start_resolver(attempts, out, staging_path(spark, "resolved-ckpt"),
                                available_now=True).awaitTermination()
    return fetch_stream.resolved(spark, out)


#: of the log that goes silent: attempts after this one never arrive
SILENT_AFTER = 3
LATENESS_MINUTES = 10
LOG_FILE_ROWS = 100_000  # of the files it is replayed from, about


def fetch_timeout_stream(spark, sf_dir):
    """A log whose URLs go silent after their third attempt, replayed in order of
    time in eight micro-batches with event-time timers: the final outcome of every
    fetch that is decided or whose budget the watermark has passed, undecided
    ones as timeouts."""
    from ..session import staging_path
    from ..streaming import fetch_timers
    log = jobs._stage(adapter.fetch_attempts(spark, sf_dir).where(F.col("attempt_no") <= SILENT_AFTER), "silent-log")
    ended = F.unix_micros(F.col("ended_at").cast("timestamp_ltz"))
    cuts, rows = log.agg(F.percentile_approx(ended, [k / 8 for k in range(1, 8)]), F.count(F.lit(1))).first()
    cuts = sorted(set(cuts or []))
    path = staging_path(spark, "silent-files")
    part = sum((F.when(ended > c, 1).otherwise(0) for c in cuts), F.lit(0))
    files = -(-rows // (8 * LOG_FILE_ROWS)) or 1
    for k in range(len(cuts) + 1):  # a file source takes older files first
        rows_k = log.where(part == k)
        (rows_k.coalesce(1) if files == 1 else rows_k.repartition(files)).write.parquet(f"{path}/{k}")
        # a trigger takes the same number of files of every part: empty ones make up for those without rows
        for _ in range(files - len(spark.read.schema(log.schema).parquet(f"{path}/{k}").inputFiles())):
            spark.createDataFrame([], log.schema).write.mode("append").parquet(f"{path}/{k}")
    out = staging_path(spark, "timed-outcomes")
    attempts = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*")
    fetch_timers.start_timed_resolver(attempts, out, staging_path(spark, "timed-ckpt"), available_now=True,
                                      lateness=f"{LATENESS_MINUTES} minutes").awaitTermination()
    return fetch_timers.outcomes(spark, out)


def fetch_outcome_share_budget(spark, sf_dir):
    """The attempt log under a share budget of 100 s, shorter than the fetch's."""
    return FL.resolve(adapter.fetch_attempts(spark, sf_dir), share_budget_s=100)


def fetch_rejects(spark, sf_dir):
    """Attempts that the retry rules can't place: the log numbered from 0, and
    those of status 429 without a number."""
    n = F.when(F.col("status").isNull() | (F.col("status") != 429), F.col("attempt_no") - 1)
    return FL.rejected(adapter.fetch_attempts(spark, sf_dir).withColumn("attempt_no", n))


def listing_fetch_metrics(spark, sf_dir):
    """Discovery metrics from an attempt log: every URL's answered page is a
    page of links, and its failed fetches count by error kind."""
    log = adapter.fetch_attempts(spark, sf_dir)
    page = F.concat(F.lit("<nav><a href='/x/"), F.lit("IT0001233417"), F.lit(".html'>"), F.col("url"), F.lit("</a></nav>"))
    log = log.withColumn("body", F.when(F.col("body") != "", page).otherwise(F.col("body")))
    resolved = FL.resolve(log)
    _, _, metrics = jobs.extract_instruments(
        FL.fetched_pages(log, resolved, empty=True), RUN_AS_OF, html_scan.NAV_LINKS, None,
        fetch_errors=resolved.where(F.col("error").isNotNull()).select("url", "error"))
    return metrics


def fetch_metrics(spark, sf_dir):
    """Error histogram of the resolved fetches."""
    return FL.fetch_metrics(FL.resolve(adapter.fetch_attempts(spark, sf_dir)))


QUERIES = {
    "current_view": current_view,
    "stored_view": stored_view,
    "view_by_isin": view_by_isin,
    "view_by_prefix": view_by_prefix,
    "view_by_name": view_by_name,
    "view_by_prefix_and_name": view_by_prefix_and_name,
    "view_isin_wins": view_isin_wins,
    "view_request_empty_params": view_request_empty_params,
    "stale_set": stale_set,
    "nested_share_json": nested_share_json,
    "isins_json": isins_json,
    "number_parse": number_parse,
    "int_parse": int_parse,
    "datetime_parse": datetime_parse,
    "date_parse": date_parse,
    "price_date_split": price_date_split,
    "price_datetime_split": price_datetime_split,
    "isin_parse": isin_parse,
    "upsert_price": upsert_price,
    "upsert_performance": upsert_performance,
    "upsert_details": upsert_details,
    "upsert_market": upsert_market,
    "fk_rejects": fk_rejects,
    "share_write_accepted": share_write_accepted,
    "write_metrics": write_metrics,
    "insert_absent": insert_absent,
    "insert_metrics": insert_metrics,
    "detail_extract": detail_extract,
    "scrape_metrics": scrape_metrics,
    "refresh_view": refresh_view,
    "refresh_metrics": refresh_metrics,
    "stream_refresh_view": stream_refresh_view,
    "link_extract": link_extract,
    "link_dedupe": link_dedupe,
    "listing_metrics": listing_metrics,
    "detail_urls": detail_urls,
    "discovery_instruments": discovery_instruments,
    "discovery_metrics": discovery_metrics,
    "discovery_grid_metrics": discovery_grid_metrics,
    "fetch_outcome": fetch_outcome,
    "fetch_outcome_stream": fetch_outcome_stream,
    "fetch_timeout_stream": fetch_timeout_stream,
    "requested_extract": requested_extract,
    "stale_set_layout": stale_set_layout,
    "view_by_prefix_layout": view_by_prefix_layout,
    "view_by_name_indexed": view_by_name_indexed,
    "view_by_prefix_and_name_indexed": view_by_prefix_and_name_indexed,
    "fetch_metrics": fetch_metrics,
    "write_validation": write_validation,
    "empty_records": empty_records,
    "price_flatten": price_flatten,
    "share_count": share_count,
    "metrics_total": metrics_total,
    "parse_defaults": parse_defaults,
    "view_prefix_backslash": view_prefix_backslash,
    "refresh_all_view": refresh_all_view,
    "page_copies_newest": page_copies_newest,
    "fetch_outcome_share_budget": fetch_outcome_share_budget,
    "fetch_rejects": fetch_rejects,
    "listing_fetch_metrics": listing_fetch_metrics,
    "discovery_run": discovery_run,
    "stream_discovery": stream_discovery,
}
