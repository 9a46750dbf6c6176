"""End-to-end jobs: discovery, full refresh, incremental refresh.

* ``extract_instruments`` (listing pages -> instrument set + metrics)
* ``extract_shares`` (detail pages of requested instruments -> typed
  records + metrics)
* ``discover`` / ``refresh`` / ``refresh_all`` run them against a
  ``Store``, stage intermediate results in the cluster's shared
  checkpoint folder, merge, commit and append a run record.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import parsers as P
from ..operators import bloom
from ..operators import extract as X
from ..operators import html_scan
from ..operators import merge as M
from ..operators import metrics as MT
from ..session import staging_path, utc_now
from ..sources.pages import PAGES_PER_LETTER, detail_url, listing_grid
from ..sources.store import Store
from . import views
from .names import NameIndex

DEFAULT_REFRESH_AGE = dt.timedelta(minutes=15)


def _as_of(as_of: dt.datetime | None) -> Column:
    return (P.ntz_lit(as_of) if as_of is not None
            else F.current_timestamp().cast("timestamp_ntz"))


# ---- listing pages ----------------------------------------------------------

def grid_pages(pages: DataFrame, pages_per_letter: int = PAGES_PER_LETTER) -> DataFrame:
    """The pages at the listing URLs of the letters A-Z and the page numbers 1
    to ``pages_per_letter`` (a set of that fixed size, broadcast)."""
    grid = listing_grid(pages.sparkSession, pages_per_letter).select("url")
    return pages.join(F.broadcast(grid), "url", "left_semi")


def extract_instruments(pages: DataFrame, as_of: dt.datetime | None = None,
                        chain=html_scan.LISTING_LINKS, name=html_scan.LISTING_NAME,
                        scanned: DataFrame | None = None, fetch_errors: DataFrame | None = None):
    """Listing pages -> (instrument set, link outcomes, metrics row).

    ``total`` and ``successful`` count link elements before the set
    de-duplication (the same link on two pages counts twice); a page that
    could not be fetched adds an error but nothing to ``total``: an empty body
    ``invalid_page``, a failed fetch the kind that ``fetch_errors`` (url, error
    of ``fetchlog.resolve``) gives it. Pages are scanned once (pass ``scanned`` to reuse a staged
    scan).
    """
    if scanned is None:
        scanned = X.scan_links(pages, chain, name)
    outcome = X.classify_links(X.links_only(scanned), _as_of(as_of))
    instruments = M.dedupe_instruments(outcome.where(F.col("error").isNull()))
    # links and page markers in one projection of the scan
    is_link = F.col("link_ord") >= 0
    err = F.when(is_link, X.link_error(F.col("href"), F.col("name"))) \
        .when(F.col("empty_page"), F.lit("invalid_page"))
    counts = scanned.select(is_link.alias("counted"), (is_link & err.isNull()).alias("ok"), err.alias("error"))
    if fetch_errors is not None:
        # an empty body is in the scan already
        counts = counts.unionByName(fetch_errors.where("error <> 'invalid_page'").select(
            F.lit(False).alias("counted"), F.lit(False).alias("ok"), "error"))
    metrics = MT.scrape_metrics(counts)
    return instruments, outcome, metrics


# ---- detail pages -----------------------------------------------------------

def scan_requested(instruments: DataFrame, pages: DataFrame,
                   broadcast_requests: bool = False) -> DataFrame:
    """One row per (requested ISIN, page of its detail URL) with the raw
    property strings; a requested ISIN without a page has a NULL page_id.

    Pages are scanned exactly once and their HTML is never shuffled: with
    ``broadcast_requests`` (the caller checked the request set is small)
    they are filtered to the requested URLs map-side before the scan;
    otherwise by a Bloom filter of those URLs, of bounded size at any number of
    requests, and the few others that it lets pass drop out at the join of the
    small property rows.
    """
    found, req = _found(instruments, pages, broadcast_requests)
    # requested ISINs without any page: only the pages' URLs are read again
    # (a column of their own), their HTML and its scan are not
    seen = pages.select("url")
    if broadcast_requests:  # what is left is a subset of the checked request URLs
        seen = F.broadcast(seen.join(F.broadcast(req.select("url")), "url", "left_semi").distinct())
    missing = req.join(seen, "url", "left_anti")
    return found.unionByName(missing, allowMissingColumns=True)


def scan_found(instruments: DataFrame, pages: DataFrame, broadcast_requests: bool = False) -> DataFrame:
    """The rows of ``scan_requested`` that have a page."""
    return _found(instruments, pages, broadcast_requests)[0]


def _found(instruments: DataFrame, pages: DataFrame, broadcast_requests: bool) -> tuple[DataFrame, DataFrame]:
    """(rows of the requested pages, requests with their URLs)."""
    req = instruments.select("isin", detail_url(F.col("isin")).alias("url"))
    if broadcast_requests:
        # map-side filter before the scan: only requested pages are parsed
        urls = F.broadcast(req.select("url").distinct())
        wanted = pages.join(urls, "url", "left_semi")
    else:
        # too many URLs to broadcast: their Bloom filter is not, and no HTML moves
        wanted = bloom.prefilter(pages, "url", req, "url")
    props = X.scan_properties(wanted)
    # inner join: AQE may split a URL with very many page copies on either
    # side (a left outer join could only split the request side)
    return props.join(F.broadcast(req) if broadcast_requests else req, "url"), req


def records_of(scanned: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    """Typed wide records of every fetched (non-empty) page."""
    ok = scanned.where(F.col("page_id").isNotNull() & ~F.col("empty_page"))
    return X.typed_wide(ok.withColumn("updated_at", _as_of(as_of)), keep=("isin", "page_id", "fetched_at"))


def outcomes_of(scanned: DataFrame, fetch_errors: DataFrame | None = None) -> DataFrame:
    """Per requested ISIN: fetched, empty body (invalid_page) or no page.

    Without a fetch log a missing page is a network error; with one
    (``fetch_errors``: url, error from ``fetchlog.resolve``) it is the
    error kind the crawler's retry rules give its URL.
    """
    per_isin = scanned.groupBy("isin", "url").agg(
        F.count_if(F.col("page_id").isNotNull() & ~F.col("empty_page")).alias("n_ok"),
        F.count_if(F.col("empty_page")).alias("n_bad"))
    missing = F.lit("network_error")
    if fetch_errors is not None:
        per_isin = per_isin.join(fetch_errors.select("url", F.col("error").alias("_fetch_error")),
                                 "url", "left")
        missing = F.coalesce(F.col("_fetch_error"), missing)
    return per_isin.select(
        "isin", F.lit(True).alias("counted"), (F.col("n_ok") > 0).alias("ok"),
        F.when(F.col("n_ok") > 0, F.lit(None))
         .when(F.col("n_bad") > 0, F.lit("invalid_page"))
         .otherwise(missing).alias("error"))


def extract_shares(instruments: DataFrame, pages: DataFrame, as_of: dt.datetime | None = None,
                   broadcast_requests: bool = False):
    """Detail pages of the requested instruments -> (wide typed records,
    per-instrument outcome, metrics row).

    ``instruments``: (isin, ...). Each is looked up by its detail URL; a
    missing page is a network error, an empty one an invalid page; every
    fetched page yields a record (absent properties NULL). Several pages
    for one URL yield several records (collapsed at write).
    """
    scanned = scan_requested(instruments, pages, broadcast_requests)
    outcome = outcomes_of(scanned)
    return records_of(scanned, as_of), outcome, MT.scrape_metrics(outcome)


def split_records(wide: DataFrame) -> dict[str, DataFrame]:
    out = {}
    for t, schema in schemas.SATELLITES.items():
        extra = ["_numero_contratti_overflow"] if t == "price_data" else []
        out[t] = wide.select(*[f.name for f in schema.fields], *extra)
    return out


# ---- jobs -------------------------------------------------------------------

def _stage(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared checkpoint folder and read back."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def _no_stage(df: DataFrame, name: str) -> DataFrame:
    return df


def merge_shares(wide: DataFrame, hub: DataFrame, current: dict[str, DataFrame],
                 stage=_no_stage, check=None):
    """Core of a share write, without side effects: collapse the records
    per ISIN, validate once per ISIN over all four payloads, merge the
    accepted ones into all four satellites.

    ``stage(df, name)`` cuts lineage at the points a job materialises
    (identity by default); ``check(df) -> bool`` is the size check that
    allows the broadcast plans (none by default: shuffle plans).
    Returns (new satellites, per-ISIN insert outcome, rejects).
    """
    check = check or (lambda df: False)
    # one collapse for all four payloads: every column belongs to one
    # satellite and all of them share the record's order
    cols = [c for t in schemas.SATELLITES for c in schemas.non_key_columns(t)]
    collapsed = stage(M.collapse_records(wide, cols, flags=("_numero_contratti_overflow",)),
                      "payloads")
    staged = split_records(collapsed)
    # what a merge broadcasts is a payload, at most the collapsed record: check that
    small = check(collapsed)
    judged = M.judge_shares(collapsed, hub, broadcast_keys=small)
    rejects = M.rejects_of(judged)
    accepted = stage(M.accepted_shares(judged).select("isin"), "accepted")
    new = {t: M.merge_satellite(current[t], M.accepted_only(staged[t], accepted, t), t,
                                broadcast_batch=small)
           for t in schemas.SATELLITES}
    outcome = staged["price_data"].select("isin").join(
        accepted.withColumn("inserted", F.lit(True)), "isin", "left") \
        .select("isin", F.coalesce("inserted", F.lit(False)).alias("inserted"))
    return new, outcome, rejects


def write_shares(store: Store, wide: DataFrame, hub: DataFrame, current: dict[str, DataFrame],
                 batch: tuple[str, int] | None = None):
    """Validate, merge and commit one version (with the mark of a stream's
    ``batch``). Returns (version, insert metrics, rejects)."""
    new, outcome, rejects = merge_shares(wide, hub, current, stage=_stage, check=M.fits_broadcast)
    version = store.write(new, shuffle=False, batch=batch)
    return version, MT.insertion_metrics(outcome), rejects


def refresh_frames(current: dict[str, DataFrame], pages: DataFrame, min_age: dt.timedelta,
                   as_of: dt.datetime, all_shares: bool = False,
                   fetch_errors: DataFrame | None = None, stage=_no_stage, check=None,
                   rejects_out: list | None = None):
    """One refresh as DataFrames: the instruments due (or all), their
    detail pages scanned and typed, merged into the satellites.
    Returns (new satellites, scrape metrics row, insertion metrics row);
    the rejected rows are appended to ``rejects_out`` when given."""
    chk = check or (lambda df: False)
    todo = (current["share_isins"] if all_shares
            else views.stale_set(current, min_age, as_of))
    todo = stage(todo.select("isin", "share_name"), "requested")
    scanned = stage(scan_requested(todo, pages, broadcast_requests=chk(todo)), "scanned")
    wide = stage(records_of(scanned, as_of), "extracted")
    # one small aggregate over the staged scan: no lineage worth cutting
    scrape = MT.scrape_metrics(outcomes_of(scanned, fetch_errors))
    new, outcome, rejects = merge_shares(wide, current["share_isins"], current, stage, check)
    if rejects_out is not None:
        rejects_out.append(rejects)
    return new, scrape, MT.insertion_metrics(outcome)


def refresh(store: Store, pages: DataFrame | None = None,
            min_age: dt.timedelta = DEFAULT_REFRESH_AGE,
            as_of: dt.datetime | None = None, all_shares: bool = False,
            attempts: DataFrame | None = None) -> DataFrame:
    """Incremental (or, with ``all_shares``, full) refresh of the satellites
    from detail pages -- or from a crawler's attempt log, whose resolved
    fetches supply both the pages and the fetch errors. Stages every
    intermediate result in the shared checkpoint folder, commits one store
    version and returns the run record."""
    from ..operators import fetchlog as FL
    spark = store.spark
    start = utc_now()
    as_of = as_of or start
    fetch_errors = None
    if attempts is not None:
        resolved = _stage(FL.resolve(attempts), "fetch-resolved")
        pages = FL.fetched_pages(attempts, resolved, broadcast_ok=M.fits_broadcast(resolved))
        fetch_errors = resolved.where(F.col("error").isNotNull())
        store.append_rejects(FL.rejected(attempts), "refresh", start)
    current = store.tables()
    job = "refresh_all" if all_shares else "refresh"
    rejected: list = []
    new, scrape, insert = refresh_frames(current, pages, min_age, as_of, all_shares,
                                         fetch_errors, stage=_stage, check=M.fits_broadcast,
                                         rejects_out=rejected)
    store.write(new, shuffle=False)  # merged against the bucketed tables
    store.append_rejects(rejected[0], job, start)
    run = MT.run_record(spark, job, scrape, insert, start, utc_now())
    store.append_run(run)
    return run


def refresh_all(store: Store, pages: DataFrame | None = None, as_of: dt.datetime | None = None,
                attempts: DataFrame | None = None) -> DataFrame:
    return refresh(store, pages, as_of=as_of, all_shares=True, attempts=attempts)


def discover(store: Store, listing_pages: DataFrame | None = None, as_of: dt.datetime | None = None,
             chain=html_scan.LISTING_LINKS, name=html_scan.LISTING_NAME,
             pages_per_letter: int | None = None, attempts: DataFrame | None = None,
             names: NameIndex | None = None) -> DataFrame:
    """Listing pages -> new hub rows (known ISINs untouched), posted in the index of
    ``names`` when given. The pages come as
    a table or, with ``attempts``, from a crawler's attempt log, whose failed
    fetches count by error kind. All pages are read; with ``pages_per_letter``
    only those of that grid, and the others are recorded as rejects.
    Returns the run record."""
    from ..operators import fetchlog as FL
    spark = store.spark
    start = utc_now()
    fetch_errors = None
    if attempts is not None:
        resolved = _stage(FL.resolve(attempts), "listing-resolved")
        listing_pages = FL.fetched_pages(attempts, resolved, broadcast_ok=M.fits_broadcast(resolved), empty=True)
        fetch_errors = resolved.where(F.col("error").isNotNull()).select("url", "error")
        store.append_rejects(FL.rejected(attempts), "discover", start)
    if pages_per_letter is not None:
        grid = listing_grid(spark, pages_per_letter).select("url")
        left_out = listing_pages.select("url").join(F.broadcast(grid), "url", "left_anti")
        store.append_rejects(left_out.select(
            F.lit(None).cast("string").alias("isin"), F.lit("listing_pages").alias("table"),
            F.concat(F.lit("outside_grid "), "url").alias("reason")), "discover", start)
        listing_pages = grid_pages(listing_pages, pages_per_letter)
    scanned = _stage(X.scan_links(listing_pages, chain, name), "listing-links")
    instruments, _, scrape = extract_instruments(listing_pages, as_of or start, chain, name,
                                                 scanned=scanned, fetch_errors=fetch_errors)
    run = insert_instruments(store, instruments, scrape, "discover", start, names=names)
    store.append_run(run)
    return run


def insert_instruments(store: Store, instruments: DataFrame, scrape: DataFrame, job: str, start: dt.datetime,
                       batch: tuple[str, int] | None = None, names: NameIndex | None = None) -> DataFrame:
    """Insert the instruments that the hub doesn't have and commit (with the mark of
    a stream's ``batch``); nothing is rewritten if all are known. Returns the run
    record, which is not yet appended."""
    spark = store.spark
    instruments = _stage(instruments, "instruments")
    scrape = _stage(scrape, "scrape-metrics")
    current = store.tables()
    _, outcome = M.insert_absent(current["share_isins"], instruments,
                                 broadcast_candidates=M.fits_broadcast(instruments))
    outcome = _stage(outcome, "insert-outcome")
    inserted = outcome.where("inserted").select("isin", "share_name", "updated_at")
    new = {}
    if batch is None or not inserted.isEmpty():
        if names is not None:  # before the commit, so that no committed row is missing; a lookup reads the hub, too
            names.add(inserted)
        # stored hub (bucketed scan) plus the few new rows: no shuffle needed
        new = {"share_isins": current["share_isins"].unionByName(inserted)}
    store.write(new, shuffle=False, batch=batch)
    store.append_rejects(outcome.where(~F.col("inserted")).withColumn("table", F.lit("share_isins")), job, start)
    return MT.run_record(spark, job, scrape, MT.insertion_metrics(outcome), start, utc_now())
