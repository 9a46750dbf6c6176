"""The store's read and write entry points, one function each.

Reads return DataFrames of JSON documents (one per instrument / share);
writes run a job against the store and return its run record.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from ..sources.store import Store
from . import jobs, views
from .names import NameIndex


def all_isins(store: Store) -> DataFrame:
    """Every instrument: {share_name, isin{country, nna, check}, updated_at}."""
    return views.isins_json(store.tables()["share_isins"])


def all_shares(store: Store) -> DataFrame:
    """Every share as a nested JSON document."""
    return views.shares_json(views.current_view(store.tables()))


def share(store: Store, name: str | None = None, isin: str | None = None,
          lang: str | None = None, names: NameIndex | None = None) -> DataFrame:
    """Shares matching request parameters (empty string = absent; isin wins,
    then lang prefix and/or name substring, looked up in the index of ``names``
    when given)."""
    q = views.ShareQuery.from_request(name=name, isin=isin, lang=lang)
    return views.shares_json(views.query_shares(store.tables(), q, names))


def run_share_refresh(store: Store, pages: DataFrame | None = None,
                      attempts: DataFrame | None = None,
                      min_age: dt.timedelta = jobs.DEFAULT_REFRESH_AGE) -> DataFrame:
    """Refresh instruments not updated for ``min_age`` (default 15 minutes)
    from fetched pages, or from a crawler's attempt log."""
    return jobs.refresh(store, pages, min_age, attempts=attempts)


def run_scrape_and_insert(store: Store, pages: DataFrame | None = None,
                          attempts: DataFrame | None = None) -> DataFrame:
    """Refresh every instrument."""
    return jobs.refresh(store, pages, all_shares=True, attempts=attempts)


def run_scrape_and_insert_isins(store: Store, listing_pages: DataFrame | None = None,
                                pages_per_letter: int | None = None,
                                attempts: DataFrame | None = None,
                                names: NameIndex | None = None) -> DataFrame:
    """Discover instruments from the listing pages (or a crawler's attempt log)
    and insert the new ones (posted in the index of ``names`` when given). Every page is read unless ``pages_per_letter``
    limits the run to a grid; pages outside it are recorded as rejects."""
    return jobs.discover(store, listing_pages, pages_per_letter=pages_per_letter, attempts=attempts, names=names)


def export_shares(store: Store, path: str) -> None:
    """All shares as JSON lines (one document per line, nulls written)."""
    all_shares(store).select("json").write.mode("errorifexists").text(path)


def export_isins(store: Store, path: str) -> None:
    """All instruments as JSON lines."""
    all_isins(store).select("json").write.mode("errorifexists").text(path)
