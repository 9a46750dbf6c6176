"""Page extraction as Spark jobs.

Detail pages -> typed share records:

1. ``scan_properties``: ``mapInArrow`` over (page_id, url, html) emits one row per
   page with the raw string of each of the 27 properties: the value of the LAST
   row whose lower-cased label contains the property's term -- even when that row
   has no value (then the property is NULL). Each label is read once. The wide
   ``html`` column goes no further; nothing else runs in Python, and a page's
   rows never leave its row: no shuffle, no sort.
2. ``typed_wide``: the property parsers (Column expressions) turn the
   raw strings into the four satellite records.

Listing pages -> instruments: ``scan_links`` + ``classify_links``.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import parsers as P
from . import html_scan

_PAGE = [("page_id", pa.int64()), ("url", pa.string()), ("fetched_at", pa.timestamp("us")), ("empty_page", pa.bool_())]
_PROPERTIES_ARROW = pa.schema([*_PAGE, *[(name, pa.string()) for name in schemas.PROPERTY_NAMES]])
_ROWS_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("table_ord", pa.int32()),
                         ("row_ord", pa.int32()), ("label", pa.string()), ("value", pa.string())])
_LINKS_ARROW = pa.schema([("page_id", pa.int64(), False), ("link_ord", pa.int32(), False),
                          ("href", pa.string()), ("name", pa.string()),
                          ("empty_page", pa.bool_())])
_TERMS = tuple(term for _, term, _, _ in schemas.PROPERTIES)


def _with_fetch_time(pages: DataFrame) -> DataFrame:
    """Pages with ``fetched_at``, when the page was read; NULL if unknown."""
    at = F.col("fetched_at") if "fetched_at" in pages.columns else F.lit(None)
    return pages.select("page_id", "url", "html", at.cast("timestamp_ntz").alias("fetched_at"))


def _empty(html: pa.Array) -> pa.Array:
    return pc.equal(pc.fill_null(pc.binary_length(html), 0), 0)


def _properties_iter(batches):
    for batch in batches:
        html = batch.column("html")
        values = list(zip(*html_scan.properties_of(html, _TERMS))) or [()] * len(_TERMS)
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url").cast(pa.string()),
             batch.column("fetched_at").cast(pa.timestamp("us")), _empty(html),
             *[pa.array(v, pa.string()) for v in values]], schema=_PROPERTIES_ARROW)


def scan_properties(pages: DataFrame) -> DataFrame:
    """(page_id, url, fetched_at, empty_page, one raw string column per
    property): one row per page. Pages are read once."""
    return _with_fetch_time(pages).mapInArrow(_properties_iter, schemas.PAGE_PROPERTIES)


def _rows_iter(batches):
    for batch in batches:
        out = {f.name: [] for f in _ROWS_ARROW}
        ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
        for page_id, url, rows in zip(ids, urls, html_scan.detail_rows_of(html_scan.Pages(batch.column("html")))):
            for row in rows:
                for c, v in zip(out, (page_id, url, *row)):
                    out[c].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=_ROWS_ARROW)


def scan_detail_rows(pages: DataFrame) -> DataFrame:
    """The labelled rows themselves, in document order of their tables: (page_id,
    url, table_ord, row_ord, label, value). A row of a nested table counts in
    every table around it."""
    return pages.select("page_id", "url", "html").mapInArrow(_rows_iter, schemas.DETAIL_ROWS)


def scan_links(pages: DataFrame, chain=html_scan.LISTING_LINKS,
               name=html_scan.LISTING_NAME) -> DataFrame:
    """One marker row per page plus the links matching ``chain`` (schema
    ``schemas.PAGE_LINKS``); ``links_only`` drops the markers."""
    cols = [f.name for f in schemas.PAGE_LINKS.fields]

    def run(batches):
        for batch in batches:
            out = {c: [] for c in cols}
            html = batch.column("html")
            scanned = html_scan.links_of(html, chain, name)
            for pid, empty, found in zip(batch.column("page_id").to_pylist(), _empty(html).to_pylist(), scanned):
                for k, href, nm in [(-1, None, None)] + found:
                    out["page_id"].append(pid)
                    out["link_ord"].append(k)
                    out["href"].append(href)
                    out["name"].append(nm)
                    out["empty_page"].append(empty if k < 0 else None)
            yield pa.RecordBatch.from_pydict(out, schema=_LINKS_ARROW)
    return pages.select("page_id", "html").mapInArrow(run, schemas.PAGE_LINKS)


def links_only(scanned: DataFrame) -> DataFrame:
    return scanned.where(F.col("link_ord") >= 0).drop("empty_page")


def typed_wide(raw: DataFrame, keep: tuple = ("isin",)) -> DataFrame:
    """Raw property strings -> one typed row per page with the flat store
    columns of all four satellites (``updated_at`` must be on ``raw``),
    plus ``_numero_contratti_overflow`` for the write validation. Price
    pairs are parsed straight into their two flat columns."""
    typed = {}
    for name, _, _, kind in schemas.PROPERTIES:
        if kind in P.FIELD_PARSERS:
            pcol, tcol, _ = schemas.PRICE_STRUCTS[name]
            typed[pcol], typed[tcol] = P.FIELD_PARSERS[kind](F.col(name))
        else:
            typed[name] = P.PARSERS[kind](F.col(name))
    cols = [c for t in schemas.SATELLITES for c in schemas.non_key_columns(t)]
    return raw.select(*keep, *[typed[c].alias(c) for c in cols], "updated_at",
                      P.int_overflow(F.col("numero_contratti")).alias("_numero_contratti_overflow"))


def link_error(href: Column, name: Column) -> Column:
    """No ``href`` or no name text -> invalid_page; empty name or an ISIN
    that does not parse -> parsing_error; else NULL (a valid instrument)."""
    return (F.when(href.isNull() | name.isNull(), F.lit("invalid_page"))
            .when((name == "") | P.isin_error(P.isin_from_href(href)).isNotNull(),
                  F.lit("parsing_error")))


def classify_links(links: DataFrame, as_of: Column) -> DataFrame:
    """Listing link -> (isin, share_name, updated_at, error)."""
    return links.select("page_id", "link_ord", P.isin_from_href(F.col("href")).alias("isin"),
                        F.col("name").alias("share_name"), as_of.alias("updated_at"),
                        link_error(F.col("href"), F.col("name")).alias("error"))
