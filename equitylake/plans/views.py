"""Read path over the store: current view, filtered lookup, stale set,
nested records and their JSON.

All of it is declarative DataFrame code: filters on ``isin`` are pushed
below the left joins (and inferred onto the satellite scans) by Catalyst,
satellite scans read only the columns a query uses, and the four left
joins share the join key so the chain needs one exchange per table.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.parsers import format_isin, iso_ntz, like_pattern, nan_to_null, parse_isin
from ..functions.parsers import ntz_lit
from .names import NameIndex, narrowed

if TYPE_CHECKING:
    from .layout import Layout

EPOCH = dt.datetime(1970, 1, 1)
I64_MAX = 2 ** 63 - 1

# the wide projection of the current view, in output order
VIEW_COLUMNS = (["isin", "share_name"]
                + schemas.non_key_columns("share_details")
                + schemas.non_key_columns("market_information")
                + schemas.non_key_columns("price_data")
                + schemas.non_key_columns("performance_metrics")
                + ["updated_at"])

_SAT_ALIAS = {"share_details": "sd", "market_information": "mi",
              "price_data": "pd", "performance_metrics": "pm"}


def _stamp(table: str) -> str:
    return f"_{_SAT_ALIAS[table]}_updated_at"


def _satellite(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    return df.select("isin", *columns, F.col("updated_at").alias(_stamp(table)))


def current_view(tables: dict[str, DataFrame], hub_filter: Column | None = None) -> DataFrame:
    """Hub left-joined to the four satellites; ``updated_at`` is the newest
    stamp among the five tables (NULLs skipped)."""
    hub = tables["share_isins"].select("isin", "share_name", "updated_at")
    if hub_filter is not None:
        hub = hub.where(hub_filter)
    out = hub
    for t in schemas.SATELLITES:
        out = out.join(_satellite(tables[t], t, schemas.non_key_columns(t)), "isin", "left")
    stamps = [F.col("updated_at")] + [F.col(_stamp(t)) for t in schemas.SATELLITES]
    return out.select(*[c for c in VIEW_COLUMNS if c != "updated_at"],
                      F.greatest(*stamps).alias("updated_at"))


@dataclass(frozen=True)
class ShareQuery:
    """Optional lookup parameters. ``isin`` silences the others; ``lang``
    is an ISIN prefix (country), ``name`` a substring of the name; both
    prefix and substring are case-insensitive LIKE patterns in which the
    caller's ``%`` and ``_`` act as wildcards."""

    name: str | None = None
    isin: str | None = None
    lang: str | None = None

    @classmethod
    def from_request(cls, name=None, isin=None, lang=None) -> "ShareQuery":
        """Request parameters: an empty string means absent."""
        norm = lambda v: None if v is None or v == "" else v
        return cls(norm(name), norm(isin), norm(lang))

    def predicate(self) -> Column | None:
        isin, name, lang = self.isin, self.name, self.lang
        if isin is not None:
            return F.col("isin") == F.lit(isin)
        by_lang = (F.col("isin").ilike(like_pattern(lang, after="%"))
                   if lang is not None else None)
        by_name = (F.col("share_name").ilike(like_pattern(name, "%", "%"))
                   if name is not None else None)
        if by_lang is not None and by_name is not None:
            return by_lang & by_name
        return by_lang if by_lang is not None else by_name


def query_shares(tables: dict[str, DataFrame], query: ShareQuery | None = None,
                 names: NameIndex | None = None, layout: Layout | None = None) -> DataFrame:
    """Current view restricted by ``query`` (all shares when empty). With an index
    of the hub's ``names``, a substring is looked up there instead of in the hub, and
    a prefix in the store's ``layout`` when given."""
    query = query or ShareQuery()
    pred = query.predicate()
    if names is not None and query.isin is None and query.name is not None:
        matches = names.matches(query.name)
        if matches is not None:
            return current_view(narrowed(tables, matches, pred))
    if layout is not None and query.isin is None and query.lang is not None:
        matches = layout.with_prefix(query.lang)
        if matches is not None:
            tables = narrowed(tables, matches, F.col("isin").ilike(like_pattern(query.lang, after="%")))
    return current_view(tables, pred)


def _min_age_micros(min_age: dt.timedelta) -> int:
    us = (min_age.days * 86_400 + min_age.seconds) * 1_000_000 + min_age.microseconds
    return us if -I64_MAX <= us <= I64_MAX else 0  # overflow -> 0: all due


def stale_set(tables: dict[str, DataFrame], min_age: dt.timedelta,
              as_of: dt.datetime | None = None) -> DataFrame:
    """Instruments whose newest satellite stamp (missing = 1970-01-01) is
    at least ``min_age`` before ``as_of`` (inclusive). ``as_of`` defaults
    to the current UTC time."""
    return last_updates(tables).where(F.col("updated_at") <= cutoff(min_age, as_of))


def cutoff(min_age: dt.timedelta, as_of: dt.datetime | None = None) -> Column:
    """``min_age`` before ``as_of`` (default: the current UTC time)."""
    now = (ntz_lit(as_of) if as_of is not None
           else F.current_timestamp().cast("timestamp_ntz"))
    return F.timestamp_add("MICROSECOND", F.lit(-_min_age_micros(min_age)), now)


def last_updates(tables: dict[str, DataFrame]) -> DataFrame:
    """(isin, share_name, updated_at): every instrument with its newest satellite
    stamp, 1970-01-01 if it has none."""
    out = tables["share_isins"].select("isin", "share_name")
    for t in schemas.SATELLITES:
        out = out.join(_satellite(tables[t], t, []), "isin", "left")
    epoch = ntz_lit(EPOCH)
    last = F.greatest(*[F.coalesce(F.col(_stamp(t)), epoch) for t in schemas.SATELLITES])
    return out.select("isin", "share_name", last.alias("updated_at"))


# ---- nested records -----------------------------------------------------

def _price_struct_cols() -> list[Column]:
    cols = []
    flat_to_struct = {v[0]: (k, v) for k, v in schemas.PRICE_STRUCTS.items()}
    skip = {v[1] for v in schemas.PRICE_STRUCTS.values()}
    for c in schemas.non_key_columns("price_data"):
        if c in skip:
            continue
        if c in flat_to_struct:
            name, (price_col, time_col, time_name) = flat_to_struct[c]
            cols.append(F.struct(F.col(price_col).alias("price"),
                                 F.col(time_col).alias(time_name)).alias(name))
        elif c == "numero_contratti":
            cols.append(F.col(c).cast("bigint").alias(c))
        else:
            cols.append(F.col(c))
    return cols


def nest(view: DataFrame) -> DataFrame:
    """Flat view rows -> nested share records. Every nested ``updated_at``
    is the view's newest stamp; the four price pairs are always present
    structs (fields may be NULL). Rows whose stored ISIN does not parse
    get a NULL ``share_id.isin`` (see ``nested_shares``)."""
    ts = F.col("updated_at")
    isin = F.col("isin")
    sub = lambda t, cols: F.struct(isin.alias("isin"), *cols, ts.alias("updated_at")).alias(t)
    return view.select(
        F.struct(F.col("share_name"), parse_isin(isin).alias("isin"),
                 ts.alias("updated_at")).alias("share_id"),
        sub("share_details", [F.col(c) for c in schemas.non_key_columns("share_details")]),
        sub("market_information", [F.col(c) for c in schemas.non_key_columns("market_information")]),
        sub("price_data", _price_struct_cols()),
        sub("performance_metrics", [F.col(c) for c in schemas.non_key_columns("performance_metrics")]),
        ts.alias("updated_at"))


def nested_shares(view: DataFrame, strict: bool = False) -> DataFrame:
    """Nested records with a valid ISIN. With ``strict`` a bad stored ISIN
    fails the query, as the store's decoder does; by default such rows
    are left out (see ``nested_rejects``)."""
    n = nest(view)
    if strict:
        return n.withColumn("share_id", F.when(F.col("share_id.isin").isNotNull(), F.col("share_id"))
                            .otherwise(F.raise_error(F.lit("stored ISIN does not parse"))))
    return n.where(F.col("share_id.isin").isNotNull())


def nested_rejects(view: DataFrame) -> DataFrame:
    return view.where(parse_isin(F.col("isin")).isNull()).select("isin", "share_name")


def _json_value(c: Column, typ) -> Column:
    """Value as a standard JSON encoder of the records writes it: NaN and
    infinities become null, zone-less timestamps ISO text."""
    name = typ.typeName()
    if name == "double":
        return nan_to_null(c)
    if name == "timestamp_ntz":
        return iso_ntz(c)
    if name == "struct":
        return F.when(c.isNotNull(), F.struct(*[_json_value(c[f.name], f.dataType).alias(f.name)
                                                for f in typ.fields]))
    return c


def _json_safe(df: DataFrame) -> DataFrame:
    return df.select(*[_json_value(F.col(f.name), f.dataType).alias(f.name)
                       for f in df.schema.fields])


def shares_json(view: DataFrame, strict: bool = False) -> DataFrame:
    """(isin, json): one JSON document per share, null fields included."""
    n = _json_safe(nested_shares(view, strict))
    return n.select(format_isin(F.col("share_id.isin")).alias("isin"),
                    F.to_json(F.struct(*[F.col(c) for c in n.columns]),
                              {"ignoreNullFields": "false"}).alias("json"))


def isins_json(hub: DataFrame) -> DataFrame:
    """Instrument list as JSON, ``isin`` as a {country, nna, check} object."""
    h = hub.select(F.col("share_name"), parse_isin(F.col("isin")).alias("isin"),
                   iso_ntz(F.col("updated_at")).alias("updated_at")).where(F.col("isin").isNotNull())
    return h.select(F.to_json(F.struct("share_name", "isin", "updated_at"),
                              {"ignoreNullFields": "false"}).alias("json"))


def nested_prices(price: DataFrame) -> DataFrame:
    """Price records with their price pairs as structs, as in the documents."""
    return price.select("isin", *_price_struct_cols())


def count_shares(df: DataFrame) -> DataFrame:
    """One row: the number of a lookup's shares, and whether there are none."""
    return df.agg(F.count("*").alias("n"), (F.count("*") == 0).alias("empty"))


def result_summary(df: DataFrame) -> int:
    """Row count of a lookup, logged; a warning when nothing matched."""
    import logging
    log = logging.getLogger("equitylake")
    n = count_shares(df).first()["n"]
    if n == 0:
        log.warning("found no share")
    else:
        log.info("got a total of %d shares", n)
    return n
