"""Set-based writes into the hub and the four satellites.

* ``collapse_batch`` (in-batch duplicates): several records for one ISIN
  are applied one after another, each with COALESCE(new, old). That is,
  per column, the last non-NULL value in (updated_at, tie-break) order; a
  partial-aggregatable ``max_by`` so a hot ISIN is combined map-side.
* ``merge_satellite``: null-preserving upsert. A NULL in the batch never
  erases a stored value; an older stamp still overwrites (no monotonic
  check). Two physical plans: a full outer join on ``isin`` (each side
  shuffled at most once; a stored table bucketed by ``isin`` not at all),
  or -- when the caller has checked the batch is small -- a broadcast of
  the batch so the stored table is only scanned, never shuffled.
* ``validate_shares``: one accept/reject decision per ISIN across all four
  payloads (foreign key to the hub, VARCHAR limits, NOT NULL, INT range),
  so the four merges apply the same ISIN set: all four or none.
* ``insert_absent``: hub insert that keeps existing rows untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas

BROADCAST_MAX_BYTES = 256 << 20
_WIDTH = {"string": 160, "binary": 160, "boolean": 1, "byte": 1, "short": 2, "integer": 4,
          "date": 4, "float": 4}


def approx_row_bytes(df: DataFrame) -> int:
    """Rough in-memory width of a row (8 bytes for other scalars, nested
    types by their fields) plus row overhead."""
    def width(t) -> int:
        if t.typeName() == "struct":
            return sum(width(f.dataType) for f in t.fields)
        if t.typeName() in ("array", "map"):
            return 256
        return _WIDTH.get(t.typeName(), 8)
    return 16 + sum(width(f.dataType) for f in df.schema.fields)


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Size check of the very frame that is broadcast: its row count (one
    partially aggregated count) against the budget's row cap (``max_bytes`` /
    estimated row width). Run it on staged data, where it is a cheap scan."""
    cap = max(1, max_bytes // approx_row_bytes(df))
    return df.count() <= cap


def _order(df: DataFrame, cols: list[str]) -> Column:
    # records of one run share a stamp: the page fetched last is the newest
    # (an unknown fetch time is the oldest); then a content hash, so that the
    # choice never depends on arrival order
    fetched = F.col("fetched_at") if "fetched_at" in df.columns else F.lit(None).cast("timestamp_ntz")
    return F.struct(F.col("updated_at").alias("u"), fetched.alias("f"),
                    F.xxhash64(*[F.col(c) for c in cols]).alias("h"))


def collapse_records(batch: DataFrame, cols: list[str], flags: tuple = ()) -> DataFrame:
    """(isin, cols..., updated_at, flags...): per column the last non-NULL
    value in (updated_at, fetch time, content hash) order; ``flags`` (booleans)
    are OR-ed."""
    b = batch.withColumn("_ord", _order(batch, cols))
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_ord"))).alias(c)
            for c in cols]
    return b.groupBy("isin").agg(*aggs, F.max("updated_at").alias("updated_at"),
                                 *[F.max(f).alias(f) for f in flags])


def collapse_batch(batch: DataFrame, table: str) -> DataFrame:
    return collapse_records(batch, schemas.non_key_columns(table)) \
        .select(*[f.name for f in schemas.TABLES[table].fields])


def merge_satellite(stored: DataFrame, batch: DataFrame, table: str,
                    broadcast_batch: bool = False) -> DataFrame:
    """``batch`` must hold at most one row per ISIN (see collapse_batch)."""
    cols = schemas.non_key_columns(table) + ["updated_at"]
    out_cols = [f.name for f in schemas.TABLES[table].fields]
    new = batch.select("isin", *[F.col(c).alias(f"_new_{c}") for c in cols])
    merged = [F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) for c in cols]
    if not broadcast_batch:
        j = stored.join(new, "isin", "full_outer")
        return j.select("isin", *merged).select(*out_cols)
    small = F.broadcast(new)
    # every stored row, updated where the batch has it: map-only
    updated = stored.join(small, "isin", "left").select("isin", *merged)
    # batch ISINs not stored yet: find the stored ones among the batch keys
    # with a broadcast semi join (reads only the isin column)
    known = stored.select("isin").join(F.broadcast(new.select("isin")), "isin", "left_semi")
    # ``known`` is a subset of the (size-checked) batch keys
    inserted = new.join(F.broadcast(known), "isin", "left_anti").select(
        "isin", *[F.col(f"_new_{c}").alias(c) for c in cols])
    return updated.unionByName(inserted).select(*out_cols)


def _checks(df: DataFrame, table: str) -> list[tuple[Column, str]]:
    """(condition, reason) of every NOT NULL / VARCHAR / INT-range breach."""
    checks = [(F.col("isin").isNull(), "isin_null"),
              (F.col("updated_at").isNull() if "updated_at" in df.columns else F.lit(False), "updated_at_null")]
    for c, n in schemas.VARCHAR_LIMITS[table].items():
        checks.append((F.char_length(F.col(c)) > n, f"{c}_too_long"))
    if table == "price_data" and "_numero_contratti_overflow" in df.columns:
        checks.append((F.col("_numero_contratti_overflow"), "numero_contratti_out_of_int_range"))
    return checks


def _payload_violations(df: DataFrame, table: str) -> DataFrame:
    """(isin, table, reason) for every breach of a payload."""
    checks = _checks(df, table)
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(r)) for cond, r in checks]))
    return (df.select("isin", F.explode(reasons).alias("reason"))
            .withColumn("table", F.lit(table)))


def known_keys(stored: DataFrame, keys: DataFrame, broadcast_keys: bool) -> DataFrame:
    """The ``keys`` (isin) that ``stored`` has. With ``broadcast_keys`` (the
    caller checked ``keys`` is small) the stored table is only scanned --
    its isin column, map-side -- never shuffled."""
    k = keys.select("isin")
    if broadcast_keys:
        return stored.select("isin").join(F.broadcast(k), "isin", "left_semi")
    return k.join(stored.select("isin"), "isin", "left_semi")


def validate_shares(payloads: dict[str, DataFrame], hub: DataFrame,
                    broadcast_keys: bool = False) -> tuple[DataFrame, DataFrame]:
    """Returns (accepted ISINs, rejects(isin, table, reason)).

    A share is accepted only when its ISIN is in the hub and none of its
    four payload rows breaks a constraint; one rejected payload rejects all
    four. Payloads are keyed by table name (any subset of the satellites).
    """
    keys = reduce(DataFrame.unionByName,
                  [df.select("isin") for df in payloads.values()]).distinct() \
        .where(F.col("isin").isNotNull())
    viol = reduce(DataFrame.unionByName,
                  [_payload_violations(df, t).select("isin", "table", "reason")
                   for t, df in payloads.items()])
    known = known_keys(hub, keys, broadcast_keys)
    if broadcast_keys:  # known is a subset of the checked keys
        known = F.broadcast(known)
    unknown = (keys.join(known, "isin", "left_anti")
               .select("isin", F.lit("share_isins").alias("table"),
                       F.lit("unknown_isin").alias("reason")))
    rejects = viol.unionByName(unknown)
    accepted = keys.join(rejects.select("isin"), "isin", "left_anti")
    return accepted, rejects


def collapse_shares(batch: DataFrame) -> DataFrame:
    """One row per ISIN of a batch that mixes the payloads: the columns of all
    four satellites, and per satellite ``_at_<table>``, the newest stamp of its
    records (NULL: the batch has none; a record of satellite t has ``_has_<t>``)."""
    cols = [c for t in schemas.SATELLITES for c in schemas.non_key_columns(t)]
    ordered = batch.withColumn("_ord", _order(batch, cols))
    return ordered.groupBy("isin").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_ord"))).alias(c) for c in cols],
        *[F.max(F.when(F.col(f"_has_{t}"), F.col("updated_at"))).alias(f"_at_{t}") for t in schemas.SATELLITES])


def payload(collapsed: DataFrame, table: str) -> DataFrame:
    """The rows of one satellite in ``collapse_shares``' result."""
    return collapsed.where(F.col(f"_at_{table}").isNotNull()).select(
        "isin", *schemas.non_key_columns(table), F.col(f"_at_{table}").alias("updated_at"))


def judge_shares(wide: DataFrame, hub: DataFrame, broadcast_keys: bool = False) -> DataFrame:
    """``validate_shares`` for one collapsed record per ISIN: the record plus
    ``_why``, an array of (table, reason), empty if it is accepted. Breaches are
    row-local and the hub is joined once. A satellite that the record doesn't
    have (NULL ``_at_<table>``, where there is such a column) breaks nothing."""
    checks = []
    for t in schemas.SATELLITES:
        has = F.col(f"_at_{t}").isNotNull() if f"_at_{t}" in wide.columns else F.lit(True)
        for cond, reason in _checks(wide, t):
            checks.append(F.when(has & cond, F.struct(F.lit(t).alias("table"), F.lit(reason).alias("reason"))))
    if broadcast_keys:  # the hub is only scanned; a subset of the checked keys comes back
        known = F.broadcast(known_keys(hub, wide.where(F.col("isin").isNotNull()), True))
    else:  # the hub's key is unique: the record meets it directly, and is computed once
        known = hub.select("isin")
    known = known.withColumn("_known", F.lit(True))
    checks.append(F.when(F.col("isin").isNotNull() & F.col("_known").isNull(),
                         F.struct(F.lit("share_isins").alias("table"), F.lit("unknown_isin").alias("reason"))))
    return wide.join(known, "isin", "left").withColumn("_why", F.array_compact(F.array(*checks))).drop("_known")


def accepted_shares(judged: DataFrame) -> DataFrame:
    return judged.where((F.size("_why") == 0) & F.col("isin").isNotNull())


def rejects_of(judged: DataFrame) -> DataFrame:
    """(isin, table, reason)"""
    return judged.select("isin", F.inline("_why"))


def accepted_only(df: DataFrame, accepted: DataFrame, table: str) -> DataFrame:
    out = [f.name for f in schemas.TABLES[table].fields]
    return df.join(accepted, "isin", "left_semi").select(*out)


def dedupe_instruments(found: DataFrame) -> DataFrame:
    """Instrument set: identity is (share_name, isin); ``updated_at`` is
    not part of it. The earliest stamp of equal elements is kept."""
    return found.groupBy("share_name", "isin").agg(F.min("updated_at").alias("updated_at")) \
        .select("isin", "share_name", "updated_at")


def insert_absent(hub: DataFrame, candidates: DataFrame,
                  broadcast_candidates: bool = False) -> tuple[DataFrame, DataFrame]:
    """Hub insert of (isin, share_name, updated_at) candidates.

    A candidate is inserted when its ISIN is not stored yet, its values fit
    the hub's constraints, and it is the first candidate of its ISIN in
    (updated_at, share_name) order (a second one would hit the primary
    key). Stored rows never change. Returns (new rows, per-candidate
    outcome with ``inserted`` and ``reason``). With ``broadcast_candidates``
    (the caller checked the candidate set is small) the hub is only
    scanned, never shuffled.
    """
    c = candidates.select("isin", "share_name", "updated_at")
    bad = (F.when(F.col("isin").isNull() | F.col("share_name").isNull() | F.col("updated_at").isNull(),
                  F.lit("null_value"))
           .when(F.char_length("isin") > 12, F.lit("isin_too_long"))
           .when(F.char_length("share_name") > 50, F.lit("share_name_too_long")))
    c = c.withColumn("_bad", bad)
    first = (c.where(F.col("_bad").isNull()).groupBy("isin")
             .agg(F.min(F.struct("updated_at", "share_name")).alias("_first")))
    stored = known_keys(hub, c.select("isin").distinct(), broadcast_candidates) \
        .withColumn("_stored", F.lit(True))
    if broadcast_candidates:  # both are bounded by the checked candidates
        first, stored = F.broadcast(first), F.broadcast(stored)
    o = (c.join(first, "isin", "left").join(stored, "isin", "left")
         .withColumn("reason", F.coalesce(
             F.col("_bad"),
             F.when(F.col("_stored"), F.lit("isin_exists")),
             F.when((F.col("_first.updated_at") != F.col("updated_at"))
                    | (F.col("_first.share_name") != F.col("share_name")),
                    F.lit("duplicate_isin_in_batch"))))
         .withColumn("inserted", F.col("reason").isNull()))
    outcome = o.select("isin", "share_name", "updated_at", "inserted", "reason")
    new_rows = outcome.where("inserted").select("isin", "share_name", "updated_at")
    return new_rows, outcome


def flatten_price(df: DataFrame) -> DataFrame:
    """Nested price pairs -> flat store columns, in place: a struct column
    ``max_anno{price, date}`` becomes ``max_anno`` and ``max_anno_date``."""
    out = []
    for c in df.columns:
        if c in schemas.PRICE_STRUCTS:
            pcol, tcol, tname = schemas.PRICE_STRUCTS[c]
            out += [F.col(c)["price"].alias(pcol), F.col(c)[tname].alias(tcol)]
        else:
            out.append(F.col(c))
    return df.select(*out)


def empty_records(instruments: DataFrame, table: str, as_of: Column) -> DataFrame:
    """An all-NULL record of ``table`` for every instrument: key and stamp
    set, every other column NULL."""
    cols = [F.lit(None).cast(f.dataType).alias(f.name)
            for f in schemas.TABLES[table].fields if f.name not in ("isin", "updated_at")]
    return instruments.select("isin", *cols, as_of.cast("timestamp_ntz").alias("updated_at"))
