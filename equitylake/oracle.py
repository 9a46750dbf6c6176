"""DuckDB SQL that recomputes each registered query independently.

The stand-in store rules of ``equitylake.sources.adapter`` are repeated
here as CTEs over the same Parquet views, so every check compares the
library's Spark operators with plain SQL over identical inputs.
"""

from __future__ import annotations

import datetime as dt

from . import schemas
from .sources.adapter import CUT, SNAPSHOT_AS_OF

ISIN = ("upper(substr(c_mktsegment, 1, 2)) || lpad(CAST(c_custkey AS VARCHAR), 9, '0') "
        "|| CAST(c_custkey % 10 AS VARCHAR)")


def ts(x: dt.datetime) -> str:
    return f"TIMESTAMP '{x:%Y-%m-%d %H:%M:%S}'"


def _mins(expr: str) -> str:
    return f"(TIMESTAMP '1995-01-01 00:00:00' + to_minutes(CAST({expr} AS BIGINT)))"


HUB = f"SELECT {ISIN} AS isin, c_name AS share_name, {_mins('c_custkey')} AS updated_at FROM customer"

DETAILS = (f"SELECT {ISIN} AS isin, CAST(c_custkey AS DOUBLE) AS id_strumento, "
           "upper(substr(c_mktsegment, 1, 3)) || '-' || CAST(c_nationkey AS VARCHAR) AS codice_alfanumerico, "
           f"{_mins('c_custkey + 60')} AS updated_at FROM customer WHERE c_acctbal >= 0")

MARKET = (f"SELECT {ISIN} AS isin, n_name AS super_sector, c_mktsegment AS mercato_segmento, "
          "c_acctbal * CAST(1000.0 AS DOUBLE) AS capitalizzazione_di_mercato, "
          "CAST((n_regionkey + 1) * 100 AS DOUBLE) AS lotto_minimo, "
          f"{_mins('c_custkey + 120')} AS updated_at "
          "FROM customer JOIN nation ON c_nationkey = n_nationkey")

DETAILS_BATCH = (f"SELECT {ISIN} AS isin, c_custkey + CAST(0.5 AS DOUBLE) AS id_strumento, "
                 "CASE WHEN c_mktsegment <> 'BUILDING' THEN 'N-' || CAST(c_custkey AS VARCHAR) END AS codice_alfanumerico, "
                 f"{_mins('c_custkey + 1440')} AS updated_at FROM customer WHERE c_acctbal < 1000")

MARKET_BATCH = (f"SELECT {ISIN} AS isin, r_name AS super_sector, CAST(NULL AS VARCHAR) AS mercato_segmento, "
                "CASE WHEN c_acctbal >= 0 THEN c_acctbal * CAST(2000.0 AS DOUBLE) END AS capitalizzazione_di_mercato, "
                "CAST(NULL AS DOUBLE) AS lotto_minimo, "
                f"{_mins('c_custkey + 2880')} AS updated_at "
                "FROM customer JOIN nation ON c_nationkey = n_nationkey "
                "JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")


def _trade_aggs(start: str, end: str) -> str:
    since = lambda days: f"o_orderdate >= {end} - INTERVAL {days} DAY"
    dkp = "struct_pack(d := o_orderdate, k := o_orderkey, p := o_totalprice)"
    pdk = "struct_pack(p := o_totalprice, d := o_orderdate, k := o_orderkey)"
    return f"""
        max(struct_pack(d := o_orderdate, k := o_orderkey, p := o_totalprice, s := o_orderstatus)) AS "last",
        min({dkp}) AS "first",
        max({pdk}) AS hi_all,
        min({pdk}) AS lo_all,
        max({pdk}) FILTER (WHERE o_orderdate >= {start}) AS hi,
        min({pdk}) FILTER (WHERE o_orderdate >= {start}) AS lo,
        min({dkp}) FILTER (WHERE o_orderdate >= {start}) AS first_y,
        min({dkp}) FILTER (WHERE {since(182)}) AS first_6m,
        min({dkp}) FILTER (WHERE {since(30)}) AS first_1m,
        count(*) AS n,
        count(*) FILTER (WHERE o_orderdate >= {start}) AS n_y,
        round(sum(o_totalprice), 2) AS total"""


def _snapshot(as_of: dt.datetime) -> str:
    start = ts(as_of - dt.timedelta(days=365))
    return (f"SELECT c.*, a.* FROM (SELECT o_custkey, {_trade_aggs(start, ts(as_of))} "
            f"FROM orders WHERE o_orderdate <= {ts(as_of)} GROUP BY o_custkey) a "
            "JOIN customer c ON a.o_custkey = c.c_custkey")


def _yearly(after: dt.datetime) -> str:
    start = "make_timestamp(yr, 1, 1, 0, 0, 0)"
    end = "make_timestamp(yr, 12, 31, 0, 0, 0)"
    return (f"SELECT c.*, a.* FROM (SELECT o_custkey, yr, {_trade_aggs(start, end)} "
            f"FROM (SELECT *, year(o_orderdate) AS yr FROM orders WHERE o_orderdate >= {ts(after)}) "
            "GROUP BY o_custkey, yr) a JOIN customer c ON a.o_custkey = c.c_custkey")


PRICE_COLS = f"""{ISIN} AS isin,
    CASE WHEN "last".s = 'O' THEN 'Negoziazione continua' WHEN "last".s = 'F' THEN 'Chiusura' END AS fase_di_mercato,
    "last".p AS prezzo_ultimo_contratto,
    ("last".p - "first".p) / "first".p * 100 AS var_percentuale,
    "last".p - "first".p AS var_assoluta,
    total / n AS pr_medio_progr,
    "last".d AS data_ora_ultimo_contratto,
    CAST(n_y AS DOUBLE) AS quantita_ultimo,
    CAST(n AS DOUBLE) AS quantita_totale,
    CAST(n AS INTEGER) AS numero_contratti,
    total AS controvalore,
    greatest("last".p, "first".p) AS max_oggi,
    hi.p AS max_anno, CAST(hi.d AS DATE) AS max_anno_date,
    least("last".p, "first".p) AS min_oggi,
    lo.p AS min_anno, CAST(lo.d AS DATE) AS min_anno_date,
    lo_all.p AS chiusura_precedente,
    hi_all.p AS prezzo_riferimento, hi_all.d AS data_ora_prezzo_rifermento,
    "last".p AS prezzo_ufficiale, CAST("last".d AS DATE) AS data_prezzo_ufficiale,
    "first".p AS apertura_odierna,
    "last".d + INTERVAL 18 HOUR AS updated_at"""

PERF_COLS = f"""{ISIN} AS isin,
    ("last".p - first_1m.p) / first_1m.p * 100 AS performance_1_mese,
    ("last".p - first_6m.p) / first_6m.p * 100 AS performance_6_mesi,
    ("last".p - first_y.p) / first_y.p * 100 AS performance_1_anno,
    "last".d + INTERVAL 18 HOUR AS updated_at"""

PRICE = f"SELECT {PRICE_COLS} FROM ({_snapshot(SNAPSHOT_AS_OF)})"
PERF = f"SELECT {PERF_COLS} FROM ({_snapshot(SNAPSHOT_AS_OF)}) WHERE n_y > 0"
PRICE_AT_CUT = f"SELECT {PRICE_COLS} FROM ({_snapshot(CUT)})"
PERF_AT_CUT = f"SELECT {PERF_COLS} FROM ({_snapshot(CUT)}) WHERE n_y > 0"
PRICE_BATCH = f"SELECT {PRICE_COLS} FROM ({_yearly(CUT)})"
PERF_BATCH = f"SELECT {PERF_COLS} FROM ({_yearly(CUT)})"

STORE_CTES = f"""si AS ({HUB}),
sd AS ({DETAILS}),
mi AS ({MARKET}),
pd AS ({PRICE}),
pm AS ({PERF})"""

_CTE = {"share_isins": "si", "share_details": "sd", "market_information": "mi",
        "price_data": "pd", "performance_metrics": "pm"}


def _stamps(tables) -> str:
    """(isin, stamp): every stamp of the given tables."""
    return " UNION ALL ".join(f"SELECT isin, updated_at AS stamp FROM {_CTE[t]}" for t in tables)


def view_sql(where: str = "", ctes: str = STORE_CTES) -> str:
    """Every instrument with what each table knows of it and its newest stamp."""
    satellites = [t for t in schemas.TABLES if t != "share_isins"]
    cols = ", ".join(c for t in satellites for c in schemas.non_key_columns(t))
    parts = " ".join(f"LEFT JOIN (SELECT isin, {', '.join(schemas.non_key_columns(t))} FROM {_CTE[t]}) USING (isin)"
                     for t in satellites)
    return (f"WITH {ctes}, newest AS (SELECT isin, max(stamp) AS updated_at FROM ({_stamps(schemas.TABLES)}) GROUP BY isin), "
            f"listed AS (SELECT isin, share_name FROM si {'WHERE ' + where if where else ''}) "
            f"SELECT isin, share_name, {cols}, updated_at FROM listed JOIN newest USING (isin) {parts}")


def stale_sql(as_of: dt.datetime, min_age: dt.timedelta) -> str:
    """Instruments whose newest satellite stamp, 1970 if there is none, is old."""
    satellites = [t for t in schemas.TABLES if t != "share_isins"]
    us = int(min_age.total_seconds() * 1_000_000)
    return (f"WITH {STORE_CTES}, newest AS (SELECT isin, max(stamp) AS stamp FROM ("
            f"SELECT isin, TIMESTAMP '1970-01-01 00:00:00' AS stamp FROM si UNION ALL {_stamps(satellites)}) GROUP BY isin) "
            "SELECT isin, share_name, stamp AS updated_at FROM si JOIN newest USING (isin) "
            f"WHERE stamp <= {ts(as_of)} - to_microseconds({us})")


def collapse_sql(table: str, batch_sql: str) -> str:
    """Per column, the last non-NULL value by updated_at."""
    cols = schemas.non_key_columns(table)
    aggs = ", ".join(f"arg_max({c}, updated_at) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in cols)
    return f"SELECT isin, {aggs}, max(updated_at) AS updated_at FROM ({batch_sql}) GROUP BY isin"


def merge_sql(table: str, stored_sql: str, batch_sql: str) -> str:
    cols = schemas.non_key_columns(table) + ["updated_at"]
    sel = ", ".join(f"COALESCE(b.{c}, t.{c}) AS {c}" for c in cols)
    return (f"SELECT COALESCE(b.isin, t.isin) AS isin, {sel} FROM ({stored_sql}) t "
            f"FULL OUTER JOIN ({batch_sql}) b ON t.isin = b.isin")


LISTED_HUB = (f"SELECT {ISIN} AS isin, c_name AS share_name, {_mins('c_custkey')} AS updated_at "
              "FROM customer WHERE c_acctbal >= 0")

PAYLOADS = {
    "share_details": collapse_sql("share_details", DETAILS_BATCH),
    "market_information": collapse_sql("market_information", MARKET_BATCH),
    "price_data": collapse_sql("price_data", PRICE_BATCH),
    "performance_metrics": collapse_sql("performance_metrics", PERF_BATCH),
}


def _rejects_sql() -> str:
    parts = []
    for t, q in PAYLOADS.items():
        for c, n in schemas.VARCHAR_LIMITS[t].items():
            parts.append(f"SELECT isin, '{t}' AS \"table\", '{c}_too_long' AS reason "
                         f"FROM ({q}) WHERE length({c}) > {n}")
    keys = " UNION ".join(f"SELECT isin FROM ({q})" for q in PAYLOADS.values())
    parts.append(f"SELECT isin, 'share_isins' AS \"table\", 'unknown_isin' AS reason FROM ({keys}) k "
                 f"WHERE isin NOT IN (SELECT isin FROM ({LISTED_HUB}))")
    return " UNION ALL ".join(parts)


def _keys_sql() -> str:
    return " UNION ".join(f"SELECT isin FROM ({q})" for q in PAYLOADS.values())


def _accepted_sql() -> str:
    return f"SELECT isin FROM ({_keys_sql()}) WHERE isin NOT IN (SELECT isin FROM ({_rejects_sql()}))"


def _insert_outcome_sql() -> str:
    return (f"WITH c AS ({HUB}), f AS (SELECT isin, min(struct_pack(u := updated_at, n := share_name)) AS fst "
            "FROM c WHERE isin IS NOT NULL AND share_name IS NOT NULL AND length(isin) <= 12 "
            "AND length(share_name) <= 50 GROUP BY isin) "
            "SELECT c.isin, c.share_name, c.updated_at, "
            f"(c.isin NOT IN (SELECT isin FROM ({LISTED_HUB})) AND f.fst.u = c.updated_at "
            "AND f.fst.n = c.share_name) AS inserted FROM c LEFT JOIN f ON c.isin = f.isin")


_LINK_RE = """'<a href="([^"]*)">([^<]*)</a>'"""


def _unescape(x: str) -> str:
    return (f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), "
            f"""'&quot;', '"'), '&#39;', ''''), '&amp;', '&')""")


NAV_LINKS = (f"SELECT page_id, CAST(link_ord AS INTEGER) AS link_ord, {_unescape('href')} AS href, "
             f"nullif({_unescape('name')}, '') AS name FROM (SELECT page_id, "
             "unnest(range(len(h))) AS link_ord, unnest(h) AS href, unnest(n) AS name FROM ("
             f"SELECT page_id, regexp_extract_all(html, {_LINK_RE}, 1) AS h, "
             f"regexp_extract_all(html, {_LINK_RE}, 2) AS n "
             "FROM pages WHERE html IS NOT NULL AND html <> ''))")

_HREF_ISIN = "split_part(regexp_extract(href, '[^/]*$'), '.', 1)"


def _link_class_sql() -> str:
    ok_isin = (f"(octet_length(encode({_HREF_ISIN})) = 12 "
               f"AND regexp_matches(right({_HREF_ISIN}, 1), '^[0-9]$'))")
    return (f"SELECT *, {_HREF_ISIN} AS isin, CASE WHEN href IS NULL OR name IS NULL THEN 'invalid_page' "
            f"WHEN name = '' OR NOT {ok_isin} THEN 'parsing_error' END AS error FROM ({NAV_LINKS})")


def _detail_expected() -> str:
    cols = [c for t in ("price_data", "share_details", "market_information", "performance_metrics")
            for c in schemas.non_key_columns(t)]
    return (f"SELECT isin, {', '.join(cols)} FROM ({view_sql()}) "
            "WHERE (mercato_segmento IS NULL OR mercato_segmento <> 'AUTOMOBILE') "
            "AND id_strumento IS NOT NULL")


def _extraction_sql(C) -> dict[str, str]:
    return {
        "detail_extract": _detail_expected(),
        "requested_extract": (f"SELECT * FROM ({_detail_expected()}) WHERE isin IN "
                              f"(SELECT isin FROM ({stale_sql(C.RUN_AS_OF, C.REFRESH_MIN_AGE)}))"),
        "scrape_metrics": (
            "SELECT CAST(count(*) AS INTEGER) AS total, "
            "CAST(count(*) FILTER (WHERE NOT auto AND has_details) AS INTEGER) AS successful, "
            "CAST(count(*) FILTER (WHERE auto) AS INTEGER) AS network_error, "
            "CAST(count(*) FILTER (WHERE NOT auto AND NOT has_details) AS INTEGER) AS invalid_page, "
            "0 AS timeout, 0 AS max_retries, 0 AS parsing_error FROM ("
            "SELECT coalesce(mercato_segmento = 'AUTOMOBILE', FALSE) AS auto, "
            "id_strumento IS NOT NULL AS has_details FROM (" + view_sql() + "))"),
        "link_extract": NAV_LINKS,
        "link_dedupe": (f"SELECT isin, name AS share_name, min({ts(C.RUN_AS_OF)}) AS updated_at "
                        f"FROM ({_link_class_sql()}) WHERE (error IS NULL OR error = 'parsing_error') "
                        "AND name IS NOT NULL GROUP BY name, isin"),
        "listing_metrics": (
            "SELECT CAST(count(*) AS INTEGER) AS total, "
            "CAST(count(*) FILTER (WHERE error IS NULL) AS INTEGER) AS successful, "
            "0 AS network_error, "
            "CAST(count(*) FILTER (WHERE error = 'invalid_page') + "
            "(SELECT count(*) FROM pages WHERE html IS NULL OR html = '') AS INTEGER) AS invalid_page, "
            "0 AS timeout, 0 AS max_retries, "
            "CAST(count(*) FILTER (WHERE error = 'parsing_error') AS INTEGER) AS parsing_error "
            f"FROM ({_link_class_sql()})"),
        "detail_urls": ("SELECT isin, 'https://www.borsaitaliana.it/borsa/azioni/dati-completi.html?isin=' "
                        f"|| isin || '&lang=it' AS url FROM ({HUB})"),
    }


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle_sql() -> dict[str, str]:
    from .plans import catalog as C
    nested = (
        "SELECT substr(isin, 1, 2) AS country, substr(isin, 3, 9) AS nna, "
        "CAST(substr(isin, 12, 1) AS INTEGER) AS check_digit, share_name, codice_alfanumerico, "
        "max_anno AS max_anno_price, max_anno_date, data_ora_prezzo_rifermento AS rif_datetime, "
        "CAST(numero_contratti AS BIGINT) AS numero_contratti, performance_1_anno AS perf_1_anno, "
        "updated_at AS market_stamp, TRUE AS has_perf_object, "
        "performance_1_mese IS NULL AS perf_1m_null FROM (" + view_sql() + ")")
    return {
        **_extraction_sql(C),
        **refresh_sql(C),
        **discovery_sql(C),
        **added_sql(C),
        "fetch_outcome": FETCH_RESOLVED,
        "fetch_outcome_stream": FETCH_RESOLVED,
        "fetch_timeout_stream": fetch_timeout_sql(C),
        "isins_json": (f"SELECT share_name, substr(isin, 1, 2) AS country, substr(isin, 3, 9) AS nna, "
                       f"CAST(substr(isin, 12, 1) AS INTEGER) AS check_digit, updated_at FROM ({HUB})"),
        "fetch_metrics": FETCH_METRICS,
        "current_view": view_sql(),
        "stored_view": view_sql(),
        "view_by_isin": view_sql(f"si.isin = {_q(C.LOOKUP_ISIN)}"),
        "view_by_prefix": view_sql(f"si.isin ILIKE ({_q(C.LOOKUP_LANG)} || '%')"),
        "view_by_name": view_sql(f"si.share_name ILIKE ('%' || {_q(C.LOOKUP_NAME)} || '%')"),
        "view_by_prefix_and_name": view_sql(
            f"si.isin ILIKE ('Ho' || '%') AND si.share_name ILIKE ('%' || {_q(C.LOOKUP_NAME)} || '%')"),
        "view_by_name_indexed": view_sql(f"si.share_name ILIKE ('%' || {_q(C.LOOKUP_NAME)} || '%')"),
        "view_by_prefix_and_name_indexed": view_sql(
            f"si.isin ILIKE ('Ho' || '%') AND si.share_name ILIKE ('%' || {_q(C.LOOKUP_NAME)} || '%')"),
        "view_isin_wins": view_sql(f"si.isin = {_q(C.LOOKUP_ISIN)}"),
        "view_request_empty_params": view_sql("si.isin ILIKE ('ma' || '%')"),
        **dict.fromkeys(("stale_set", "stale_set_layout"), stale_sql(C.STALE_AS_OF, C.STALE_MIN_AGE)),
        "view_by_prefix_layout": view_sql(f"si.isin ILIKE ({_q(C.LOOKUP_LANG)} || '%')"),
        "nested_share_json": nested,
        "number_parse": "SELECT l_orderkey, l_linenumber, l_extendedprice AS price_it, "
                        "l_extendedprice AS price_us, -l_extendedprice AS price_neg, "
                        "CAST(NULL AS DOUBLE) AS junk FROM lineitem",
        "int_parse": "SELECT o_orderkey, CAST(o_orderkey AS INTEGER) AS parsed, "
                     "CAST(NULL AS INTEGER) AS negative, o_orderkey * 1000000 > 2147483647 AS past_int FROM orders",
        "datetime_parse": "SELECT event_id, date_trunc('second', ts) AS dt1, "
                          "date_trunc('second', ts) AS dt2, CAST(NULL AS TIMESTAMP) AS trailing, "
                          "CAST(NULL AS TIMESTAMP) AS newline FROM events",
        "date_parse": "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS ship_date, "
                      "CAST(NULL AS DATE) AS newline FROM lineitem",
        "price_date_split": "SELECT o_orderkey, o_totalprice AS price, CAST(o_orderdate AS DATE) AS date, "
                            "CAST(NULL AS DATE) AS newline, TRUE AS no_separator_is_null FROM orders",
        "price_datetime_split": "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS price, "
                                "CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('second', ts) END AS datetime, "
                                "TRUE AS present FROM events",
        "isin_parse": (
            f"WITH si AS ({HUB}), v AS (SELECT isin AS raw FROM si UNION ALL "
            "SELECT isin || 'X' FROM si UNION ALL SELECT substr(isin, 1, 11) || 'Z' FROM si) "
            "SELECT raw, CASE WHEN ok THEN substr(raw, 1, 2) END AS country, "
            "CASE WHEN ok THEN substr(raw, 3, 9) END AS nna, "
            "CASE WHEN ok THEN CAST(substr(raw, 12, 1) AS INTEGER) END AS check_digit, "
            "CASE WHEN strlen(raw) <> 12 THEN 'invalid_length' "
            "WHEN NOT regexp_matches(substr(raw, 12, 1), '^[0-9]$') THEN 'invalid_check_digit' END AS error, "
            "CASE WHEN ok THEN raw END AS formatted FROM (SELECT raw, strlen(raw) = 12 AND "
            "regexp_matches(substr(raw, 12, 1), '^[0-9]$') AS ok FROM v)"),
        "upsert_price": merge_sql("price_data", PRICE_AT_CUT, PAYLOADS["price_data"]),
        "upsert_performance": merge_sql("performance_metrics", PERF_AT_CUT, PAYLOADS["performance_metrics"]),
        "upsert_details": merge_sql("share_details", DETAILS, PAYLOADS["share_details"]),
        "upsert_market": merge_sql("market_information", MARKET, PAYLOADS["market_information"]),
        "fk_rejects": _rejects_sql(),
        "share_write_accepted": merge_sql(
            "price_data", PRICE_AT_CUT,
            f"SELECT * FROM ({PAYLOADS['price_data']}) WHERE isin IN ({_accepted_sql()})"),
        "write_metrics": (f"SELECT CAST((SELECT count(*) FROM ({_keys_sql()})) AS INTEGER) AS total, "
                          f"CAST((SELECT count(*) FROM ({_accepted_sql()})) AS INTEGER) AS successful"),
        "insert_absent": f"SELECT isin, share_name, updated_at FROM ({_insert_outcome_sql()}) WHERE inserted",
        "insert_metrics": (f"SELECT CAST(count(*) AS INTEGER) AS total, "
                           f"CAST(count(*) FILTER (WHERE inserted) AS INTEGER) AS successful "
                           f"FROM ({_insert_outcome_sql()})"),
    }


FETCH_LOG = """WITH a0 AS (
  SELECT 'https://fetch.example.org/u/' || CAST(event_id // 8 AS VARCHAR) AS url,
         CAST(event_id % 8 + 1 AS INTEGER) AS attempt_no,
         event_type = 'signup' AND value < 50 AS net_error,
         CASE WHEN event_type = 'signup' AND value < 50 THEN NULL
              WHEN event_type = 'view' THEN 200 WHEN event_type = 'click' THEN 503
              WHEN event_type = 'error' THEN 500 WHEN event_type = 'purchase' THEN 429
              ELSE 404 END AS status,
         value, props, CAST(round(value * 100) AS BIGINT) AS dur_ms, ts FROM events),
a1 AS (SELECT *, min(ts) OVER (PARTITION BY url) AS base,
         coalesce(sum(dur_ms) OVER (PARTITION BY url ORDER BY attempt_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM a0),
log AS (SELECT url, attempt_no, status, net_error,
         CASE WHEN status = 200 THEN CASE WHEN value < 5 THEN '' ELSE props END END AS body,
         base + to_milliseconds(prev + ((1 << attempt_no) - 2) * 1000) AS started_at,
         base + to_milliseconds(prev + ((1 << attempt_no) - 2) * 1000 + dur_ms) AS ended_at FROM a1)"""

FETCH_RESOLVED = FETCH_LOG + """,
a AS (SELECT *, CASE WHEN net_error THEN 'exit' WHEN status = 200 THEN 'return'
         WHEN status IN (429, 502, 503, 504, 500) THEN 'retry' ELSE 'exit' END AS cls
      FROM log WHERE attempt_no BETWEEN 1 AND 8),
g AS (SELECT url,
         min(struct_pack(n := attempt_no, cls := cls, e := ended_at, status := status,
                         empty := (body IS NULL OR body = ''))) FILTER (WHERE cls <> 'retry') AS d,
         count(*) FILTER (WHERE cls = 'retry') AS n_retry,
         max(ended_at) FILTER (WHERE attempt_no = 8) AS end_last,
         min(started_at) AS start, max(ended_at) AS end_seen, count(*) AS attempts
      FROM a GROUP BY url),
h AS (SELECT *, d IS NULL AND n_retry >= 8 AS exhausted,
         CASE WHEN d IS NOT NULL THEN d.e WHEN d IS NULL AND n_retry >= 8 THEN end_last
              ELSE end_seen END AS fin FROM g),
o AS (SELECT *, CASE WHEN fin > start + INTERVAL 256 SECOND THEN 'timeout'
                     WHEN d IS NOT NULL THEN d.cls WHEN exhausted THEN 'max_retries'
                     ELSE 'pending' END AS outcome FROM h)
SELECT url, CAST(attempts AS INTEGER) AS attempts, outcome,
       CASE WHEN outcome = 'exit' THEN 'network_error'
            WHEN outcome IN ('timeout', 'max_retries') THEN outcome
            WHEN outcome = 'return' AND d.empty THEN 'invalid_page' END AS error,
       d.n AS decisive_attempt, d.status AS status,
       date_diff('millisecond', start, fin) AS elapsed_ms FROM o"""

def fetch_timeout_sql(C) -> str:
    return FETCH_LOG + f""",
a AS (SELECT *, CASE WHEN net_error THEN 'exit' WHEN status = 200 THEN 'return'
         WHEN status IN (429, 502, 503, 504, 500) THEN 'retry' ELSE 'exit' END AS cls
      FROM log WHERE attempt_no <= {C.SILENT_AFTER}),
s AS (SELECT *, min(started_at) OVER (PARTITION BY url) AS start FROM a),
g AS (SELECT url, start, start + INTERVAL 256 SECOND AS latest,
         min(struct_pack(n := attempt_no, cls := cls, e := ended_at, status := status,
                         empty := (body IS NULL OR body = ''))) FILTER (WHERE cls <> 'retry') AS d,
         count(*) FILTER (WHERE ended_at <= start + INTERVAL 256 SECOND) AS in_time
      FROM s GROUP BY url, start),
h AS (SELECT *, d IS NOT NULL AND d.e <= latest AS decided FROM g),
w AS (SELECT max(ended_at) - INTERVAL {C.LATENESS_MINUTES} MINUTE AS passed FROM a)
SELECT url, start AS started_at, CAST(CASE WHEN decided THEN d.n ELSE in_time END AS INTEGER) AS attempts,
       CASE WHEN decided THEN d.cls ELSE 'timeout' END AS outcome,
       CASE WHEN NOT decided THEN 'timeout' WHEN d.cls = 'exit' THEN 'network_error'
            WHEN d.empty THEN 'invalid_page' END AS error,
       CASE WHEN decided THEN d.n END AS decisive_attempt, CASE WHEN decided THEN d.status END AS status,
       CASE WHEN decided THEN date_diff('millisecond', start, d.e) ELSE 256000 END AS elapsed_ms
FROM h, w WHERE d IS NOT NULL OR latest < passed"""


FETCH_METRICS = ("SELECT CAST(count(*) AS INTEGER) AS total, "
                 "CAST(count(*) FILTER (WHERE error IS NULL) AS INTEGER) AS successful, "
                 + ", ".join(f"CAST(count(*) FILTER (WHERE error = '{k}') AS INTEGER) AS {k}"
                             for k in schemas.ERROR_KINDS)
                 + f" FROM ({FETCH_RESOLVED}) WHERE outcome <> 'pending'")


def _refreshed_sql(C) -> str:
    """ISINs the registered refresh updates: due for refresh and with a
    fetched, non-empty detail page (stand-in page rules)."""
    return (f"SELECT v.isin FROM ({view_sql()}) v JOIN ({stale_sql(C.RUN_AS_OF, C.REFRESH_MIN_AGE)}) s "
            "ON v.isin = s.isin WHERE (v.mercato_segmento IS NULL OR v.mercato_segmento <> 'AUTOMOBILE') "
            "AND v.id_strumento IS NOT NULL")


def stream_refresh_sql(C) -> str:
    """Every instrument with a fetched, non-empty page is refreshed."""
    cols = ["isin", "share_name"] + [c for t in schemas.SATELLITES for c in schemas.non_key_columns(t)]
    ok = (f"SELECT isin FROM ({view_sql()}) WHERE (mercato_segmento IS NULL OR "
          "mercato_segmento <> 'AUTOMOBILE') AND id_strumento IS NOT NULL")
    return (f"SELECT {', '.join(cols)}, CASE WHEN isin IN ({ok}) THEN {ts(C.RUN_AS_OF)} "
            f"ELSE updated_at END AS updated_at FROM ({view_sql()})")


def _validation_sql() -> str:
    key = "CAST(substr(isin, 3, 9) AS BIGINT)"
    batch = {t: f"({q})" for t, q in PAYLOADS.items()}
    keys = f"SELECT isin, {key} AS k FROM ({_keys_sql()})"
    parts = [f"SELECT isin, 'market_information' AS \"table\", 'super_sector_too_long' AS reason "
             f"FROM ({keys}) WHERE k % 3 = 0 AND isin IN (SELECT isin FROM {batch['market_information']})",
             f"SELECT isin, 'price_data', 'numero_contratti_out_of_int_range' FROM ("
             f"SELECT isin, numero_contratti, {key} AS k FROM {batch['price_data']}) "
             "WHERE CAST(numero_contratti AS HUGEINT) * k * 1000000 > 2147483647"]
    parts += [f"SELECT isin, '{t}', 'updated_at_null' FROM ({keys}) WHERE k % 9 = 1 "
              f"AND isin IN (SELECT isin FROM {q})" for t, q in batch.items()]
    return " UNION ALL ".join(parts)


def _metrics_total_sql(C) -> str:
    runs = [discovery_sql(C)["discovery_metrics"], _extraction_sql(C)["scrape_metrics"]]
    cols = ["total", "successful", *schemas.ERROR_KINDS]
    return (f"SELECT {', '.join(f'CAST(sum({c}) AS INTEGER) AS {c}' for c in cols)} FROM ("
            + " UNION ALL ".join(f"SELECT {', '.join(cols)} FROM ({r})" for r in runs) + ")")


def added_sql(C) -> dict[str, str]:
    price_null = ", ".join(f"NULL AS {c}" for c in schemas.non_key_columns("price_data"))
    fetched = ("(mercato_segmento IS NULL OR mercato_segmento <> 'AUTOMOBILE') AND id_strumento IS NOT NULL")
    kinds = ", ".join(f"CAST(count(*) FILTER (WHERE error = '{k}') AS INTEGER) AS {k}" for k in schemas.ERROR_KINDS)
    return {
        "write_validation": _validation_sql(),
        "empty_records": f"SELECT isin, {price_null}, {ts(C.RUN_AS_OF)} AS updated_at FROM ({HUB})",
        "price_flatten": ("SELECT isin, max_anno, max_anno_date, min_anno, min_anno_date, prezzo_riferimento, "
                          f"data_ora_prezzo_rifermento, prezzo_ufficiale, data_prezzo_ufficiale FROM ({PRICE})"),
        "share_count": (f"SELECT 'all' AS lookup, count(*) AS n, count(*) = 0 AS empty FROM ({HUB}) UNION ALL "
                        f"SELECT '0', count(*), count(*) = 0 FROM ({HUB}) WHERE starts_with(isin, '0')"),
        "metrics_total": _metrics_total_sql(C),
        "parse_defaults": ("SELECT o_orderkey, o_totalprice AS price, 0.0::DOUBLE AS float_default, 0 AS int_default, "
                           "coalesce(nullif(o_orderstatus, 'O'), 'N/A') AS text_default, "
                           "TIMESTAMP '1970-01-01 00:00:00' AS datetime_default, TRUE AS pair_default FROM orders"),
        "view_prefix_backslash": view_sql("starts_with(lower(si.isin), 'ma%')"),
        "refresh_all_view": stream_refresh_sql(C),
        "page_copies_newest": f"SELECT isin, 1.0::DOUBLE AS prezzo_ultimo_contratto FROM ({view_sql()}) WHERE {fetched}",
        "fetch_outcome_share_budget": FETCH_RESOLVED.replace("INTERVAL 256 SECOND", "INTERVAL 100 SECOND"),
        "fetch_rejects": (FETCH_LOG + " SELECT CAST(NULL AS VARCHAR) AS isin, 'attempts' AS \"table\", "
                          "'attempt_no_' || CASE WHEN status = 429 THEN 'null' ELSE '0' END || ' ' || url AS reason "
                          "FROM log WHERE status = 429 OR attempt_no = 1"),
        "listing_fetch_metrics": (
            "SELECT CAST(count(*) FILTER (WHERE outcome = 'return' AND error IS NULL) AS INTEGER) AS total, "
            "CAST(count(*) FILTER (WHERE outcome = 'return' AND error IS NULL) AS INTEGER) AS successful, "
            f"{kinds} FROM ({FETCH_RESOLVED})"),
        **dict.fromkeys(("discovery_run", "stream_discovery"), "SELECT isin, share_name FROM ("
                        f"{discovery_sql(C)['discovery_instruments']})"),
    }


def refresh_sql(C) -> dict[str, str]:
    cols = ["isin", "share_name"] + [c for t in schemas.SATELLITES for c in schemas.non_key_columns(t)]
    view_after = (f"SELECT {', '.join(cols)}, CASE WHEN isin IN ({_refreshed_sql(C)}) "
                  f"THEN {ts(C.RUN_AS_OF)} ELSE updated_at END AS updated_at FROM ({view_sql()})")
    due = (f"SELECT v.* FROM ({view_sql()}) v JOIN ({stale_sql(C.RUN_AS_OF, C.REFRESH_MIN_AGE)}) s "
           "ON v.isin = s.isin")
    n_ok = f"(SELECT count(*) FROM ({_refreshed_sql(C)}))"
    metrics = (
        "SELECT CAST(count(*) AS INTEGER) AS scrape_total, "
        f"CAST({n_ok} AS INTEGER) AS scrape_successful, "
        "CAST(count(*) FILTER (WHERE mercato_segmento = 'AUTOMOBILE') AS INTEGER) AS scrape_network_error, "
        "CAST(count(*) FILTER (WHERE (mercato_segmento IS NULL OR mercato_segmento <> 'AUTOMOBILE') "
        "AND id_strumento IS NULL) AS INTEGER) AS scrape_invalid_page, "
        "0 AS scrape_timeout, 0 AS scrape_max_retries, 0 AS scrape_parsing_error, "
        f"CAST({n_ok} AS INTEGER) AS insert_total, CAST({n_ok} AS INTEGER) AS insert_successful "
        f"FROM ({due})")
    return {"refresh_view": view_after, "refresh_metrics": metrics,
            "stream_refresh_view": stream_refresh_sql(C)}


def discovery_sql(C) -> dict[str, str]:
    # link rows of the stand-in listing pages, the last page of each
    # initial counted twice
    links = (f"SELECT {ISIN} AS isin, c_name, c_acctbal, c_nationkey, "
             "upper(substr(c_mktsegment, 1, 1)) AS letter, c_custkey // 50 + 1 AS page FROM customer")
    last = "SELECT letter, max(page) AS page FROM l GROUP BY letter"
    counted = (f"WITH l AS ({links}), last AS ({last}) "
               "SELECT l.*, CASE WHEN last.page IS NULL THEN 1 ELSE 2 END AS copies "
               "FROM l LEFT JOIN last ON l.letter = last.letter AND l.page = last.page")
    grid_counted = (f"WITH l AS ({links}), last AS ({last}), g AS ("
                    "SELECT l.*, CASE WHEN last.page IS NOT NULL AND l.page + 1 <= 9 THEN 2 ELSE 1 END "
                    "AS copies FROM l LEFT JOIN last ON l.letter = last.letter AND l.page = last.page) "
                    "SELECT * FROM g WHERE page <= 9")
    metrics = lambda src: (
        "SELECT CAST(coalesce(sum(copies), 0) AS INTEGER) AS total, "
        "CAST(coalesce(sum(copies) FILTER (WHERE c_acctbal >= 0 AND c_nationkey <> 0), 0) AS INTEGER) AS successful, "
        "0 AS network_error, "
        "CAST(coalesce(sum(copies) FILTER (WHERE c_nationkey = 0), 0) AS INTEGER) AS invalid_page, "
        "0 AS timeout, 0 AS max_retries, "
        "CAST(coalesce(sum(copies) FILTER (WHERE c_acctbal < 0 AND c_nationkey <> 0), 0) AS INTEGER) AS parsing_error "
        f"FROM ({src})")
    return {
        "discovery_grid_metrics": metrics(grid_counted),
        "discovery_instruments": (
            f"SELECT {ISIN} AS isin, c_name AS share_name, {ts(C.RUN_AS_OF)} AS updated_at FROM customer "
            "WHERE c_acctbal >= 0 AND c_nationkey <> 0"),
        "discovery_metrics": (
            "SELECT CAST(sum(copies) AS INTEGER) AS total, "
            "CAST(coalesce(sum(copies) FILTER (WHERE c_acctbal >= 0 AND c_nationkey <> 0), 0) AS INTEGER) AS successful, "
            "0 AS network_error, "
            "CAST(coalesce(sum(copies) FILTER (WHERE c_nationkey = 0), 0) AS INTEGER) AS invalid_page, "
            "0 AS timeout, 0 AS max_retries, "
            "CAST(coalesce(sum(copies) FILTER (WHERE c_acctbal < 0 AND c_nationkey <> 0), 0) AS INTEGER) AS parsing_error "
            f"FROM ({counted})"),
    }
