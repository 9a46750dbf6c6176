"""Table schemas of the store and the page-property catalogue.

Five tables keyed by ``isin``: the hub ``share_isins`` and four satellites
(0..1 row per hub row). Column names, types and lengths follow the
store's effective DDL; one spelling (``data_ora_prezzo_rifermento``) is
kept as it is in the store.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, TS, DT, B = (T.StringType(), T.DoubleType(), T.IntegerType(),
                      T.TimestampNTZType(), T.DateType(), T.ByteType())


def _f(name, typ, nullable=True):
    return T.StructField(name, typ, nullable)


HUB = T.StructType([
    _f("isin", S, False), _f("share_name", S, False), _f("updated_at", TS, False),
])

DETAILS = T.StructType([
    _f("isin", S, False), _f("id_strumento", D), _f("codice_alfanumerico", S),
    _f("updated_at", TS, False),
])

MARKET = T.StructType([
    _f("isin", S, False), _f("super_sector", S), _f("mercato_segmento", S),
    _f("capitalizzazione_di_mercato", D), _f("lotto_minimo", D),
    _f("updated_at", TS, False),
])

PRICE = T.StructType([
    _f("isin", S, False), _f("fase_di_mercato", S),
    _f("prezzo_ultimo_contratto", D), _f("var_percentuale", D),
    _f("var_assoluta", D), _f("pr_medio_progr", D),
    _f("data_ora_ultimo_contratto", TS), _f("quantita_ultimo", D),
    _f("quantita_totale", D), _f("numero_contratti", I), _f("controvalore", D),
    _f("max_oggi", D), _f("max_anno", D), _f("max_anno_date", DT),
    _f("min_oggi", D), _f("min_anno", D), _f("min_anno_date", DT),
    _f("chiusura_precedente", D), _f("prezzo_riferimento", D),
    _f("data_ora_prezzo_rifermento", TS), _f("prezzo_ufficiale", D),
    _f("data_prezzo_ufficiale", DT), _f("apertura_odierna", D),
    _f("updated_at", TS, False),
])

PERFORMANCE = T.StructType([
    _f("isin", S, False), _f("performance_1_mese", D),
    _f("performance_6_mesi", D), _f("performance_1_anno", D),
    _f("updated_at", TS, False),
])

SATELLITES = {
    "share_details": DETAILS,
    "market_information": MARKET,
    "price_data": PRICE,
    "performance_metrics": PERFORMANCE,
}
TABLES = {"share_isins": HUB, **SATELLITES}

# VARCHAR(n) limits of the store; a longer value rejects the row.
VARCHAR_LIMITS = {
    "share_isins": {"isin": 12, "share_name": 50},
    "share_details": {"isin": 12, "codice_alfanumerico": 50},
    "market_information": {"isin": 12, "super_sector": 50, "mercato_segmento": 50},
    "price_data": {"isin": 12, "fase_di_mercato": 50},
    "performance_metrics": {"isin": 12},
}

ISIN_STRUCT = T.StructType([_f("country", S), _f("nna", S), _f("check", B)])
PRICE_DATE = T.StructType([_f("price", D), _f("date", DT)])
PRICE_DATETIME = T.StructType([_f("price", D), _f("datetime", TS)])

# Nested price fields <-> flat store columns.
PRICE_STRUCTS = {
    "max_anno": ("max_anno", "max_anno_date", "date"),
    "min_anno": ("min_anno", "min_anno_date", "date"),
    "prezzo_riferimento": ("prezzo_riferimento", "data_ora_prezzo_rifermento", "datetime"),
    "prezzo_ufficiale": ("prezzo_ufficiale", "data_prezzo_ufficiale", "date"),
}

# ---------------------------------------------------------------------------
# FIXED VALUES that must equal the source site's page layout: each record
# property, the lower-case substring that identifies its row label on a
# detail page, the satellite table it belongs to and its value parser.
# Listed in the site's natural property order.
# ---------------------------------------------------------------------------
PROPERTIES = [
    ("id_strumento", "id strumento", "share_details", "float"),
    ("codice_alfanumerico", "codice alfanumerico", "share_details", "text"),
    ("super_sector", "super sector", "market_information", "text"),
    ("mercato_segmento", "mercato/segmento", "market_information", "text"),
    ("capitalizzazione_di_mercato", "capitalizzazione di mercato", "market_information", "float"),
    ("lotto_minimo", "lotto minimo", "market_information", "float"),
    ("fase_di_mercato", "fase di mercato", "price_data", "text"),
    ("prezzo_ultimo_contratto", "prezzo ultimo contratto", "price_data", "float"),
    ("var_percentuale", "var %", "price_data", "float"),
    ("var_assoluta", "var assoluta", "price_data", "float"),
    ("pr_medio_progr", "pr medio progr", "price_data", "float"),
    ("data_ora_ultimo_contratto", "data - ora ultimo contratto:", "price_data", "datetime"),
    ("quantita_ultimo", "quantità ultimo", "price_data", "float"),
    ("quantita_totale", "quantità totale", "price_data", "float"),
    ("numero_contratti", "numero contratti", "price_data", "int"),
    ("controvalore", "controvalore", "price_data", "float"),
    ("max_oggi", "max oggi", "price_data", "float"),
    ("max_anno", "max anno", "price_data", "price_date"),
    ("min_oggi", "min oggi", "price_data", "float"),
    ("min_anno", "min anno", "price_data", "price_date"),
    ("chiusura_precedente", "chiusura precedente/pre-chiusura/chiusura:", "price_data", "float"),
    ("prezzo_riferimento", "prezzo di riferimento", "price_data", "price_datetime"),
    ("prezzo_ufficiale", "prezzo ufficiale", "price_data", "price_date"),
    ("apertura_odierna", "apertura odierna:", "price_data", "float"),
    ("performance_1_mese", "performance 1 mese", "performance_metrics", "float"),
    ("performance_6_mesi", "performance 6 mesi", "performance_metrics", "float"),
    ("performance_1_anno", "performance 1 anno", "performance_metrics", "float"),
]
PROPERTY_NAMES = [p[0] for p in PROPERTIES]

# Error kinds of a scrape, in the order the run metrics list them.
ERROR_KINDS = ["network_error", "invalid_page", "timeout", "max_retries", "parsing_error"]

METRICS = T.StructType([
    _f("total", I, False), _f("successful", I, False),
    *[_f(k, I, False) for k in ERROR_KINDS],
])

# Scanned detail pages: one row per page with the raw strings of its properties.
PAGE_PROPERTIES = T.StructType([
    _f("page_id", T.LongType()), _f("url", S), _f("fetched_at", TS), _f("empty_page", T.BooleanType()),
    *[_f(name, S) for name in PROPERTY_NAMES],
])
# The labelled table rows of detail pages, one row each.
DETAIL_ROWS = T.StructType([
    _f("page_id", T.LongType()), _f("url", S), _f("table_ord", I), _f("row_ord", I), _f("label", S), _f("value", S),
])
# Raw listing links produced by the page scanner: one marker row per page
# (link_ord -1, ``empty_page`` set) plus one row per matching link.
PAGE_LINKS = T.StructType([
    _f("page_id", T.LongType(), False), _f("link_ord", I, False),
    _f("href", S), _f("name", S), _f("empty_page", T.BooleanType()),
])


def non_key_columns(table: str) -> list[str]:
    return [f.name for f in TABLES[table].fields if f.name not in ("isin", "updated_at")]
