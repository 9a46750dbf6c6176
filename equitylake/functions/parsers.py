"""Locale-aware value parsers as Spark Column expressions.

All of them are built from built-in functions, so they run inside
whole-stage codegen on the JVM and also work unchanged on streaming
DataFrames. Bad input becomes NULL, never an error.

Semantics (the source site writes Italian-locale numbers and short dates):

* ``parse_float``: trim; drop leading ``+`` and trailing ``%``; trim; a
  leading ``-`` (repeated or not) makes the value negative; a number in
  ``1.234.567,89`` form has its dots dropped and comma turned into a
  decimal point, anything else just has its commas dropped; the rest must
  be a plain decimal/exponent literal or inf/infinity/nan.
* ``parse_int``: trim, drop every dot, optional ``+``, digits only,
  at most 2^64-1.
* ``parse_datetime``: ``d/m/yy H.M.S`` or ``d/m/yy - H.M.S``; two-digit
  years 00-69 are 20xx, 70-99 are 19xx; nothing may trail.
* ``parse_date``: ``d/m/yy``.
* ``price_date``: split once at ``" - "``: ``{price, date}``, NULL struct
  when the separator is missing.
* ``price_datetime``: split once at the first ``-``, both sides trimmed:
  ``{price, datetime}``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ISIN_STRUCT

# Unicode-aware trim (Spark's trim only strips ASCII blanks).
_WS = r"(?U)^\s+|\s+$"
# FIXED VALUE: thousands-separator form of an Italian number.
_IT_NUMBER = r"^(\d{1,3})(\.?\d{3})*(,\d+)?$"
# Literals a strict float parser accepts (try_cast alone also takes '1d', ' 5 ', hex).
_FLOAT_LITERAL = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"
# d/m/yy with optional blanks before each numeric field
_D = r"\s*([0-9]{1,2})"
_DATE_RE = rf"(?U)^{_D}/{_D}/{_D}\z"
_DATETIME_RE = rf"(?U)^{_D}/{_D}/{_D}\s*(-\s*)?{_D}\.{_D}\.{_D}\z"

U64_MAX = "18446744073709551615"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c) -> Column:
    """Trim Unicode white space (including NBSP) at both ends."""
    return F.regexp_replace(_c(c), _WS, "")


# the white space that the patterns above call \s (Unicode), for the trim functions
_BLANKS = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
           "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def parse_float(c) -> Column:
    blanks = F.lit(_BLANKS)
    # trim, leading '+' run, trim; trailing '%' run, trim
    s = F.ltrim(F.ltrim(F.ltrim(_c(c), blanks), F.lit("+")), blanks)
    s = F.rtrim(F.rtrim(F.rtrim(s, blanks), F.lit("%")), blanks)
    sign = F.when(s.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    body = F.ltrim(s, F.lit("-"))
    # a number of the Italian form is a plain decimal once its dots are gone
    other = F.translate(body, ",", "")
    norm = F.when(body.rlike(_IT_NUMBER), F.translate(body, ",.", ".")).otherwise(
        F.when(other.rlike(_FLOAT_LITERAL), other))
    return norm.try_cast("double") * sign


def parse_uint(c) -> Column:
    """Unsigned integer as DECIMAL(20,0) (the full u64 range)."""
    s = F.replace(utrim(c), F.lit("."), F.lit(""))
    digits = F.regexp_replace(s, r"^\+", "")
    dec = digits.try_cast("decimal(20,0)")
    return F.when(s.rlike(r"^\+?[0-9]+$") & (dec <= F.lit(U64_MAX).cast("decimal(20,0)")), dec)


def parse_int(c) -> Column:
    """Unsigned integer stored as INT: values above 2^31-1 become NULL
    (flag them with ``int_overflow``) instead of wrapping."""
    return parse_uint(c).try_cast("int")


def int_overflow(c) -> Column:
    u = parse_uint(c)
    return u.isNotNull() & u.try_cast("int").isNull()


def _year(yy: Column) -> Column:
    y = yy.cast("int")
    return F.when(y < 70, y + 2000).otherwise(y + 1900)


def parse_date(c) -> Column:
    s = _c(c)
    ok = s.rlike(_DATE_RE)
    g = [F.regexp_extract(s, _DATE_RE, i) for i in (1, 2, 3)]
    ts = F.try_make_timestamp_ntz(_year(g[2]), g[1].cast("int"), g[0].cast("int"),
                                  F.lit(0), F.lit(0), F.lit(0))
    return F.when(ok, ts.cast("date"))


def parse_datetime(c) -> Column:
    s = _c(c)
    ok = s.rlike(_DATETIME_RE)
    g = {i: F.regexp_extract(s, _DATETIME_RE, i) for i in (1, 2, 3, 5, 6, 7)}
    ts = F.try_make_timestamp_ntz(_year(g[3]), g[2].cast("int"), g[1].cast("int"),
                                  g[5].cast("int"), g[6].cast("int"), g[7].cast("int"))
    return F.when(ok, ts)


def _split_once(s: Column, sep: str):
    pos = F.instr(s, sep)
    left = F.when(pos > 0, F.substring(s, F.lit(1), pos - 1))
    right = F.when(pos > 0, F.substring(s, pos + len(sep), F.lit(1 << 30)))
    return pos, left, right


def text_or_na(c) -> Column:
    """Text with the "N/A" default used by the split parsers."""
    return F.coalesce(_c(c), F.lit("N/A"))


def price_date_fields(c) -> tuple[Column, Column]:
    """(price, date) of ``price_date`` as two columns (both NULL when the
    separator is missing), without building the struct."""
    _, left, right = _split_once(text_or_na(c), " - ")
    return parse_float(left), parse_date(right)


def price_datetime_fields(c) -> tuple[Column, Column]:
    _, left, right = _split_once(text_or_na(c), "-")
    return parse_float(utrim(left)), parse_datetime(utrim(right))


def price_date(c) -> Column:
    s = text_or_na(c)
    price, date = price_date_fields(s)
    return F.when(F.instr(s, " - ") > 0, F.struct(price.alias("price"), date.alias("date")))


def price_datetime(c) -> Column:
    s = text_or_na(c)
    price, dtm = price_datetime_fields(s)
    return F.when(F.instr(s, "-") > 0, F.struct(price.alias("price"), dtm.alias("datetime")))


FIELD_PARSERS = {"price_date": price_date_fields, "price_datetime": price_datetime_fields}

PARSERS = {
    "float": parse_float,
    "text": lambda c: _c(c),
    "datetime": parse_datetime,
    "int": parse_int,
    "price_date": price_date,
    "price_datetime": price_datetime,
}


# ---- identifiers ---------------------------------------------------------

def _isin_country(s: Column) -> Column:
    # bytes [0, 2): two 1-byte characters or one 2-byte character
    two, one = F.substring(s, 1, 2), F.substring(s, 1, 1)
    return (F.when(F.octet_length(two) == 2, two)
            .when(F.octet_length(one) == 2, one))


def isin_error(c) -> Column:
    """NULL when valid, else 'invalid_length' / 'invalid_check_digit' /
    'invalid_boundary' (byte slices would cut a multi-byte character)."""
    s = _c(c)
    return (F.when(s.isNull() | (F.octet_length(s) != 12), F.lit("invalid_length"))
            .when(~F.substring(s, -1, 1).rlike("^[0-9]$"), F.lit("invalid_check_digit"))
            .when(_isin_country(s).isNull(), F.lit("invalid_boundary")))


def parse_isin(c) -> Column:
    """12 bytes: country (bytes 0-1), national number (2-10), check digit
    (byte 11, a digit).

    Only the length and the digit-ness of the last byte are checked (no
    check-digit sum, no case or charset test). Text whose byte boundaries
    fall inside a multi-byte character is NULL.
    """
    s = _c(c)
    country = _isin_country(s)
    n = F.char_length(country)
    return F.when(isin_error(s).isNull(),
                  F.struct(country.alias("country"),
                           F.substring(s, n + 1, F.char_length(s) - n - 1).alias("nna"),
                           F.substring(s, -1, 1).cast("tinyint").alias("check"))
                  ).cast(ISIN_STRUCT)


def format_isin(c) -> Column:
    s = _c(c)
    return F.concat(s["country"], s["nna"], s["check"].cast("string"))


def isin_from_href(c) -> Column:
    """Last '/' segment of a link, up to its first '.'."""
    return F.substring_index(F.substring_index(_c(c), "/", -1), ".", 1)


# ---- LIKE patterns ------------------------------------------------------

_LIKE_ESC = r"(?s)(\\[%_\\])|\\(.)"


def like_pattern(text: str, before: str = "", after: str = "") -> str:
    """The LIKE pattern ``before`` + user text + ``after``: '%' and '_' stay
    wildcards (as in the store); a backslash escapes '%', '_' or '\\', also
    across the seam (a trailing backslash makes the '%' of ``after`` a literal
    percent sign, as in the store); before any other character it is dropped
    and the character kept (Spark would reject such an escape)."""
    import re
    pattern = re.sub(_LIKE_ESC, lambda m: m.group(1) or m.group(2), before + text + after)
    # what is left of an unpaired backslash at the very end escapes nothing
    tail = len(pattern) - len(pattern.rstrip("\\"))
    return pattern[:-1] if tail % 2 else pattern


# ---- output helpers -----------------------------------------------------

def nan_to_null(c) -> Column:
    """JSON writers emit "NaN"/"Infinity" strings; the store's JSON gives null."""
    x = _c(c)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


# ---- default parses ------------------------------------------------------
# The "default" flavour of every parser: a value that does not parse gives
# the type's default instead of NULL (0, "N/A", 1970-01-01 00:00:00, or a
# pair whose fields are NULL).

def parse_or_default(kind: str, c) -> Column:
    import datetime as dt
    v = PARSERS[kind](_c(c))
    if kind == "float":
        return F.coalesce(v, F.lit(0.0))
    if kind == "int":
        return F.coalesce(v, F.lit(0))
    if kind == "text":
        return text_or_na(c)
    if kind == "datetime":
        return F.coalesce(v, ntz_lit(dt.datetime(1970, 1, 1)))
    second = "date" if kind == "price_date" else "datetime"
    typ = "date" if kind == "price_date" else "timestamp_ntz"
    return F.coalesce(v, F.struct(F.lit(None).cast("double").alias("price"),
                                  F.lit(None).cast(typ).alias(second)))


def iso_ntz(c) -> Column:
    """ISO-8601 text of a zone-less timestamp with the fraction only when
    non-zero, in 3 or 6 digits (2024-11-29T16:07:46, ...46.120, ...46.123456)."""
    ts = _c(c)
    frac = F.date_format(ts, "SSSSSS")
    tail = (F.when(frac == "000000", F.lit(""))
            .when(frac.endswith("000"), F.concat(F.lit("."), F.substring(frac, 1, 3)))
            .otherwise(F.concat(F.lit("."), frac)))
    return F.when(ts.isNotNull(), F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), tail))


def ntz_lit(x) -> Column:
    """A zone-less timestamp literal from a naive ``datetime``, built from
    its ISO text so no time zone (driver's or session's) is applied."""
    return F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")
