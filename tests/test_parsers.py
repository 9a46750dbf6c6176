import datetime as dt
import math

from pyspark.sql import functions as F

from equitylake.functions import parsers as P


def run(spark, fn, values, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    rows = df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()
    return [r.o for r in rows]


FLOAT_GOLDEN = [
    ("1.234,56", 1234.56), ("+1,25%", 1.25), ("-0,5 %", -0.5), ("1.234", 1234.0),
    ("0.123", 123.0), ("12.34", 12.34), ("1234567", 1234567.0), ("1,234.56", 1234.56),
    ("1,234", 1.234), ("1.2345", 1.2345), ("12345.678", 12345678.0), ("1,2,3", 123.0),
    ("1.234.5", None), ("", None), ("-", None), ("N/A", None), ("- 5", None),
    ("--5", -5.0), ("+-5", -5.0), ("-+5", -5.0), ("1e3", 1000.0),
    (" 5 ", 5.0), ("5.", 5.0), (".5", 0.5), ("5%%", 5.0), ("1d", None), ("0x1p3", None),
    ("% 5", None), (" 12,5 ", 12.5), (None, None), ("1.000.000,5", 1000000.5),
]


def test_parse_float_golden(spark):
    got = run(spark, P.parse_float, [v for v, _ in FLOAT_GOLDEN])
    for (inp, want), g in zip(FLOAT_GOLDEN, got):
        assert g == want, (inp, g, want)


def test_parse_float_specials(spark):
    got = run(spark, P.parse_float, ["inf", "-Infinity", "nan", "NaN%"])
    assert got[0] == math.inf and got[1] == -math.inf
    assert math.isnan(got[2]) and math.isnan(got[3])


def test_parse_int(spark):
    vals = ["1.234", " 42 ", "+7", "-7", "", "1,5", "18.446.744.073.709.551.615",
            "18446744073709551616", "2147483647", "2147483648", None]
    got = run(spark, P.parse_int, vals)
    assert got == [1234, 42, 7, None, None, None, None, None, 2147483647, None, None]
    ovf = run(spark, P.int_overflow, vals)
    assert ovf[6] is True and ovf[9] is True and ovf[0] is False


def test_parse_datetime(spark):
    vals = ["29/11/24 16.07.46", "29/11/24 - 16.07.46", "1/2/70 1.2.3", "29/11/24 16.07.46 ",
            "31/02/24 10.00.00", "29/11/2024 16.07.46", " 29/11/24 16.07.46", "29-11-24 16.07.46"]
    got = run(spark, P.parse_datetime, vals)
    assert got[0] == dt.datetime(2024, 11, 29, 16, 7, 46)
    assert got[1] == dt.datetime(2024, 11, 29, 16, 7, 46)
    assert got[2] == dt.datetime(1970, 2, 1, 1, 2, 3)
    assert got[3] is None and got[4] is None and got[5] is None and got[7] is None
    assert got[6] == dt.datetime(2024, 11, 29, 16, 7, 46)


def test_parse_date_pivot(spark):
    got = run(spark, P.parse_date, ["29/11/24", "1/1/69", "1/1/70", "31/12/99", "29/11/24 x", "30/2/20"])
    assert got == [dt.date(2024, 11, 29), dt.date(2069, 1, 1), dt.date(1970, 1, 1),
                   dt.date(1999, 12, 31), None, None]


def test_price_date(spark):
    vals = ["12,5 - 29/11/24", "12,5", "12,5-29/11/24", " - 29/11/24", "12,5 - 29/11/24 - x", None]
    got = run(spark, P.price_date, vals)
    assert (got[0].price, got[0].date) == (12.5, dt.date(2024, 11, 29))
    assert got[1] is None and got[2] is None and got[5] is None
    assert (got[3].price, got[3].date) == (None, dt.date(2024, 11, 29))
    assert (got[4].price, got[4].date) == (12.5, None)


def test_price_datetime(spark):
    vals = ["1,2 - 29/11/24 16.07.46", "1,2 - 29/11/24 - 16.07.46", "-1,2 - 29/11/24 16.07.46", "1,2"]
    got = run(spark, P.price_datetime, vals)
    want = dt.datetime(2024, 11, 29, 16, 7, 46)
    assert (got[0].price, got[0].datetime) == (1.2, want)
    assert (got[1].price, got[1].datetime) == (1.2, want)
    assert (got[2].price, got[2].datetime) == (None, None)
    assert got[3] is None


def test_isin(spark):
    vals = ["IT0001233417", "IT000123341", "IT00012334178", "IT000123341X", "é0001233417X",
            "é000123341é7", "éA00012334X7"]
    got = run(spark, P.parse_isin, vals)
    assert (got[0].country, got[0].nna, got[0].check) == ("IT", "000123341", 7)
    assert got[1] is None and got[2] is None and got[3] is None
    errs = run(spark, P.isin_error, vals)
    assert errs[:4] == [None, "invalid_length", "invalid_length", "invalid_check_digit"]


def test_isin_multibyte_country(spark):
    # 'é' is two bytes: bytes [0,2) are one character
    got = run(spark, P.parse_isin, ["é0001233417", "Aé001233417"])
    assert got[0] is not None and got[0].country == "é" and got[0].nna == "000123341"
    assert got[1] is None  # byte 2 falls inside 'é'


def test_isin_from_href(spark):
    got = run(spark, P.isin_from_href, ["/borsa/azioni/scheda/IT0001233417.html?lang=it", "abc", "/x/"])
    assert got == ["IT0001233417", "abc", ""]


def test_like_literal():
    assert P.like_pattern(r"a\bc") == "abc"
    assert P.like_pattern(r"50\%") == r"50\%"
    assert P.like_pattern("a\\\\b") == "a\\\\b"
    assert P.like_pattern("end\\") == "end"
    assert P.like_pattern("IT\\", after="%") == "IT\\%"
    assert P.like_pattern("x_y%") == "x_y%"


def test_default_parses(spark):
    got = run(spark, lambda c: P.parse_or_default("float", c), ["x", "1,5"])
    assert got == [0.0, 1.5]
    assert run(spark, lambda c: P.parse_or_default("text", c), [None, "a"]) == ["N/A", "a"]
    assert run(spark, lambda c: P.parse_or_default("int", c), ["-1"]) == [0]
    pd_ = run(spark, lambda c: P.parse_or_default("price_date", c), ["12,5"])[0]
    assert pd_.price is None and pd_.date is None
    assert run(spark, lambda c: P.parse_or_default("datetime", c), ["?"]) == [dt.datetime(1970, 1, 1)]
