"""Property-based round trips: values rendered the way the site writes
them parse back to themselves. Each example is a whole list evaluated in
one Spark job."""
import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from equitylake.functions import parsers as P

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


def italian(x: float) -> str:
    whole, frac = f"{abs(x):,.2f}".split(".")
    return ("-" if x < 0 else "") + whole.replace(",", ".") + "," + frac


@SETTINGS
@given(st.lists(st.integers(min_value=-10**12, max_value=10**12), min_size=1, max_size=200))
def test_number_round_trip(spark, cents):
    vals = [c / 100 for c in cents]
    df = spark.createDataFrame([(i, italian(v), f"+{italian(v)} %") for i, v in enumerate(vals)],
                               "i int, a string, b string")
    got = df.select("i", P.parse_float(F.col("a")).alias("a"), P.parse_float(F.col("b")).alias("b")) \
        .orderBy("i").collect()
    for v, r in zip(vals, got):
        assert r.a == float(f"{v:.2f}") and r.b == r.a


@SETTINGS
@given(st.lists(st.datetimes(min_value=dt.datetime(1970, 1, 1), max_value=dt.datetime(2069, 12, 31)),
                min_size=1, max_size=200))
def test_datetime_round_trip(spark, stamps):
    stamps = [s.replace(microsecond=0) for s in stamps]
    rows = [(i, s.strftime("%d/%m/%y %H.%M.%S"), f"{s.day}/{s.month}/{s:%y} - {s.hour}.{s.minute}.{s.second}",
             s.strftime("%d/%m/%y")) for i, s in enumerate(stamps)]
    df = spark.createDataFrame(rows, "i int, a string, b string, d string")
    got = df.select("i", P.parse_datetime(F.col("a")).alias("a"), P.parse_datetime(F.col("b")).alias("b"),
                    P.parse_date(F.col("d")).alias("d")).orderBy("i").collect()
    for s, r in zip(stamps, got):
        assert r.a == s and r.b == s and r.d == s.date()


@SETTINGS
@given(st.lists(st.integers(min_value=0, max_value=2**31 - 1), min_size=1, max_size=200))
def test_int_round_trip(spark, ints):
    df = spark.createDataFrame([(i, f"{v:,}".replace(",", ".")) for i, v in enumerate(ints)],
                               "i int, s string")
    got = df.select("i", P.parse_int(F.col("s")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == ints
