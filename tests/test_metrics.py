import datetime as dt

from equitylake.operators import metrics as MT


def test_empty_input_gives_zero_row(spark):
    df = spark.createDataFrame([], "counted boolean, ok boolean, error string")
    rows = MT.scrape_metrics(df).collect()
    assert len(rows) == 1 and all(v == 0 for v in rows[0].asDict().values())


def test_add_metrics(spark):
    a = MT.scrape_metrics(spark.createDataFrame(
        [(True, True, None), (True, False, "parsing_error")], "counted boolean, ok boolean, error string"))
    b = MT.scrape_metrics(spark.createDataFrame(
        [(False, False, "invalid_page")], "counted boolean, ok boolean, error string"))
    s = MT.add_metrics(a, b).collect()[0].asDict()
    assert s["total"] == 2 and s["successful"] == 1 and s["parsing_error"] == 1 and s["invalid_page"] == 1


def test_run_record(spark):
    sm = MT.scrape_metrics(spark.createDataFrame([], "counted boolean, ok boolean, error string"))
    im = MT.insertion_metrics(spark.createDataFrame([(True,), (False,)], "inserted boolean"))
    t0 = dt.datetime(2024, 1, 1)
    r = MT.run_record(spark, "job", sm, im, t0, t0 + dt.timedelta(seconds=1.5)).collect()[0]
    assert r.duration_millis == 1500 and r.insert.total == 2 and r.insert.successful == 1
    assert r.scrape.total == 0 and r.start_time == t0
