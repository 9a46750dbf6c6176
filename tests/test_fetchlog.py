import datetime as dt

from equitylake.operators import fetchlog as FL

T0 = dt.datetime(2024, 1, 1)


def log(spark, url, attempts):
    """attempts: (status, net_error, body, start_s, end_s)"""
    rows = [(url, i + 1, st, ne, b, T0 + dt.timedelta(seconds=s), T0 + dt.timedelta(seconds=e))
            for i, (st, ne, b, s, e) in enumerate(attempts)]
    return spark.createDataFrame(rows, "url string, attempt_no int, status int, net_error boolean, "
                                       "body string, started_at timestamp_ntz, ended_at timestamp_ntz")


def resolve(spark, attempts):
    return FL.resolve(log(spark, "u", attempts)).collect()[0]


def test_return_after_retries(spark):
    r = resolve(spark, [(503, False, None, 0, 1), (200, False, "<html>", 3, 4)])
    assert (r.outcome, r.error, r.decisive_attempt, r.elapsed_ms) == ("return", None, 2, 4000)


def test_empty_body_is_invalid_page(spark):
    r = resolve(spark, [(200, False, "", 0, 1)])
    assert (r.outcome, r.error) == ("return", "invalid_page")


def test_exit_on_other_status_or_transport_error(spark):
    assert resolve(spark, [(404, False, None, 0, 1)]).error == "network_error"
    assert resolve(spark, [(None, True, None, 0, 1), (200, False, "x", 3, 4)]).error == "network_error"


def test_max_retries(spark):
    r = resolve(spark, [(500, False, None, i, i + 0.5) for i in range(8)])
    assert (r.outcome, r.error) == ("max_retries", "max_retries")


def test_pending_and_timeout(spark):
    assert resolve(spark, [(429, False, None, 0, 1)]).outcome == "pending"
    r = resolve(spark, [(429, False, None, 0, 1), (200, False, "x", 250, 257)])
    assert (r.outcome, r.error) == ("timeout", "timeout")
    # the budget is inclusive: ending exactly at 256 s is in time
    assert resolve(spark, [(429, False, None, 0, 1), (200, False, "x", 250, 256)]).outcome == "return"


def test_metrics_and_pages(spark):
    lg = log(spark, "a", [(503, False, None, 0, 1), (200, False, "<p>", 3, 4)]).unionByName(
        log(spark, "b", [(404, False, None, 0, 1)])).unionByName(
        log(spark, "c", [(502, False, None, 0, 1)]))
    res = FL.resolve(lg)
    m = FL.fetch_metrics(res).collect()[0].asDict()
    assert m == {"total": 2, "successful": 1, "network_error": 1, "invalid_page": 0,
                 "timeout": 0, "max_retries": 0, "parsing_error": 0}
    pages = FL.fetched_pages(lg, res).collect()
    assert [(p.url, p.html) for p in pages] == [("a", "<p>")]
