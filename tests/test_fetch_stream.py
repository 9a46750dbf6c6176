import datetime as dt

from equitylake.operators import fetchlog as FL
from equitylake.streaming.fetch_stream import resolved, start_resolver

T0 = dt.datetime(2024, 1, 1)
SCHEMA = ("url string, attempt_no int, status int, net_error boolean, body string, "
          "started_at timestamp_ntz, ended_at timestamp_ntz")


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_stream_matches_batch(spark, tmp_dir):
    first = [
        ("a", 1, 503, False, None, at(0), at(1)), ("a", 2, 200, False, "<p>", at(3), at(4)),
        ("b", 2, 200, False, "x", at(3), at(4)),            # attempt 1 still missing
        ("c", 1, 404, False, None, at(0), at(1)),
        ("d", 1, 200, False, "", at(0), at(1)),
        ("e", 1, 500, False, None, at(0), at(1)),           # never decided: pending
        ("t", 1, 503, False, None, at(0), at(1)), ("t", 2, 200, False, "x", at(300), at(301)),
    ] + [("f", i, 429, False, None, at(2 ** i), at(2 ** i + 1)) for i in range(1, 9)]
    second = [
        ("b", 1, 502, False, None, at(0), at(1)),           # completes b
        ("g", 1, 200, False, "y", at(5000), at(5001)),      # moves the watermark on
    ]
    # after the first decision: b's first attempt, and another of the decided d
    second.append(("d", 2, 404, False, None, at(2), at(3)))
    d = f"{tmp_dir}/log"
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
    for rows in (first, second):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(d)
        start_resolver(stream.parquet(d), f"{tmp_dir}/out", f"{tmp_dir}/ck", available_now=True).awaitTermination(120)
        if rows is first:
            assert {r.url: r.outcome for r in resolved(spark, f"{tmp_dir}/out").collect()}["e"] == "pending"
    got = resolved(spark, f"{tmp_dir}/out").collect()
    want = FL.resolve(spark.createDataFrame(first + second, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)  # one row per URL, as in batch
    by = {r.url: r for r in got}
    assert by["f"].outcome == "max_retries" and by["b"].decisive_attempt == 2 and by["t"].outcome == "timeout"
    assert by["d"].outcome == "return" and by["d"].attempts == 2
    assert resolved(spark, f"{tmp_dir}/none").count() == 0


def test_rejected_attempts_and_share_budget(spark):
    log = spark.createDataFrame([("u", n, 200, False, "x", at(0), at(200)) for n in (0, None, 9, 1)], SCHEMA)
    assert sorted(r.reason for r in FL.rejected(log).collect()) == [
        "attempt_no_0 u", "attempt_no_9 u", "attempt_no_null u"]
    assert FL.resolve(log).first().outcome == "return"
    assert FL.resolve(log, share_budget_s=150).first().outcome == "timeout"
