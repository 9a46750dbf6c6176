import datetime as dt
import itertools
import random

from equitylake.operators import fetchlog as FL
from equitylake.streaming import fetch_timers as T

T0 = dt.datetime(2024, 1, 1)
SCHEMA = ("url string, attempt_no int, status int, net_error boolean, body string, "
          "started_at timestamp_ntz, ended_at timestamp_ntz")
S = 1_000_000


def at(s):
    return T0 + dt.timedelta(seconds=s)


def attempt(n, kind, started, ended, status=None, empty=False):
    return (n, kind, started * S, ended * S, status, empty, False)


def test_judge():
    budget = 256 * S
    retry = [attempt(n, "retry", 10 * n, 10 * n + 1, 503) for n in range(1, 9)]
    done = attempt(3, "return", 30, 31, 200)
    assert T.judge([retry[0]], budget, False) is None
    assert T.judge([retry[0], done], budget, False) is None  # attempt 2 may still decide
    assert T.judge([retry[0], done], budget, True)["decisive_attempt"] == 3
    got = T.judge([retry[0], retry[1], done], budget, False)
    assert got == {"attempts": 3, "outcome": "return", "error": None, "decisive_attempt": 3, "status": 200, "elapsed_ms": 21000}
    assert T.judge(retry, budget, False)["outcome"] == "max_retries"
    for fetch, final in (([retry[0]], True), ([retry[0], attempt(2, "exit", 20, 900, 404)], False),
                         ([retry[0], attempt(2, "retry", 20, 900, 503)], True)):
        got = T.judge(fetch, budget, final)
        assert (got["outcome"], got["elapsed_ms"], got["attempts"]) == ("timeout", 256000, 1)
    assert T.judge([attempt(1, "return", 0, 1, 200, True)], budget, False)["error"] == "invalid_page"
    assert T.judge([attempt(1, "exit", 0, 1)], budget, False)["error"] == "network_error"
    # two fetches of a URL, an attempt before the first
    found, lost = T.fetches([attempt(2, "retry", 1, 2), attempt(1, "retry", 5, 6), attempt(1, "return", 400, 401), done])
    assert [len(f) for f in found] == [2, 1] and len(lost) == 1


def replay(spark, tmp_dir, files, name, **budgets):
    d = f"{tmp_dir}/{name}"
    for rows in files:  # a file source takes older files first
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{d}/log")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{d}/log")
    q = T.start_timed_resolver(stream, f"{d}/out", f"{d}/ck", available_now=True, **budgets)
    assert q.awaitTermination(240) and q.exception() is None
    return q, T.outcomes(spark, f"{d}/out").collect()


def test_timers_end_silent_fetches_and_any_order_gives_the_same(spark, tmp_dir):
    log = [("a", 1, 503, False, None, at(0), at(1)), ("a", 2, 200, False, "<p>", at(3), at(4)),
           ("b", 1, 500, False, None, at(0), at(1)),                       # goes silent
           ("c", 1, 404, False, None, at(0), at(1)), ("c", 2, 200, False, "late", at(9), at(10)),
           ("d", 2, 200, False, "x", at(5), at(6)),                        # no first attempt: no fetch
           ("e", 1, 503, False, None, at(0), at(2)), ("e", 2, 200, False, "x", at(3), at(290)),  # past the budget
           ("g", 1, 503, False, None, at(0), at(2)), ("g", 3, 200, False, "x", at(8), at(9)),    # one attempt lost
           ("a", 1, 200, False, "", at(700), at(701)),                     # another fetch of a
           (None, 1, 200, False, "", at(0), at(1)), ("r", 9, 200, False, "", at(0), at(1))]
    log += [("f", i, 429, False, None, at(i), at(i + 1)) for i in range(1, 9)]
    end = [("end", 1, 500, False, None, at(5000), at(5001))]  # moves the watermark on; still pending itself
    expected = {("a", at(0)): "return", ("a", at(700)): "return", ("b", at(0)): "timeout", ("c", at(0)): "exit",
                ("e", at(0)): "timeout", ("g", at(0)): "return", ("f", at(1)): "max_retries", (None, at(0)): "return"}
    seen = []
    for k in range(2):
        rng = random.Random(k)
        rng.shuffle(log)
        files = [log[i::3] for i in range(3)] + [end] if k else [log, end]
        _, got = replay(spark, tmp_dir, files, f"r{k}", lateness="30 minutes")
        assert {(r.url, r.started_at): r.outcome for r in got} == expected and len(got) == len(expected)
        seen.append(sorted(map(tuple, got), key=str))
    assert seen[0] == seen[1]
    b = next(r for r in got if r.url == "b")
    assert (b.attempts, b.error, b.decisive_attempt, b.elapsed_ms) == (1, "timeout", None, 256000)
    # decided fetches are what the batch operator says
    rows = [r for r in log if r[0] in ("c", "f") or (r[0] == "a" and r[5] < at(100))]
    batch = {r.url: r for r in FL.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    for r in got:
        if r.url in batch and r.started_at < at(100):
            assert (r.outcome, r.error, r.decisive_attempt, r.status, r.elapsed_ms) == (
                batch[r.url].outcome, batch[r.url].error, batch[r.url].decisive_attempt, batch[r.url].status,
                batch[r.url].elapsed_ms)


def test_state_is_flat_and_the_share_budget_counts(spark, tmp_dir):
    """New URLs in every micro-batch, decided and silent ones: the state holds those
    of the last budget only."""
    files = [[(f"u{k}-{i}", 1, 200 if i % 2 else 503, False, "x", at(100 * k), at(100 * k + 1)) for i in range(20)]
             for k in range(14)]
    q, got = replay(spark, tmp_dir, files, "flat", lateness="10 seconds", share_budget_s=150)
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert len(rows) >= 14 and max(rows[7:]) <= max(rows[:7])
    silent = [r for r in got if r.outcome == "timeout"]
    assert {r.elapsed_ms for r in silent} == {150000}
    # the watermark has passed the budget of all but the last URLs
    assert len(silent) == 10 * sum(100 * k + 150 < 1301 - 10 for k in range(14))
    assert sum(r.outcome == "return" for r in got) == 140


def test_attempts_in_all_orders():
    """judge() says the same of every order of arrival, as soon as it says anything."""
    kinds = [("retry", 503), ("return", 200), ("exit", 404)]
    for combo in itertools.product(kinds, repeat=3):
        log = [attempt(n + 1, kind, 10 * n, 10 * n + 5, status) for n, (kind, status) in enumerate(combo)]
        final = T.judge(log, 256 * S, True)
        for order in itertools.permutations(log):
            for k in range(1, 4):
                found, _ = T.fetches(list(order[:k]))
                for fetch in found:
                    said = T.judge(fetch, 256 * S, False)
                    assert said is None or said == final


def test_state_calls_depend_on_keys_not_on_urls(spark, tmp_dir):
    """Many URLs share few keys: one state value and one timer a key, and the same
    outcomes."""
    first = [(f"u{i}", 1, 200 if i % 3 == 0 else 503, False, "x", at(i / 10), at(i / 10 + 1)) for i in range(300)]
    later = [(f"u{i}", 2, 404, False, None, at(i / 10 + 3), at(i / 10 + 4)) for i in range(0, 300, 5)]
    end = [("end", 1, 500, False, None, at(5000), at(5001))]
    q, got = replay(spark, tmp_dir, [first, later, end], "keys", lateness="10 minutes", buckets=4)
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(rows) <= 4 * 4
    expected = {f"u{i}": "return" if i % 3 == 0 else "exit" if i % 5 == 0 else "timeout" for i in range(300)}
    assert {r.url: r.outcome for r in got} == expected and len(got) == 300


def test_the_silent_log_is_replayed_from_several_files_a_batch(spark, monkeypatch):
    from conftest import SF001

    from equitylake.plans import catalog
    started = []

    def start(*args, **how):
        started.append(start_timed(*args, **how))
        return started[-1]
    start_timed = T.start_timed_resolver
    monkeypatch.setattr(T, "start_timed_resolver", start)
    one = sorted(map(tuple, catalog.fetch_timeout_stream(spark, SF001).collect()), key=str)
    monkeypatch.setattr(catalog, "LOG_FILE_ROWS", 20)
    several = sorted(map(tuple, catalog.fetch_timeout_stream(spark, SF001).collect()), key=str)
    assert one == several and len(one) > 0
    for q in started:  # a micro-batch a part of the log
        assert sum(p["numInputRows"] > 0 for p in q.recentProgress) == 8
