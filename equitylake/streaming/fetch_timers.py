"""Streaming fetch-log resolution with timers: final outcomes only.

``fetch_stream`` keeps every URL for ever and corrects its outcome with each
attempt. Here an outcome is written once, when it is final, and what a fetch
needs is forgotten when its budget is over:

* A fetch of a URL begins with attempt 1. It is decided as soon as all attempts
  up to its first returning or exiting one have arrived (or all eight retries).
* A timer at the fetch's start plus its budget, in event time, ends the rest: what
  has arrived by then is judged as it is, and a fetch without a decision within
  the budget is a ``timeout`` of exactly that length, whether or not another
  attempt ever arrives. Then its state is freed.
* The watermark (on ``ended_at``) says how late an attempt may arrive. Attempts
  that find no attempt 1, or come after the decision, change nothing; they are
  dropped with the timer. Another attempt 1 is another fetch of the URL.

So state is bounded by the attempts of the last budget and lateness, and the output
has one row per fetch, appended by the file sink exactly once. Attempts that
arrive in any order give the same rows.

A call for a state or a timer costs far more than judging a fetch. So the URLs are
dealt by hash over ``BUCKETS`` keys: a key's state is one value with the attempts
of its URLs, and its one timer stands at the earliest budget end among them. A
micro-batch makes a few calls per key that has attempts or a due timer, however
many URLs it brings.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.fetchlog import (FETCH_BUDGET_S, MAX_ATTEMPTS, SHARE_BUDGET_S, attempt_class, numbered)

OUTPUT = ("url STRING, started_at TIMESTAMP_NTZ, attempts INT, outcome STRING, error STRING, "
          "decisive_attempt INT, status INT, elapsed_ms BIGINT")
_RAW = ("url string, started bigint, attempts int, outcome string, error string, decisive_attempt int, status int, "
        "elapsed_ms bigint")
#: the attempts in the state; ``decided`` marks attempt 1 of a fetch whose outcome is written
_STATE = ("held array<struct<url: string, n: int, kind: string, started: bigint, ended: bigint, status: int, "
          "empty: boolean, decided: boolean>>")
#: keys that the URLs are dealt over; a running stream's checkpoint keeps the count it started with
BUCKETS = 8192
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fetches(attempts: list[tuple]) -> tuple[list[list[tuple]], list[tuple]]:
    """(fetches, attempts before the first attempt 1) of a URL's attempts: a fetch
    begins with attempt 1 and holds what starts before the next one."""
    out: list[list[tuple]] = []
    lost: list[tuple] = []
    for a in sorted(attempts, key=lambda a: (a[2], a[0])):
        if a[0] == 1:
            out.append([a])
        elif out:
            out[-1].append(a)
        else:
            lost.append(a)
    return out, lost


def judge(fetch: list[tuple], budget_us: int, final: bool) -> dict | None:
    """The outcome of a fetch; None if attempts that are still to come may change
    it. ``final``: no more will come."""
    start = fetch[0][2]
    limit = start + budget_us
    by_number = {a[0]: a for a in reversed(fetch)}
    stop = next((n for n in sorted(by_number) if by_number[n][1] != "retry"), None)
    last = stop if stop is not None else MAX_ATTEMPTS
    complete = all(n in by_number for n in range(1, last + 1))
    if not complete and not final:
        return None
    end = by_number[last][3] if last in by_number and (stop is not None or complete) else None
    if end is None or end > limit:
        if not (final or complete):
            return None
        return {"attempts": sum(a[3] <= limit for a in by_number.values()), "outcome": "timeout", "error": "timeout",
                "decisive_attempt": None, "status": None, "elapsed_ms": budget_us // 1000}
    cls, status, empty = by_number[last][1], by_number[last][4], by_number[last][5]
    outcome = "max_retries" if stop is None else cls
    error = {"max_retries": "max_retries", "exit": "network_error"}.get(outcome, "invalid_page" if empty else None)
    return {"attempts": sum(n <= last for n in by_number), "outcome": outcome, "error": error,
            "decisive_attempt": stop, "status": status if stop is not None else None, "elapsed_ms": (end - start) // 1000}


class Fetches(StatefulProcessor):
    """State of a bucket of URLs: the attempts of their fetches whose budget is not over."""

    def __init__(self, budget_s: int):
        self.budget_us = budget_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("attempts", _STATE)

    def _write(self, url: str, fetch: list[tuple], final: bool) -> tuple[list[tuple], list[Row]]:
        """(what stays in the state, rows to write)."""
        if fetch[0][6]:
            return fetch[:1], []
        got = judge(fetch, self.budget_us, final)
        if got is None:
            return fetch, []
        return [(*fetch[0][:6], True)], [Row(url=url, started=fetch[0][2], **got)]

    def _held(self) -> dict[str | None, list[tuple]]:
        """The attempts in the state by URL."""
        held: dict[str | None, list[tuple]] = {}
        for url, *a in (self.seen.get() or ([],))[0]:
            held.setdefault(url, []).append(tuple(a))
        return held

    def _keep(self, held: dict[str | None, list[tuple]], timer: int | None) -> None:
        """Store the attempts; ``timer``: the one that stands already."""
        rows = [(url, *a) for url, attempts in held.items() for a in attempts]
        if not rows:
            self.seen.clear()
            return
        self.seen.update((rows,))
        first = self._first(held)
        if first != timer:
            self.handle.registerTimer(first)

    def _expiry(self, started: int) -> int:
        return -(-(started + self.budget_us) // 1000)

    def _first(self, held: dict[str | None, list[tuple]]) -> int | None:
        """When the earliest budget ends."""
        started = min((a[2] for attempts in held.values() for a in attempts), default=None)
        return None if started is None else self._expiry(started)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self._held()
        timer = self._first(held)
        arrived: dict[str | None, list[tuple]] = {}
        for r in rows:
            arrived.setdefault(r.url, []).append((r.n, r.kind, r.started, r.ended, r.status, r.empty, False))
        for url, attempts in arrived.items():
            before = held.get(url, [])
            known = {(a[0], a[2]) for a in before}
            for a in attempts:
                if (a[0], a[2]) not in known:  # an attempt that is delivered twice counts once
                    known.add((a[0], a[2]))
                    before.append(a)
            found, keep = fetches(before)
            for fetch in found:
                stays, out = self._write(url, fetch, final=False)
                keep += stays
                yield from out
            held[url] = keep
        self._keep(held, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # one timer for the bucket: all budgets that the watermark has passed end with it
        end, now = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()

        def is_over(a: tuple) -> bool:
            return self._expiry(a[2]) <= now or self._expiry(a[2]) < end

        held = self._held()
        for url, attempts in held.items():
            if not any(map(is_over, attempts)):
                continue
            found, lost = fetches(attempts)
            keep = [a for a in lost if not is_over(a)]
            for fetch in found:
                over = is_over(fetch[0])
                stays, out = self._write(url, fetch, final=over)
                keep += [] if over else stays
                yield from out
            held[url] = keep
        self._keep(held, now)

    def close(self) -> None:
        pass


def resolve_timed(attempts: DataFrame, budget_s: int = FETCH_BUDGET_S, share_budget_s: int = SHARE_BUDGET_S,
                  lateness: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """The final outcome of every fetch in a streaming attempt log (append mode;
    needs the RocksDB state store). The shorter budget counts."""
    a = attempts.where(numbered()).select(
        F.pmod(F.xxhash64("url"), F.lit(buckets)).alias("bucket"), "url", F.col("attempt_no").alias("n"), attempt_class(F.col("status"), F.col("net_error")).alias("kind"),
        F.unix_micros(F.col("started_at").cast("timestamp_ltz")).alias("started"),
        F.unix_micros(F.col("ended_at").cast("timestamp_ltz")).alias("ended"), "status",
        (F.col("body").isNull() | (F.col("body") == "")).alias("empty"), F.col("ended_at").cast("timestamp_ltz").alias("at"))
    done = a.withWatermark("at", lateness).groupBy("bucket").transformWithState(
        Fetches(min(budget_s, share_budget_s)), outputStructType=_RAW, outputMode="append", timeMode="eventTime")
    return done.select("url", F.timestamp_micros("started").cast("timestamp_ntz").alias("started_at"), "attempts",
                       "outcome", "error", "decisive_attempt", "status", "elapsed_ms")


def start_timed_resolver(attempts: DataFrame, out: str, checkpoint_location: str, available_now: bool = False,
                         processing_time: str = "1 minute", **budgets) -> StreamingQuery:
    """Append the outcomes of a streaming attempt log to ``out``, each once. Both
    paths must be on the cluster's shared storage."""
    spark = attempts.sparkSession
    w = (resolve_timed(attempts, **budgets).writeStream.format("parquet").outputMode("append")
         .option("path", out).option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)  # timers need it; a query keeps the setting it starts with
    try:
        return w.start()
    finally:
        spark.conf.set(STATE_STORE, before)


def outcomes(spark: SparkSession, out: str) -> DataFrame:
    """The outcomes written so far, one row per fetch."""
    return spark.read.schema(OUTPUT).parquet(out)
