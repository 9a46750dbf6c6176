"""Fetch-log resolution: the retry rules of the crawler applied to a table
of attempts ``(url, attempt_no, status, net_error, body, started_at,
ended_at)``.

* attempt class: HTTP 200 returns; 429, 500, 502, 503, 504 are retried;
  any other status or a transport error exits.
* outcome per URL: the first returning or exiting attempt decides; eight
  retried attempts (one try plus seven retries) end in ``max_retries``;
  a decision that ends more than 256 s after the first attempt started is
  a ``timeout`` (the overall budget wins); a log that has none of these
  yet is ``pending``.
* error kind: exit -> network_error, max_retries, timeout; a returned
  page with an empty body -> invalid_page; else no error.

The outcome is one aggregation per URL built from partial-aggregatable
functions (min over structs, conditional counts), so even a URL holding a
large share of all attempts is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES of the crawler's retry policy.
RETRY_STATUSES = (429, 502, 503, 504, 500)
MAX_ATTEMPTS = 8              # 1 try + 7 retries
FETCH_BUDGET_S = 256          # overall timeout per URL
SHARE_BUDGET_S = 300          # overall timeout of a share, around its fetch


def attempt_class(status: Column, net_error: Column) -> Column:
    return (F.when(net_error, F.lit("exit"))
            .when(status == 200, F.lit("return"))
            .when(status.isin(*RETRY_STATUSES), F.lit("retry"))
            .otherwise(F.lit("exit")))


def numbered() -> Column:
    """Whether the retry rules can place an attempt."""
    return F.coalesce(F.col("attempt_no").between(1, MAX_ATTEMPTS), F.lit(False))


def rejected(log: DataFrame) -> DataFrame:
    """Attempts that the retry rules can't place, as rejects (isin, table,
    reason): their number is NULL or not within 1 and ``MAX_ATTEMPTS``."""
    return log.where(~numbered()).select(
        F.lit(None).cast("string").alias("isin"), F.lit("attempts").alias("table"),
        F.concat(F.lit("attempt_no_"), F.coalesce(F.col("attempt_no").cast("string"), F.lit("null")),
                 F.lit(" "), F.coalesce("url", F.lit(""))).alias("reason"))


def resolve(log: DataFrame, budget_s: int = FETCH_BUDGET_S,
            share_budget_s: int = SHARE_BUDGET_S) -> DataFrame:
    """One row per URL: outcome, error kind, decisive attempt, elapsed ms. A
    decision past the fetch budget or the share's own is a timeout, whichever
    is shorter. ``rejected`` has the attempts that this leaves out."""
    a = log.where(numbered()) \
        .withColumn("cls", attempt_class(F.col("status"), F.col("net_error")))
    decisive = F.struct(F.col("attempt_no").alias("n"), F.col("cls").alias("cls"),
                        F.col("ended_at").alias("end"), F.col("status").alias("status"),
                        (F.col("body").isNull() | (F.col("body") == "")).alias("empty"))
    g = a.groupBy("url").agg(
        F.min(F.when(F.col("cls") != "retry", decisive)).alias("d"),
        F.count_if(F.col("cls") == "retry").alias("n_retry"),
        F.max(F.when(F.col("attempt_no") == MAX_ATTEMPTS, F.col("ended_at"))).alias("end_last"),
        F.min("started_at").alias("start"),
        F.max("ended_at").alias("end_seen"),
        F.count(F.lit(1)).alias("attempts"))
    exhausted = F.col("d").isNull() & (F.col("n_retry") >= MAX_ATTEMPTS)
    end = (F.when(F.col("d").isNotNull(), F.col("d.end"))
           .when(exhausted, F.col("end_last"))
           .otherwise(F.col("end_seen")))
    late = end > F.timestamp_add("SECOND", F.lit(min(budget_s, share_budget_s)), F.col("start"))
    outcome = (F.when(late, F.lit("timeout"))
               .when(F.col("d").isNotNull(), F.col("d.cls"))
               .when(exhausted, F.lit("max_retries"))
               .otherwise(F.lit("pending")))
    error = (F.when(outcome == "exit", F.lit("network_error"))
             .when(outcome.isin("timeout", "max_retries"), outcome)
             .when((outcome == "return") & F.col("d.empty"), F.lit("invalid_page")))
    return g.select("url", F.col("attempts").cast("int").alias("attempts"),
                    outcome.alias("outcome"), error.alias("error"),
                    F.col("d.n").alias("decisive_attempt"), F.col("d.status").alias("status"),
                    F.timestamp_diff("MILLISECOND", F.col("start"), end).alias("elapsed_ms"))


def fetch_metrics(resolved: DataFrame) -> DataFrame:
    """Scrape metrics of resolved URLs (pending ones are not counted)."""
    from .metrics import scrape_metrics
    done = resolved.where(F.col("outcome") != "pending")
    return scrape_metrics(done.select(F.lit(True).alias("counted"),
                                      F.col("error").isNull().alias("ok"), "error"))


def fetched_pages(log: DataFrame, resolved: DataFrame, broadcast_ok: bool = False,
                  empty: bool = False) -> DataFrame:
    """Pages of URLs whose fetch succeeded: the body of the deciding attempt,
    with the time it was read. ``page_id`` is a hash of the URL. ``empty``: with
    the returned pages that have no body.

    Only HTTP-200 attempts can carry a page, so the log is cut to those
    before it meets the (url, attempt) keys; with ``broadcast_ok`` (the
    caller checked the resolved set is small) the log is never shuffled.
    """
    ok = resolved.where((F.lit(empty) | F.col("error").isNull()) & (F.col("outcome") == "return")) \
        .select("url", F.col("decisive_attempt").alias("attempt_no"))
    if broadcast_ok:
        ok = F.broadcast(ok)
    answered = log.where((F.col("status") == 200) & ~F.coalesce(F.col("net_error"), F.lit(False)))
    return (answered.join(ok, ["url", "attempt_no"], "left_semi")
            .select(F.xxhash64("url").alias("page_id"), "url", F.col("body").alias("html"),
                    F.col("ended_at").alias("fetched_at")))
