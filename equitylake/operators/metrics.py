"""Run metrics as one-row DataFrames.

Scrape metrics count attempts (``total``), successes and five error kinds;
insertion metrics count attempted and committed rows. All are global
aggregates, so an empty input still yields one all-zero row, and two runs
add up field by field.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.parsers import ntz_lit


def scrape_metrics(outcomes: DataFrame, counted: str = "counted", ok: str = "ok",
                   error: str = "error") -> DataFrame:
    """``outcomes`` rows: ``counted`` (adds to total), ``ok`` (a success),
    ``error`` (one of ``schemas.ERROR_KINDS`` or NULL)."""
    return outcomes.agg(
        F.count_if(F.col(counted)).cast("int").alias("total"),
        F.count_if(F.col(ok)).cast("int").alias("successful"),
        *[F.count_if(F.col(error) == k).cast("int").alias(k) for k in schemas.ERROR_KINDS])


def zero_metrics(spark: SparkSession) -> DataFrame:
    """The zero row of the scrape metrics."""
    return spark.createDataFrame([(0,) * len(schemas.METRICS)], schemas.METRICS)


def add_metrics(*metrics: DataFrame) -> DataFrame:
    """Field-wise sum of metric rows (the zero row is the identity)."""
    u = reduce(DataFrame.unionByName, metrics)
    names = [f.name for f in metrics[0].schema.fields]
    return u.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("int").alias(c) for c in names])


def insertion_metrics(outcome: DataFrame, inserted: str = "inserted") -> DataFrame:
    return outcome.agg(F.count(F.lit(1)).cast("int").alias("total"),
                       F.count_if(F.col(inserted)).cast("int").alias("successful"))


def run_record(spark: SparkSession, job: str, scrape: DataFrame, insert: DataFrame,
               start: dt.datetime, end: dt.datetime) -> DataFrame:
    """One row for the ``runs`` table: both metric rows, start, duration."""
    s_t = F.struct(*[F.col(c) for c in scrape.columns])
    i_t = F.struct(*[F.col(c) for c in insert.columns])
    s = scrape.select(s_t.alias("scrape"))
    i = insert.select(i_t.alias("insert"))
    both = (s.withColumn("insert", F.lit(None).cast(i.schema["insert"].dataType))
            .unionByName(i.withColumn("scrape", F.lit(None).cast(s.schema["scrape"].dataType))))
    ms = int((end - start).total_seconds() * 1000)
    return both.agg(F.first("scrape", ignorenulls=True).alias("scrape"),
                    F.first("insert", ignorenulls=True).alias("insert")).select(
        F.lit(job).alias("job"), "scrape", "insert",
        ntz_lit(start).alias("start_time"),
        F.lit(ms).cast("bigint").alias("duration_millis"))
