"""Streaming fetch-log resolution: the crawler's retry rules over attempts as
they arrive.

The rules are one aggregation per URL (``fetchlog.resolve``), so the stream is
that very aggregation in update mode: Spark keeps one small row of partial
aggregates per URL, whatever the number of its attempts, and each micro-batch
emits the new outcome of the URLs it touched. Nothing is late: an attempt that
arrives after a decision is aggregated like any other, and the newest row of a
URL always equals what the batch operator gives for the attempts seen so far.

``start_resolver`` writes each micro-batch's rows to a folder of its own, which
a replay overwrites; ``resolved`` reads the newest row per URL.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.fetchlog import FETCH_BUDGET_S, resolve

OUTPUT = ("url STRING, attempts INT, outcome STRING, error STRING, decisive_attempt INT, "
          "status INT, elapsed_ms BIGINT")


def resolve_stream(attempts: DataFrame, budget_s: int = FETCH_BUDGET_S) -> DataFrame:
    """The streaming twin of ``fetchlog.resolve`` (use output mode update)."""
    return resolve(attempts, budget_s)


def start_resolver(attempts: DataFrame, out: str, checkpoint_location: str,
                   available_now: bool = False, processing_time: str = "1 minute") -> StreamingQuery:
    """Resolve a streaming attempt log into ``out``. Both paths must be on the
    cluster's shared storage."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    w = (resolve_stream(attempts).writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


def resolved(spark: SparkSession, out: str) -> DataFrame:
    """One row per URL: its newest outcome."""
    try:
        rows = spark.read.schema(OUTPUT + ", batch BIGINT").parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], OUTPUT)
    columns = [c.split()[0] for c in OUTPUT.split(", ")]
    newest = rows.groupBy("url").agg(F.max_by(F.struct(*columns), "batch").alias("r"))
    return newest.select("r.*")
