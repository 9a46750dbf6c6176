"""Streaming refresh: detail pages arriving as files update the store.

A crawler drops ``(page_id, url, html)`` Parquet files into a directory;
``start_page_ingest`` reads them with Structured Streaming and, per
micro-batch, runs the same set-based refresh as the batch job: scan the
batch's pages of known instruments, validate per ISIN across the four
payloads, merge null-preservingly, commit one store version.

Replays are safe: the commit row of a micro-batch records the stream (the id
that Spark keeps in the checkpoint) and the batch id, so data and mark become
visible together; a batch that has a commit is skipped. Another stream, or a
fresh checkpoint, has an id of its own and starts at batch 0 without a clash.
The merge itself is idempotent.
The parsers are row-local Column expressions, so ``parse_stream`` can also
type a page stream directly (e.g. into a memory or Parquet sink).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge as M
from ..operators import metrics as MT
from ..plans import jobs
from ..session import utc_now
from ..sources.store import Store

PAGES_SCHEMA = "page_id BIGINT, url STRING, html STRING"


def page_stream(spark: SparkSession, pages_dir: str, max_files_per_trigger: int = 64) -> DataFrame:
    return (spark.readStream.schema(PAGES_SCHEMA)
            .option("maxFilesPerTrigger", max_files_per_trigger).parquet(pages_dir))


def stream_id(spark: SparkSession, checkpoint_location: str) -> str:
    """The id that Spark keeps in a checkpoint: the same after a restart, a new
    one for a fresh checkpoint."""
    row = spark.read.json(f"{checkpoint_location.rstrip('/')}/metadata").first()
    return row["id"]


def refresh_batch(store: Store, pages: DataFrame, stream: str, batch_id: int,
                  as_of: dt.datetime | None = None) -> None:
    """Apply one micro-batch of pages to the store (skipped when the store has
    a commit of this batch of this stream)."""
    spark = store.spark
    if store.has_batch(stream, batch_id):
        return
    start = utc_now()
    current = store.tables()
    hub = current["share_isins"].select("isin", "share_name")
    # only instruments that have a page in this batch are refreshed
    scanned = jobs._stage(jobs.scan_found(hub, pages, broadcast_requests=M.fits_broadcast(hub)),
                          f"stream-{batch_id}-scanned")
    wide = jobs._stage(jobs.records_of(scanned, as_of or start), f"stream-{batch_id}-extracted")
    scrape = MT.scrape_metrics(jobs.outcomes_of(scanned))
    _, insert, rejects = jobs.write_shares(store, wide, current["share_isins"], current,
                                           batch=(stream, batch_id))
    store.append_rejects(rejects, "stream_refresh", start)
    store.append_run(MT.run_record(spark, "stream_refresh", scrape, insert, start, utc_now()))


def start_page_ingest(store: Store, pages_dir: str, checkpoint_location: str,
                      available_now: bool = False,
                      processing_time: str = "1 minute",
                      as_of: dt.datetime | None = None,
                      max_files_per_trigger: int = 64) -> StreamingQuery:
    """Start the streaming refresh. ``checkpoint_location`` must be on the
    cluster's shared storage (the query restarts from it after a failure).
    ``as_of``: stamp for the refreshed records (default: each batch's
    start time)."""
    def apply(df: DataFrame, batch_id: int) -> None:
        # the checkpoint has its id before the first batch
        refresh_batch(store, df, stream_id(store.spark, checkpoint_location), batch_id, as_of)
    w = (page_stream(store.spark, pages_dir, max_files_per_trigger).writeStream
         .foreachBatch(apply)
         .option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


def parse_stream(pages: DataFrame) -> DataFrame:
    """Typed rows of a (streaming or batch) page DataFrame: the labelled
    rows of each page with every value parsed as a number and as a
    date-time -- row-local, no state."""
    from ..functions import parsers as P
    from ..operators import extract as X
    rows = X.scan_detail_rows(pages)
    return rows.select("page_id", "url", "table_ord", "row_ord", F.lower("label").alias("label"),
                       "value", P.parse_float(F.col("value")).alias("as_number"),
                       P.parse_datetime(F.col("value")).alias("as_datetime"))
