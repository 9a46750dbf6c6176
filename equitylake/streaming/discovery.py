"""Streaming discovery: listing pages that arrive as files insert instruments.

Each micro-batch is scanned, its links counted and classified, equal instruments
collapsed, and those whose ISIN the hub doesn't have are inserted in one commit.
The hub is the memory of the stream: what an earlier batch (or any other run)
inserted is known, so no state store has to hold all keys, and a key's first batch
wins. The commit records the stream and the micro-batch, as in ``ingest``: a
replayed batch changes nothing, and one that brings only known instruments
commits its mark without rewriting the hub.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract as X
from ..operators import html_scan
from ..plans import jobs
from ..plans.names import NameIndex
from ..session import utc_now
from ..sources.store import Store
from .ingest import page_stream, stream_id


def discover_batch(store: Store, pages: DataFrame, stream: str, batch_id: int, as_of: dt.datetime | None = None,
                   chain=html_scan.LISTING_LINKS, name=html_scan.LISTING_NAME, names: NameIndex | None = None) -> None:
    """Insert the instruments of one micro-batch of listing pages (skipped when the
    store has a commit of this batch of this stream)."""
    if store.has_batch(stream, batch_id):
        return
    start = utc_now()
    scanned = jobs._stage(X.scan_links(pages, chain, name), f"stream-{batch_id}-links")
    instruments, _, scrape = jobs.extract_instruments(pages, as_of or start, chain, name, scanned=scanned)
    store.append_run(jobs.insert_instruments(store, instruments, scrape, "stream_discover", start,
                                             batch=(stream, batch_id), names=names))


def start_discovery(store: Store, pages_dir: str, checkpoint_location: str, available_now: bool = False,
                    processing_time: str = "1 minute", as_of: dt.datetime | None = None,
                    max_files_per_trigger: int = 64, **how) -> StreamingQuery:
    """Start the streaming discovery. ``checkpoint_location`` must be on the cluster's
    shared storage. ``how``: selectors and the name index of ``discover_batch``."""
    def apply(df: DataFrame, batch_id: int) -> None:
        discover_batch(store, df, stream_id(store.spark, checkpoint_location), batch_id, as_of, **how)
    w = (page_stream(store.spark, pages_dir, max_files_per_trigger).writeStream
         .foreachBatch(apply).option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()
