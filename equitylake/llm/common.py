"""Reading, staging and chunking shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equitylake.session import ship_package, staging_path

#: UTF-8 bytes of text that a task works on at once (a longer text is a chunk of its own):
#: where chunks ask for what they need, and larger ones ask less, and elsewhere
CHUNK_BYTES = 4 << 20
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder under ``spark.checkpoint.dir`` and reread
    it: lineage ends there, and any executor can read the files."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``staged``, as a table bucketed by ``key``: a later join on that key
    moves only its other side. A chunk has one key, so tasks write a file per
    chunk and nothing is shuffled here."""
    spark = df.sparkSession
    at = f"llm_{name}_{uuid.uuid4().hex}"
    n = min(max(n_partitions(spark), 1), 50_000)
    (df.write.format("parquet").option("compression", "zstd").bucketBy(n, key)
       .option("path", staging_path(spark, name)).saveAsTable(at))
    return spark.table(at)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Table]]:
    """Gather a task's batches into tables of about ``limit`` bytes of text, each
    with an id made of the task's partition and a running number."""
    from pyspark import TaskContext
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    held: list[pa.RecordBatch] = []
    size = n = 0
    for b in batches:
        for at, rows in _cut(b, text, limit):
            held.append(b.slice(at, rows))
            size += held[-1].column(text).nbytes
            if size >= limit:
                yield (part << 32) + n, pa.Table.from_batches(held)
                held, size, n = [], 0, n + 1
    if held:
        yield (part << 32) + n, pa.Table.from_batches(held)


def _cut(b: pa.RecordBatch, text: str, limit: int) -> Iterator[tuple[int, int]]:
    """(start, rows) of the slices of a batch that hold about ``limit`` bytes."""
    import numpy as np
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, to - at
        at = to


def per_chunk(fn: Callable[[int, pa.Table], pa.Table | None], text: str = "text",
              limit: int = BATCH_BYTES):
    """A function for ``mapInArrow`` that applies ``fn`` chunk by chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, t in chunks(batches, text, limit):
            out = fn(chunk, t)
            if out is not None and out.num_rows:
                yield from out.to_batches()
    return run


def long_texts_ok(df: DataFrame) -> DataFrame:
    """Ready the session for the Python of the corpus operators: workers can
    import the package, and Arrow batches are bounded by bytes as well as rows."""
    ship_package(df.sparkSession)
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df
