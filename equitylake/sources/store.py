"""Versioned, bucketed Parquet store for the hub and the four satellites.

Each write puts a table's new contents in a fresh version directory
(``<root>/<table>/v=<n>-<attempt>``); Spark never overwrites a table it is
reading. A write becomes visible only when its commit row (the version
directory of every table, and the bucket count) is appended to
``<root>/_commits`` -- the last step of a job. Readers take the newest
commit, so the four satellites of one refresh appear together or not at
all, and an interrupted job leaves only unreferenced directories behind.

Every table version is written bucketed (and sorted) by ``isin`` into the
same number of buckets, and registered on read as an external bucketed
table over its directory. The five-table join of the current view then
needs no shuffle, and a merge shuffles only the batch side.

A store has one writer at a time (its jobs run in sequence); readers may
run concurrently with it. Should two commits ever carry the same version
number, the later ``committed_at`` wins, so every reader sees the same
head.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.parsers import ntz_lit
from ..session import utc_now

_COMMIT_COLS = ["version", "committed_at", "buckets", *schemas.TABLES, "stream_id", "batch_id"]
_COMMIT_SCHEMA = ("version BIGINT, committed_at TIMESTAMP_NTZ, buckets INT, "
                  + ", ".join(f"{t} STRING" for t in schemas.TABLES) + ", stream_id STRING, batch_id BIGINT")
MIN_BUCKETS = 8
BUCKET_BYTES = 128 << 20  # of the largest table, about


def _ddl(table: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.TABLES[table].fields)


def _sql_str(text: str) -> str:
    """Body of a SQL string literal (backslash and quote escaped)."""
    return text.replace("\\", "\\\\").replace("'", "\\'")


def _catalog_name(path: str) -> str:
    import hashlib
    return "equitylake_" + hashlib.sha1(path.encode()).hexdigest()[:16]


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        """``buckets``: bucket count of a new store; by default it follows from
        the size of the first write, about ``BUCKET_BYTES`` a bucket. A store
        keeps the count of its commits until ``rebucket``."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets

    def _commits(self) -> DataFrame | None:
        """The commit rows, or None when the store was never written. Only a
        missing path means that: any other read failure is raised, as a store
        taken for empty would be overwritten."""
        try:
            return self.spark.read.schema(_COMMIT_SCHEMA).parquet(f"{self.root}/_commits")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def head(self) -> dict | None:
        """The newest commit row (one small row of metadata)."""
        c = self._commits()
        if c is None:
            return None
        rows = c.orderBy(F.col("version").desc(), F.col("committed_at").desc()).limit(1).collect()
        return rows[0].asDict() if rows else None

    def has_batch(self, stream_id: str, batch_id: int) -> bool:
        """Whether a commit carries this micro-batch of this stream."""
        c = self._commits()
        return c is not None and not c.where(
            (F.col("stream_id") == stream_id) & (F.col("batch_id") == batch_id)).isEmpty()

    def _bucketed(self, path: str, table: str, buckets: int) -> DataFrame:
        name = _catalog_name(path)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({_ddl(table)}) USING parquet "
            f"CLUSTERED BY (isin) SORTED BY (isin) INTO {int(buckets)} BUCKETS "
            f"LOCATION '{_sql_str(path)}'")
        return self.spark.table(name)

    def tables(self) -> dict[str, DataFrame]:
        """Current contents of all five tables (empty ones if never written)."""
        head = self.head() or {}
        out = {}
        for t, schema in schemas.TABLES.items():
            path = head.get(t)
            out[t] = (self._bucketed(path, t, head["buckets"]) if path
                      else self.spark.createDataFrame([], schema))
        return out

    def write(self, new: dict[str, DataFrame], shuffle: bool = True,
              batch: tuple[str, int] | None = None) -> int:
        """Write the given tables as a new version and commit it. ``batch``: the
        (stream id, micro-batch id) that the commit row records, so that data
        and mark become visible together.

        ``shuffle``: hash the rows into their buckets first (one file per
        bucket). Without it each task writes the bucket files of the rows
        it holds -- no shuffle, more files; the right choice when the input
        is mostly a scan or merge of this store's bucketed tables, whose
        tasks already hold whole buckets.
        """
        head = self.head() or {}
        version = int(head.get("version") or 0) + 1
        buckets = int(head.get("buckets") or self.buckets or self._buckets_for(new))
        return self._write(new, head, version, buckets, shuffle, batch)

    def _buckets_for(self, new: dict[str, DataFrame]) -> int:
        from ..operators.merge import approx_row_bytes
        size = max((df.count() * approx_row_bytes(df) for df in new.values()), default=0)
        return max(MIN_BUCKETS, -(-size // BUCKET_BYTES))

    def rebucket(self, buckets: int | None = None) -> int:
        """Rewrite all tables with another bucket count (default: what their
        present size asks for), as a new version."""
        head, tables = self.head() or {}, self.tables()
        written = {t: df for t, df in tables.items() if head.get(t)}
        return self._write(written, {}, int(head.get("version") or 0) + 1,
                           buckets or self._buckets_for(written), True, None)

    def _write(self, new: dict[str, DataFrame], head: dict, version: int, buckets: int,
               shuffle: bool, batch: tuple[str, int] | None) -> int:
        paths = {t: head.get(t) for t in schemas.TABLES}
        attempt = uuid.uuid4().hex[:12]
        for t, df in new.items():
            # unique per attempt: an uncommitted directory left by a failed
            # run is never reused, only ignored
            path = f"{self.root}/{t}/v={version}-{attempt}"
            cols = [f.name for f in schemas.TABLES[t].fields]
            # one file per bucket, sorted by isin: bucketed joins on read, and
            # min/max statistics let point lookups on isin skip row groups
            out = df.select(*cols)
            if shuffle:
                out = out.repartition(buckets, "isin")
            (out.write.bucketBy(buckets, "isin").sortBy("isin").option("path", path)
             .mode("errorifexists").saveAsTable(_catalog_name(path)))
            paths[t] = path
        row = {"version": version, "committed_at": utc_now(), "buckets": buckets, **paths,
               "stream_id": batch[0] if batch else None, "batch_id": batch[1] if batch else None}
        (self.spark.createDataFrame([tuple(row[c] for c in _COMMIT_COLS)], _COMMIT_SCHEMA)
         .coalesce(1).write.mode("append").parquet(f"{self.root}/_commits"))
        return version

    def append_rejects(self, rejects: DataFrame, job: str, at) -> None:
        """Route refused rows: (isin, table, reason) plus job and time."""
        (rejects.select(F.col("isin"), F.col("table"), F.col("reason"),
                        F.lit(job).alias("job"),
                        ntz_lit(at).alias("rejected_at"))
         .write.mode("append").parquet(f"{self.root}/_rejects"))

    def rejects(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/_rejects")

    def append_run(self, run: DataFrame) -> None:
        run.coalesce(1).write.mode("append").parquet(f"{self.root}/_runs")

    def runs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/_runs")
