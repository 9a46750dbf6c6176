"""Line dedup by levelled sorted runs of line hashes.

A line's key is the line without the blanks around it, A-Z lower-cased; keys of
at least ten code points count. ``LineIndex`` holds the hashes (128 bits) of all
keys seen so far in runs: tables sorted by hash and bucketed alike, dealt to
levels. A new batch of documents is reduced to one row per distinct hash, merged
with every run (one sort-merge join a run; neither side of it is shuffled again)
and written: the hashes that no run holds, the anti-join, are the batch's own run
on level 0. Before that, a level with ``fanout`` runs is compacted to one run of
the next level, so a batch meets at most ``fanout - 1`` runs a level, after a
compaction of the last. A line goes if its hash lies in an earlier run, or in the
batch with a smaller doc_id.

``dedup`` cuts a corpus into batches of ascending doc_id, so the smallest doc_id
that holds a key keeps its lines, wherever the cuts are.

Only DataFrame operations. Texts are read twice and shuffled once, when the
numbers of the lines to drop come back to them; in between a line is 40 bytes.
Hot keys: hashes with more than 1/20,000 of a batch's lines are at most 20,000
and are looked up by a broadcast join, where their lines lie; all others are
joined by shuffle, in groups of at most that share.

Edge cases: null text is the empty text, one empty line; a null doc_id counts as
larger than every id; rows that share a doc_id keep each other's lines, as do
all rows of null ids; identical rows get identical results; an empty table
gives an empty result; a very long text is one row whose cost is linear in it.
Input columns travel in the struct ``doc``, so their names can't clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equitylake.session import staging_path

from .common import n_partitions, staged

BLANKS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BATCHES = 4  # of a corpus that is there as a whole
FANOUT = 2  # runs of a level before they are compacted
HOT_KEYS = 20_000  # rows of a broadcast, 32 bytes each
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
HASH = ["h1", "h2"]
ROW = ["t1", "t2"]


def line_key(line: Column) -> Column:
    """The line without blanks around it, A-Z lower-cased."""
    bare = F.trim(line, F.lit(BLANKS))
    ascii_only = F.length(bare) == F.octet_length(bare)  # there, lower() changes A-Z alone
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def rows_of(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(doc, doc_id, text, t1, t2): ``t1`` and ``t2`` name a row by what it holds."""
    text = F.coalesce(docs["text"], F.lit(""))
    doc = F.struct(*[docs[c] for c in carry]) if carry else F.lit(None).cast("struct<none:int>")
    return docs.select(doc.alias("doc"), docs["doc_id"].alias("doc_id"), text.alias("text"),
                       F.xxhash64(docs["doc_id"], text).alias("t1"),
                       F.xxhash64(F.lit(1), docs["doc_id"], text).alias("t2"))


def lines_of(rows: DataFrame, least: int = 10) -> DataFrame:
    """(t1, t2, doc_id, nth, h1, h2): the lines whose key has ``least`` code points."""
    return (rows.select("t1", "t2", "doc_id", F.posexplode(F.split("text", "\n")).alias("nth", "line"))
            .select("t1", "t2", "doc_id", "nth", line_key(F.col("line")).alias("key"))
            .where(F.length("key") >= least)
            .select("t1", "t2", "doc_id", "nth", F.xxhash64("key").alias("h1"),
                    F.xxhash64(F.lit(1), F.col("key")).alias("h2")))


class LineIndex:
    """The hashes of all lines seen, in levels of sorted runs.

    ``add`` takes one batch's lines (``lines_of``) and returns those to drop.
    ``close`` drops the catalog names of the runs; their files stay under
    ``spark.checkpoint.dir``.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = min(max(n_partitions(spark), 1), 50_000)
        self.levels: list[list[DataFrame]] = []
        self.names: list[str] = []

    def _write(self, keys: DataFrame) -> DataFrame:
        """A table sorted by hash in the index's buckets. A task of ``keys`` holds
        whole buckets, so a bucket is one file, which is read back as sorted."""
        name = f"llm_lines_{uuid.uuid4().hex}"
        before = self.spark.conf.get(ORDERED, "false")
        self.spark.conf.set(ORDERED, "true")
        try:
            (keys.write.format("parquet").option("compression", "zstd")
                 .bucketBy(self.buckets, *HASH).sortBy(*HASH)
                 .option("path", staging_path(self.spark, "lines_run")).saveAsTable(name))
        finally:
            self.spark.conf.set(ORDERED, before)
        self.names.append(name)
        return self.spark.table(name)

    def compact(self) -> None:
        """Merge the runs of every full level into one run of the next."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                merged = self.levels[level][0]
                for run in self.levels[level][1:]:
                    merged = merged.unionAll(run)
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._write(merged.repartition(self.buckets, *HASH)))
                self.levels[level] = []
            level += 1

    def add(self, lines: DataFrame) -> DataFrame:
        """(t1, t2, nth) of the batch's lines whose hash an earlier batch holds, or
        a smaller doc_id of this one; the hashes new to the index become a run."""
        self.compact()
        keys = lines.groupBy(*HASH).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
                                        F.count("*").alias("n"), F.count("doc_id").alias("with_id"))
        seen = F.lit(False)
        for k, run in enumerate(r for level in self.levels for r in level):
            keys = keys.join(run.withColumn(f"in{k}", F.lit(True)), HASH, "left")
            seen = seen | F.col(f"in{k}").isNotNull()
        table = self._write(keys.select(*HASH, "first", "last", "n", "with_id", seen.alias("seen")))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(table.where("not seen").select(*HASH))

        total = table.agg(F.sum("n")).first()[0] or 0
        repeated = F.col("last") > F.col("first")
        without = F.col("first").isNotNull() & (F.col("n") > F.col("with_id"))
        verdict = table.where(F.col("seen") | repeated | without).select(*HASH, "first", "seen", "n")
        hot = F.col("n") > total // HOT_KEYS + 1
        later = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
        goes = F.col("seen") | later
        by_hot = lines.join(F.broadcast(verdict.where(hot).drop("n")), HASH, "left")
        found = by_hot.where(F.col("seen").isNotNull() & goes)
        others = by_hot.where(F.col("seen").isNull()).select(*lines.columns)
        found_too = others.join(verdict.where(~hot).drop("n"), HASH).where(goes)
        return found.select(*ROW, "nth").unionAll(found_too.select(*ROW, "nth"))

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []


def drop_lines(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` with the lines of ``gone`` (t1, t2, nth) taken out of the text:
    (doc, doc_id, text, n_lines, n_dropped)."""
    numbers = gone.groupBy(*ROW).agg(F.collect_set("nth").alias("gone"))

    # the line array is bound to a variable, so that it is split once
    kept = F.element_at(F.transform(F.array(F.split("text", "\n")), lambda lines: F.concat_ws("\n", F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda k: F.get(lines, k)))), 1)
    return rows.join(numbers, ROW, "left").select(
        "doc", "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def dedup(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, least: int = 10,
          carry: Sequence[str] | None = None) -> DataFrame:
    """Every document without the lines that a smaller doc_id holds: ``doc`` (struct
    of the ``carry`` columns, default all), ``doc_id``, ``text``, ``n_lines``
    (before) and ``n_dropped``."""
    spark = docs.sparkSession
    rows = rows_of(docs, docs.columns if carry is None else carry)
    shares = [b / batches for b in range(1, batches)]
    cuts = (docs.agg(F.percentile_approx("doc_id", shares)).first()[0] or []) if shares else []
    batch = sum((F.coalesce(F.col("doc_id") > c, F.lit(True)).cast("int") for c in sorted(set(cuts))), F.lit(0))
    lines = lines_of(rows, least).withColumn("batch", batch)
    path = staging_path(spark, "lines")
    lines.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    index = LineIndex(spark, fanout)
    gone = None
    for b in range(len(set(cuts)) + 1):
        more = index.add(lines.where(F.col("batch") == b).drop("batch"))
        gone = more if gone is None else gone.unionAll(more)
    gone = staged(gone, "lines_gone")
    index.close()
    return drop_lines(rows, gone)
