"""Trigram index over instrument names: substring lookup without a hub scan.

Every hub row is posted once under each distinct trigram (three code points) of
its lower-cased name, in files partitioned by a hash of the trigram. A lookup reads
the partitions of the pattern's trigrams only, keeps the rows posted under all of
them and verifies those with the pattern itself. A pattern with wildcards or an
escape, or with fewer than three characters, has no trigrams to look up:
``matches`` returns None and the caller scans the hub.

Hub rows never change, so the index only grows: ``add`` posts new rows
(``jobs.discover`` does, given the index, before it commits them). Rows posted twice, after a retry, count
once. A trigram that a third of all names share is a large posting list, read and
counted by many tasks; nothing is gathered by trigram.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

PARTS = 256  # partitions of the postings: 64 MB each at some 100 million names
#: rows of a lookup up to which the store is read by the list of their ISINs
LOOKUP_MAX = 1000
_COLUMNS = [f.name for f in schemas.HUB.fields]
_SCHEMA = "gram STRING, isin STRING, share_name STRING, updated_at TIMESTAMP_NTZ, part INT"


def grams(text: Column) -> Column:
    """The distinct trigrams of a text, lower-cased; none if it is shorter."""
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))).otherwise(
        F.array().cast("array<string>"))


class NameIndex:
    """The postings under ``path`` (on shared storage)."""

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def _part(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.parts)).cast("int")

    def add(self, hub_rows: DataFrame) -> None:
        """Post hub rows (isin, share_name, updated_at)."""
        posted = (hub_rows.select(F.explode(grams(F.col("share_name"))).alias("gram"), *_COLUMNS)
                  .withColumn("part", self._part(F.col("gram"))))
        (posted.repartition(F.col("part")).sortWithinPartitions("part", "gram")
         .write.mode("append").partitionBy("part").parquet(self.path))

    def postings(self) -> DataFrame:
        try:
            return self.spark.read.schema(_SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _SCHEMA)

    def _wanted(self, name: str) -> list[tuple[int, str]]:
        """(partition, trigram) of a pattern, by the same expressions as the rows."""
        if len(name) < 3 or any(c in name for c in "%_\\"):
            return []
        found = self.spark.range(1).select(F.explode(grams(F.lit(name))).alias("gram"))
        return [(r.part, r.gram) for r in found.select(self._part(F.col("gram")).alias("part"), "gram").collect()]

    def matches(self, name: str) -> DataFrame | None:
        """Hub rows whose name may contain ``name`` (all that do are among them), or
        None if the pattern can't be looked up."""
        wanted = self._wanted(name)
        if not wanted:
            return None
        by_part: dict[int, list[str]] = {}
        for part, gram in wanted:
            by_part.setdefault(part, []).append(gram)
        hit = reduce(lambda a, b: a | b, ((F.col("part") == p) & F.col("gram").isin(g) for p, g in by_part.items()))
        rows = self.postings().where(F.col("part").isin(list(by_part)) & hit)
        return (rows.groupBy(*_COLUMNS).agg(F.count_distinct("gram").alias("n"))
                .where(F.col("n") == len(wanted)).select(*_COLUMNS))


def narrowed(tables: dict[str, DataFrame], matches: DataFrame, predicate: Column,
             most: int = LOOKUP_MAX) -> dict[str, DataFrame]:
    """The store restricted to the matching instruments: by the list of their ISINs,
    so that all tables skip buckets and row groups, or past ``most`` of them by a
    join of the hub. What is posted but not in the hub (a write that failed) is in
    no result."""
    matches = matches.where(predicate).select("isin")
    isins = [r.isin for r in matches.limit(most + 1).collect()]
    if len(isins) > most:
        return {**tables, "share_isins": tables["share_isins"].join(matches, "isin", "left_semi")}
    return {t: df.where(F.col("isin").isin(isins)) for t, df in tables.items()}
