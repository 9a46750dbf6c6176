"""A second layout of the store's keys, so that a due set or a prefix lookup reads
the files that can match and no others.

``write`` derives two tables from one version of the store: the instruments by the
month of their newest satellite stamp, and by the first two characters of their
lower-cased ISIN (the country), each in a directory per value. Conditions on the
stamp or the prefix become conditions on directories; inside, rows are dealt to
files by range and sorted, so that Parquet's statistics skip the rest of the
last month. A month or country with many instruments is many files.

The layout belongs to the version it was written from (``Layout.write`` after a
refresh or discovery, ``Layout.of`` for reading): of another version there is none,
and callers fall back to the joins.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store
from . import views

_DUE = "isin STRING, share_name STRING, updated_at TIMESTAMP_NTZ, month DATE"
_COUNTRY = "isin STRING, country STRING"
ROWS_PER_FILE = 5_000_000


def _country(isin):
    return F.substring(F.lower(isin), 1, 2)


class Layout:
    """The layout under ``path``."""

    def __init__(self, store: Store, path: str):
        self.spark, self.path = store.spark, path

    @staticmethod
    def _path(store: Store, version: int) -> str:
        return f"{store.root}/_layouts/v={version}"

    @classmethod
    def write(cls, store: Store) -> Layout:
        """Derive the layout of the store's newest version."""
        tables = store.tables()
        path = cls._path(store, int((store.head() or {}).get("version") or 0))
        due = views.last_updates(tables).withColumn("month", F.trunc("updated_at", "month"))
        by_country = tables["share_isins"].select("isin", _country(F.col("isin")).alias("country"))
        for df, order, name in ((due, ["month", "updated_at", "isin"], "due"), (by_country, ["country", "isin"], "isins")):
            (df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite")
               .option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy(order[0]).parquet(f"{path}/{name}"))
        store.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}/done")  # written last
        return cls(store, path)

    @classmethod
    def of(cls, store: Store) -> Layout | None:
        """The layout of the store's newest version, if there is one."""
        layout = cls(store, cls._path(store, int((store.head() or {}).get("version") or 0)))
        try:
            if layout.spark.read.schema("id BIGINT").parquet(f"{layout.path}/done").isEmpty():
                return None
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return layout

    def due(self, min_age: dt.timedelta, as_of: dt.datetime | None = None) -> DataFrame:
        """``views.stale_set``: only the months up to the cut-off are read."""
        cutoff = views.cutoff(min_age, as_of)
        rows = self.spark.read.schema(_DUE).parquet(f"{self.path}/due")
        return (rows.where((F.col("month") <= F.trunc(cutoff, "month")) & (F.col("updated_at") <= cutoff))
                .select("isin", "share_name", "updated_at"))

    def with_prefix(self, prefix: str) -> DataFrame | None:
        """The ISINs that may start with ``prefix`` (any case); None if it is empty or
        a pattern, which can't be looked up."""
        if not prefix or any(c in prefix for c in "%_\\"):
            return None
        low = F.lower(F.lit(prefix))
        rows = self.spark.read.schema(_COUNTRY).parquet(f"{self.path}/isins")
        country = F.col("country")
        return rows.where(country == F.substring(low, 1, 2) if len(prefix) > 1 else country.startswith(low)).select("isin")
