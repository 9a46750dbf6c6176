"""Physical-plan properties the design relies on, checked over stored
Parquet tables with broadcasting disabled (tables too large to ship)."""
import datetime as dt
import re

import pytest

from equitylake.plans import views
from equitylake.sources import adapter
from equitylake.sources.store import Store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    st = Store(spark, str(tmp_path_factory.mktemp("plans") / "s"))
    st.write(adapter.store(spark, SF))
    return st.tables()


def plan(spark, df):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_view_joins_without_shuffle(spark, stored):
    # all five tables are bucketed by isin into the same buckets
    p = plan(spark, views.current_view(stored))
    assert len(re.findall("Exchange hashpartitioning", p)) == 0
    assert len(re.findall("SortMergeJoin", p)) == 4


def test_isin_lookup_reaches_every_scan(spark, stored):
    p = plan(spark, views.query_shares(stored, views.ShareQuery(isin="MA0000000011")))
    scans = re.findall(r"FileScan parquet [^\n]*", p)
    assert len(scans) == 5
    assert all("EqualTo(isin,MA0000000011)" in s for s in scans)
    # and only the one bucket that can hold the ISIN is read
    assert all("SelectedBucketsCount: 1 out of" in s for s in scans)


def test_merge_shuffles_only_the_batch(spark, stored):
    from equitylake.operators import merge as M
    batch = stored["share_details"].limit(5)
    p = plan(spark, M.merge_satellite(stored["share_details"], batch, "share_details"))
    # the stored table's scan feeds the join directly; only the batch moves
    assert len(re.findall("Exchange hashpartitioning", p)) == 1


def test_stale_set_reads_only_stamps(spark, stored):
    p = plan(spark, views.stale_set(stored, dt.timedelta(days=1), dt.datetime(2002, 1, 1)))
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*?>)", p)
    assert sorted(schemas).count("struct<isin:string,updated_at:timestamp_ntz>") == 4


def _partial_before_exchange(p: str) -> bool:
    # physical plans print top-down: the partial aggregate sits below
    # (after) the exchange it feeds
    ex = p.find("Exchange hashpartitioning")
    return ex >= 0 and "partial_" in p[ex:]


def test_keyed_aggregations_combine_map_side(spark):
    """A key holding a third of all rows is reduced in every map task."""
    from pyspark.sql import functions as F
    from equitylake.operators import extract as X
    from equitylake.operators import fetchlog as FL
    from equitylake.operators import merge as M
    hot = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("K"), F.col("id").cast("string"))).alias("isin"),
        F.lit(1.0).alias("id_strumento"), F.lit("c").alias("codice_alfanumerico"),
        F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("updated_at"))
    assert _partial_before_exchange(plan(spark, M.collapse_batch(hot, "share_details")))
    page = spark.createDataFrame([(1, "u", "<table></table>")], "page_id long, url string, html string")
    assert not re.search("Exchange|Sort|Aggregate", plan(spark, X.scan_properties(page)))  # row-local
    log = spark.createDataFrame(
        [("u", 1, 200, False, "b", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1))],
        "url string, attempt_no int, status int, net_error boolean, body string, "
        "started_at timestamp_ntz, ended_at timestamp_ntz")
    assert _partial_before_exchange(plan(spark, FL.resolve(log)))
    found = hot.select("isin", F.lit("n").alias("share_name"), "updated_at")
    assert _partial_before_exchange(plan(spark, M.dedupe_instruments(found)))
    r = M.collapse_batch(hot, "share_details").where("isin = 'HOT'").collect()
    assert len(r) == 1


def test_pages_are_scanned_once(spark):
    from pyspark.sql import functions as F
    from equitylake.plans import jobs
    pages = spark.createDataFrame([(1, "u", "<table></table>")], "page_id long, url string, html string")
    inst = spark.range(3).select(F.format_string("IT%010d", F.col("id")).alias("isin"))
    for bc in (True, False):
        assert plan(spark, jobs.scan_requested(inst, pages, broadcast_requests=bc)).count("MapInArrow") == 1


def test_share_write_reads_orders_at_most_twice(spark):
    from equitylake.plans.catalog import QUERIES
    for name in ("write_metrics", "share_write_accepted", "fk_rejects"):
        text = plan(spark, QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert text.count("o_orderkey") and len(re.findall(r"FileScan parquet [^\n]*o_orderdate", text)) <= 2


def _ancestors(plan_text: str, marker: str) -> list[str]:
    """Operators above the first plan line containing ``marker``."""
    lines = plan_text.splitlines()
    depth = lambda ln: len(ln) - len(ln.lstrip(" :+-"))
    i = next(k for k, ln in enumerate(lines) if marker in ln)
    out, d = [], depth(lines[i])
    for ln in reversed(lines[:i]):
        if depth(ln) < d:
            out.append(ln.strip(" :+-"))
            d = depth(ln)
    return out


def test_html_is_never_shuffled(spark, tmp_path):
    from pyspark.sql import functions as F
    from equitylake.plans import jobs
    from equitylake.sources.pages import detail_url
    p = str(tmp_path / "pages")
    (spark.range(50).select(F.col("id").alias("page_id"),
                            detail_url(F.format_string("IT%010d", F.col("id"))).alias("url"),
                            F.lit("<table></table>").alias("html")).write.parquet(p))
    pages = spark.read.parquet(p)
    inst = spark.range(10).select(F.format_string("IT%010d", F.col("id")).alias("isin"))
    for bc in (True, False):
        plan_text = plan(spark, jobs.scan_requested(inst, pages, broadcast_requests=bc))
        up = _ancestors(plan_text, "html:string")  # the scan that reads the HTML
        scan_to_arrow = up[:next(k for k, op in enumerate(up) if op.startswith("MapInArrow")) + 1]
        assert not any("Exchange" in op for op in scan_to_arrow), (bc, scan_to_arrow)
