"""Regenerate PLANS.md: physical plan trees of the key operations.

usage: python tools/explain_plans.py [sf_dir]   (default /root/testdata/sf0.01)

Broadcast joins are disabled for the store plans to show the large-table
regime (a real store's tables are far beyond the broadcast threshold).
"""
import datetime as dt
import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from equitylake.session import ensure_checkpoint_dir, get_spark  # noqa: E402


def tree(df) -> str:
    """The operator tree of ``explain('formatted')`` plus, per file scan,
    its bucketing, pushed filters, read schema and selected buckets."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    blocks = text.split("\n\n")
    lines = [line.rstrip() for line in blocks[0].splitlines() if line.strip()]
    keep = ("Bucketed:", "PartitionFilters:", "PushedFilters:", "ReadSchema:", "SelectedBucketsCount:")
    for b in blocks[1:]:
        head = b.strip().splitlines()[0] if b.strip() else ""
        if re.match(r"\(\d+\) Scan parquet", head):
            facts = [ln.strip()[:150] for ln in b.splitlines() if ln.strip().startswith(keep)]
            lines.append(head + ": " + " | ".join(facts))
    return "\n".join(lines)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[4]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    from equitylake.operators import fetchlog as FL
    from equitylake.operators import merge as M
    from equitylake.plans import jobs, views
    from equitylake.plans.layout import Layout
    from equitylake.plans.names import NameIndex
    from equitylake.sources import adapter
    from equitylake.sources.store import Store

    out = ["# Physical plans of the key operations", "",
           f"Generated by `tools/explain_plans.py` on `{os.path.basename(sf)}`; operator trees",
           "of `explain('formatted')` (details omitted). Store plans run with",
           "`spark.sql.autoBroadcastJoinThreshold=-1` (tables beyond broadcast size).", ""]

    def section(title, note, df):
        out.extend([f"## {title}", "", note, "", "```", tree(df), "```", ""])

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    st = Store(spark, tempfile.mkdtemp(prefix="plans-") + "/store", buckets=8)
    st.write(adapter.store(spark, sf))
    t = st.tables()
    section("Current view over the bucketed store",
            "Five bucketed scans, four sort-merge joins, no exchange.", views.current_view(t))
    section("ISIN lookup", "The equality reaches every scan as a pushed filter and prunes "
            "to one bucket per table.",
            views.query_shares(t, views.ShareQuery(isin="MA0000000011")))
    section("Stale set", "Satellite scans read only `isin, updated_at`.",
            views.stale_set(t, dt.timedelta(days=120), dt.datetime(2002, 1, 15)))
    batch = M.collapse_batch(adapter.details_batch(spark, sf), "share_details")
    section("Null-preserving merge, large batch",
            "Only the batch is shuffled (after a partial aggregation); the stored side is a "
            "bucketed scan.", M.merge_satellite(t["share_details"], batch, "share_details"))
    section("Null-preserving merge, size-checked small batch",
            "Broadcast plan: the stored table is scanned, never shuffled.",
            M.merge_satellite(t["share_details"], batch, "share_details", broadcast_batch=True))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # a stored page table, as a crawler leaves it
    pages = jobs._stage(adapter.render_detail_pages(views.current_view(adapter.store(spark, sf))),
                        "plan-pages")
    wide, _, _ = jobs.extract_shares(adapter.hub(spark, sf), pages, dt.datetime(2002, 1, 15),
                                     broadcast_requests=True)
    section("Detail-page extraction (size-checked request set)",
            "Stored pages filtered map-side (broadcast semi join), one Arrow scan (no exchange "
            "between the page scan and `MapInArrow`), the 27 properties assigned by the scan, "
            "typed projection.", wide)
    wide2, _, _ = jobs.extract_shares(adapter.hub(spark, sf), pages, dt.datetime(2002, 1, 15),
                                      broadcast_requests=False)
    section("Detail-page extraction (large request set)",
            "Stored pages filtered by the Bloom filter of the requested URLs (one partial "
            "aggregation, a broadcast of bounded size) below `MapInArrow`; what passes by chance "
            "drops out when the small property rows meet the requests.", wide2)
    index = NameIndex(spark, tempfile.mkdtemp(prefix="plans-") + "/names", parts=16)
    index.add(t["share_isins"])
    section("Name lookup in the trigram index", "Only the partitions of the pattern's trigrams "
            "are read.", index.matches("r#00000001"))
    layout = Layout.write(st)
    section("Due set in the layout by month", "Only the months up to the cut-off are read.",
            layout.due(dt.timedelta(days=120), dt.datetime(2001, 9, 1)))
    section("ISIN prefix in the layout by country", "One country's directory is read.", layout.with_prefix("ma"))
    section("Share write: one judged record per ISIN",
            "One scan of the orders, one aggregation, one join to the hub.",
            M.judge_shares(M.collapse_shares(adapter.share_batch(spark, sf)), adapter.listed_hub(spark, sf)))
    section("Fetch-log resolution", "One partial aggregation per URL (min over structs, "
            "conditional counts).", FL.resolve(adapter.fetch_attempts(spark, sf)))
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(re.sub(r"#\d+", "", line) for line in out))
    print("wrote", path)
    spark.stop()


if __name__ == "__main__":
    main()
