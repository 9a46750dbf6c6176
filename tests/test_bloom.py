import datetime as dt

from pyspark.sql import functions as F

from equitylake.operators import bloom
from equitylake.operators import extract as X
from equitylake.plans import jobs
from equitylake.sources.pages import detail_url


def test_no_key_is_lost_and_few_others_pass(spark, monkeypatch):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    rows = spark.range(40_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"),
                                      F.lit(1).alias("block"), F.lit(2).alias("bits"))
    rows = rows.unionByName(spark.createDataFrame([(None, 1, 2)], "key string, block int, bits int"))
    passed = bloom.prefilter(rows, "key", keys.unionByName(spark.createDataFrame([(None,)], "key string")), "key")
    assert passed.columns == rows.columns
    assert passed.join(keys, "key", "left_semi").count() == 20_000
    assert passed.count() < 20_000 * 1.01
    assert bloom.n_blocks(20_000) == 8 and bloom.n_blocks(0) == 1 and bloom.n_blocks(10 ** 12) == bloom.MAX_BLOCKS
    # a filter far too small for its keys lets others pass and loses none
    monkeypatch.setattr(bloom, "MAX_BLOCKS", 1)
    assert bloom.prefilter(rows, "key", keys, "key").join(keys, "key", "left_semi").count() == 20_000
    assert bloom.prefilter(rows, "key", keys.where("false"), "key").count() == 0


def test_filter_is_combined_map_side_and_moves_no_rows(spark):
    keys = spark.range(0, 1000, 1, 4).select(F.col("id").cast("string").alias("key"))
    built = bloom.build(keys, "key", 4)._jdf.queryExecution().executedPlan().toString()
    assert "partial_bitmap_construct_agg" in built
    plan = bloom.might_contain(keys, "key", bloom.build(keys, "key", 4), 4)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_unrequested_pages_are_not_parsed(spark, monkeypatch):
    """Beyond the broadcast budget, too: a counter in the scan sees the requested
    pages and hardly another; the result is the same."""
    isins = spark.range(400).select(F.format_string("IT%010d", F.col("id")).alias("isin"))
    body = F.concat(F.lit("<table><tr><td><strong>Codice Alfanumerico</strong><td><span class='t-text -right'>"),
                    F.col("isin"), F.lit("</span></table>"))
    pages = isins.select(F.xxhash64("isin").alias("page_id"), detail_url(F.col("isin")).alias("url"), body.alias("html"))
    wanted = isins.where(F.substring("isin", 11, 2) < "05").select("isin", F.lit("n").alias("share_name"))
    parsed = spark.sparkContext.accumulator(0)
    scan = X._properties_iter

    def counting(batches):
        def seen():
            for b in batches:
                parsed.add(b.num_rows)
                yield b
        yield from scan(seen())
    monkeypatch.setattr(X, "_properties_iter", counting)
    found = {}
    for small in (True, False):
        before = parsed.value
        wide, _, metrics = jobs.extract_shares(wanted, pages, dt.datetime(2024, 1, 1), broadcast_requests=small)
        found[small] = sorted((r.isin, r.codice_alfanumerico) for r in wide.collect())
        assert wanted.count() == 20 == len(found[small])
        assert 20 <= parsed.value - before <= 24
        assert metrics.first().successful == 20
    assert found[True] == found[False] == sorted((r.isin, r.isin) for r in wanted.collect())
