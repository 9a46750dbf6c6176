import datetime as dt

from pyspark.sql import functions as F

from equitylake import schemas
from equitylake.operators import merge as M

T0, T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1), dt.datetime(2023, 6, 1)


def details(spark, rows):
    return spark.createDataFrame(rows, schemas.DETAILS)


def as_dict(df):
    return {r.isin: r.asDict() for r in df.collect()}


def test_merge_insert_update_null_preserving(spark):
    stored = details(spark, [("A", 1.0, "x", T0), ("B", 2.0, "y", T0)])
    batch = details(spark, [("A", None, "x2", T1), ("C", 3.0, None, T1)])
    for bc in (False, True):
        out = as_dict(M.merge_satellite(stored, batch, "share_details", broadcast_batch=bc))
        assert out["A"] == {"isin": "A", "id_strumento": 1.0, "codice_alfanumerico": "x2", "updated_at": T1}
        assert out["B"]["codice_alfanumerico"] == "y" and out["B"]["updated_at"] == T0
        assert out["C"] == {"isin": "C", "id_strumento": 3.0, "codice_alfanumerico": None, "updated_at": T1}


def test_older_stamp_still_overwrites(spark):
    stored = details(spark, [("A", 1.0, "x", T1)])
    batch = details(spark, [("A", 5.0, None, T2)])
    out = as_dict(M.merge_satellite(stored, batch, "share_details"))
    assert out["A"]["id_strumento"] == 5.0 and out["A"]["updated_at"] == T2


def test_merge_is_idempotent(spark):
    stored = details(spark, [("A", 1.0, "x", T0), ("B", 2.0, None, T0)])
    batch = details(spark, [("A", None, "z", T1), ("C", 3.0, None, T1)])
    once = M.merge_satellite(stored, batch, "share_details")
    twice = M.merge_satellite(once, batch, "share_details")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_collapse_in_batch_last_non_null(spark):
    batch = details(spark, [("A", 1.0, "a", T0), ("A", None, "b", T1), ("A", 3.0, None, T2)])
    out = as_dict(M.collapse_batch(batch, "share_details"))["A"]
    # order by stamp: T2 (3.0, None), T0 (1.0, 'a'), T1 (None, 'b')
    assert out == {"isin": "A", "id_strumento": 1.0, "codice_alfanumerico": "b", "updated_at": T1}


def test_validate_rejects_block_all_four(spark):
    hub = spark.createDataFrame([("A", "a", T0), ("B", "b", T0)], schemas.HUB)
    payloads = {
        "share_details": details(spark, [("A", 1.0, "x", T1), ("B", 1.0, "y" * 51, T1)]),
        "market_information": spark.createDataFrame(
            [("A", "s", "m", 1.0, 1.0, T1), ("Z", "s", "m", 1.0, 1.0, T1)], schemas.MARKET),
    }
    accepted, rejects = M.validate_shares(payloads, hub)
    assert sorted(r.isin for r in accepted.collect()) == ["A"]
    got = sorted((r.isin, r.table, r.reason) for r in rejects.collect())
    assert got == [("B", "share_details", "codice_alfanumerico_too_long"),
                   ("Z", "share_isins", "unknown_isin")]
    kept = M.accepted_only(payloads["market_information"], accepted, "market_information")
    assert [r.isin for r in kept.collect()] == ["A"]


def test_insert_absent(spark):
    hub = spark.createDataFrame([("A", "a", T0)], schemas.HUB)
    cand = spark.createDataFrame(
        [("A", "other", T1), ("B", "b2", T1), ("B", "b1", T1), ("C", "c" * 51, T1), ("D", "d", T1)],
        "isin string, share_name string, updated_at timestamp_ntz")
    new_rows, outcome = M.insert_absent(hub, cand)
    assert sorted((r.isin, r.share_name) for r in new_rows.collect()) == [("B", "b1"), ("D", "d")]
    reasons = {(r.isin, r.share_name): r.reason for r in outcome.collect()}
    assert reasons[("A", "other")] == "isin_exists"
    assert reasons[("B", "b2")] == "duplicate_isin_in_batch"
    assert reasons[("C", "c" * 51)] == "share_name_too_long"


def test_dedupe_instruments(spark):
    found = spark.createDataFrame([("X1", "n", T1), ("X1", "n", T0), ("X1", "m", T1)],
                                  "isin string, share_name string, updated_at timestamp_ntz")
    got = sorted(map(tuple, M.dedupe_instruments(found).collect()))
    assert got == [("X1", "m", T1), ("X1", "n", T0)]


def test_broadcast_plan_does_not_shuffle_stored(spark):
    stored = details(spark, [("A", 1.0, "x", T0)])
    batch = details(spark, [("A", None, "x2", T1)])
    plan = M.merge_satellite(stored, batch, "share_details", broadcast_batch=True) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_empty_records(spark):
    inst = spark.createDataFrame([("A",)], "isin string")
    r = M.empty_records(inst, "price_data", F.lit(T0)).collect()[0].asDict()
    assert r["isin"] == "A" and r["updated_at"] == T0
    assert all(v is None for k, v in r.items() if k not in ("isin", "updated_at"))


def test_insert_absent_broadcast_plan_same_result(spark):
    hub = spark.createDataFrame([("A", "a", T0)], schemas.HUB)
    cand = spark.createDataFrame([("A", "x", T1), ("B", "b", T1)],
                                 "isin string, share_name string, updated_at timestamp_ntz")
    a = sorted(map(tuple, M.insert_absent(hub, cand)[1].collect()))
    b_new, b_out = M.insert_absent(hub, cand, broadcast_candidates=True)
    assert a == sorted(map(tuple, b_out.collect()))
    plan = b_out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_fits_broadcast_is_byte_bounded(spark):
    df = spark.range(1000).selectExpr("cast(id as string) isin", "id * 1.0 as v")
    assert M.fits_broadcast(df)
    assert not M.fits_broadcast(df, max_bytes=M.approx_row_bytes(df) * 999)
    assert M.fits_broadcast(df, max_bytes=M.approx_row_bytes(df) * 1000)
