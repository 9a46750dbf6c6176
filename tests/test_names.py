import datetime as dt
import random

import pytest

from equitylake import schemas
from equitylake.plans import names as N
from equitylake.plans import views
from equitylake.plans.names import NameIndex

T0 = dt.datetime(2024, 1, 1)
NAMES = ["Banca Alfa", "ALFA Romeo", "alfalfa", "Al", "", "Société Générale", "SOCIÉTÉ x", "100% Cotone", "a_b c", "a\\b", "日本株式", None]


def hub(spark, n=150):
    rng = random.Random(2)
    rows = [(f"IT{k:010d}", NAMES[k] or "") for k in range(len(NAMES))]
    rows += [(f"FR{k:010d}", "".join(rng.choices("abAB é", k=rng.randint(0, 12)))) for k in range(n)]
    return spark.createDataFrame([(i, s, T0) for i, s in rows], schemas.HUB)


def store(spark):
    return {"share_isins": hub(spark), **{t: spark.createDataFrame([], schema) for t, schema in schemas.SATELLITES.items()}}


@pytest.mark.parametrize("most", [1000, 1])
def test_lookup_equals_the_scan(spark, tmp_dir, monkeypatch, most):
    monkeypatch.setattr(N.narrowed, "__defaults__", (most,))
    tables = store(spark)
    index = NameIndex(spark, f"{tmp_dir}/names", parts=4)
    index.add(tables["share_isins"].where("isin < 'IT'"))
    index.add(tables["share_isins"].where("isin >= 'IT'"))
    index.add(tables["share_isins"].where("isin = 'IT0000000001'"))  # posted again by a retry
    index.add(spark.createDataFrame([("XX0000000001", "alfa not in the hub", T0)], schemas.HUB))
    rows = tables["share_isins"].collect()
    for name in ("ALFA", "société", "日本株", "aaa", "nothing like it", "é a") if most > 1 else ("alfa", "ab"):
        for lang in (None, "fr"):
            got = views.query_shares(tables, views.ShareQuery(name=name, lang=lang), index).select("isin", "share_name")
            want = [(r.isin, r.share_name) for r in rows
                    if name.lower() in r.share_name.lower() and r.isin.startswith((lang or "").upper())]
            assert sorted(map(tuple, got.collect())) == sorted(want), (name, lang)
    # what the index can't look up is scanned, and an ISIN silences the name
    got = views.query_shares(tables, views.ShareQuery(name="a%lfa"), index).select("share_name").collect()
    assert sorted(r[0] for r in got) == sorted(r.share_name for r in rows if "a" in r.share_name.lower()
                                               and "lfa" in r.share_name.lower()[r.share_name.lower().index("a") + 1:])
    assert views.query_shares(tables, views.ShareQuery(name="alfa", isin="IT0000000003"), index).first().share_name == "Al"
    assert index.matches("al") is None and index.matches("a_lfa") is None and index.matches("a\\b") is None
    assert NameIndex(spark, f"{tmp_dir}/none").matches("alfa").count() == 0


def test_lookup_reads_the_partitions_of_its_trigrams(spark, tmp_dir):
    index = NameIndex(spark, f"{tmp_dir}/names", parts=16)
    index.add(hub(spark))
    df = index.matches("alfa")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    assert "PushedFilters" in plan and "gram" in plan
    assert len({p for p, _ in index._wanted("alfa")}) <= 2
    assert sorted(r.share_name for r in df.collect()) == ["ALFA Romeo", "Banca Alfa", "alfalfa"]
