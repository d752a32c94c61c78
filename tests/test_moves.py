"""What lines of baskets cost: they are made where their basket is, and not at all where a request's product says enough."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from offerloom.operators import basket as B
from offerloom.queries import baskets
from offerloom.registry import Tables
from offerloom.sources import adapters as A


def above_lines(df) -> str:
    """The plan above the place where a basket's lines are made."""
    above, made, _ = df._jdf.queryExecution().executedPlan().toString().partition("Generate posexplode(shop_id")
    assert made
    return above


@pytest.mark.parametrize("name", ["a_02_shop_table", "o_04_coverage_order", "g_08_single_shop", "x_26_hints", "g_07_cheapest_mix", "d_01_compare"])
def test_lines_are_not_moved(spark, small, name):
    assert "Exchange hashpartitioning" not in above_lines(entry.queries()[name](spark, small))


@pytest.mark.parametrize("name", ["g_11_reconcile", "g_12_from_assignments", "g_14_default_selection"])
def test_queries_by_product_make_no_lines(spark, small, monkeypatch, name):
    def none(*_):
        raise AssertionError("made every line")

    for made in ("lines", "dealt_lines", "hits", "dealt_hits"):
        monkeypatch.setattr(baskets, made, none)
    assert entry.queries()[name](spark, small).count() > 0


def test_dealt_lines_are_the_lines(spark, small, tmp_path):
    """With null keys, a request for a product twice and a shop that isn't known."""
    rows = spark.read.parquet(f"{small}/lineitem.parquet").limit(300)
    odd = rows.withColumn("l_partkey", F.when(F.col("l_partkey") % 7 > 0, F.col("l_partkey"))).withColumn("l_suppkey", F.when(F.col("l_suppkey") % 5 > 0, F.col("l_suppkey"))).withColumn("l_orderkey", F.when(F.col("l_orderkey") % 11 > 0, F.col("l_orderkey")))
    odd.union(odd.limit(40)).write.parquet(f"{tmp_path}/lineitem.parquet")
    t = Tables(spark, str(tmp_path))
    assert sorted(map(str, A.dealt_lines(t).collect())) == sorted(map(str, A.lines(t).collect()))
    want = baskets.hits(t).join(A.requests(t).select("basket_id", "query_index", "quantity"), ["basket_id", "query_index"])
    got = baskets.dealt_hits(t).where("basket_id IS NOT NULL").select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_many_shops_are_joined_without_a_broadcast(spark, monkeypatch):
    shops = spark.createDataFrame([(1, "a", 0), (2, "b", 9)], "shop_id long, shop_name string, tier_set int")
    tiers = spark.createDataFrame([(0, 0, 0, None, 5)], "tier_set int, pos int, min_value long, max_value long, cost long")
    df = spark.createDataFrame([(1,), (2,), (3,)], "shop_id long")
    few = sorted(map(str, B.with_tiers(df, shops, tiers).collect()))
    monkeypatch.setattr(B, "BROADCAST_SHOPS", 1)
    assert sorted(map(str, B.with_tiers(df, shops, tiers).collect())) == few
