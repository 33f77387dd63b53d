"""Scratch tables and how tables are read."""

import os

from pyspark.sql import functions as F

from brevis.session import drop_staged, is_scan, plan_bytes, scratch, scratch_dir, spread, staged


def folders(spark):
    """This test's own tables; others may be written to the same folder meanwhile."""
    every = os.listdir(scratch_dir(spark).removeprefix("file://").removeprefix("file:"))
    return {x for x in every if x.startswith("session_test_")}


def test_staged_tables_live_as_long_as_they_are_kept(spark):
    before = folders(spark)
    with scratch() as outer:
        kept = staged(spark.range(3), "session_test_kept")
        with scratch():
            staged(spark.range(3), "session_test_inner")
        outer.keep(kept)
        staged(spark.range(3), "session_test_outer")
    assert [x.rsplit("-", 1)[0] for x in folders(spark) - before] == ["session_test_kept"] and kept.count() == 3
    drop_staged(kept)
    drop_staged(spark.range(1))
    assert folders(spark) == before


def test_staged_folders(spark):
    df = staged(spark.range(10).withColumn("odd", F.col("id") % 2 == 1), "parted", "odd")
    assert sorted(r["id"] for r in df.filter("odd").collect()) == [1, 3, 5, 7, 9]
    assert "PartitionFilters: [isnotnull(odd" in df.filter("odd")._jdf.queryExecution().executedPlan().toString()


def test_scans(spark):
    table = staged(spark.range(1000).withColumn("x", F.col("id") * 2), "scan")
    one = staged(spark.range(1000).coalesce(1), "one")
    assert is_scan(table) and is_scan(table.select("x").filter("x > 3")) and not is_scan(table.repartition(2)) and not is_scan(table.groupBy("x").count())
    assert 0 < plan_bytes(one) < 1 << 20
    wide = spread(one)
    assert not is_scan(wide) and sorted(r["id"] for r in wide.collect()) == list(range(1000))
    assert is_scan(spread(table)) and spread(wide) is wide
