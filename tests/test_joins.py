from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyline.operators import joins as J


@pytest.fixture
def shuffled(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield spark
    spark.conf.set(key, before)


def sides(spark, n=6000):
    """Two in five rows have one key, one in ten has none, one in fifty is the same row."""
    rng = random.Random(7)
    keys = ["hot" if (x := rng.random()) < 0.4 else None if x < 0.5 else f"k{rng.randrange(3000)}" for _ in range(n)]
    rows = [(i if i % 50 else 0, k) for i, k in enumerate(keys)]
    listed = [("hot", "H")] + [(f"k{i}", f"v{i}") for i in range(0, 4000, 3)] + [(None, "none")]
    return rows, listed, spark.createDataFrame(rows, "id int, key string").repartition(4), spark.createDataFrame(listed, "key string, value string")


def test_heavy_keys_are_those_of_many_rows(spark):
    rows, _, left, _ = sides(spark)
    assert [tuple(r) for r in J.heavy_keys(left, "key").collect()] == [("hot", True)]
    even = spark.range(5000).select((F.col("id") % 2000).alias("key"))
    assert J.heavy_keys(even, "key").count() == 0 and J.heavy_keys(even.limit(0), "key").count() == 0
    steps = spark.range(100_000).select(F.expr("cast(log2(id + 1) as int)").alias("key"))
    want = {k for k, n in Counter((i + 1).bit_length() - 1 for i in range(100_000)).items() if n * J.HEAVY_SHARE > 100_000}
    assert {r["key"] for r in J.heavy_keys(steps, "key").collect()} == want


def test_a_skewed_join_gives_every_row_once(shuffled):
    rows, listed, left, right = sides(shuffled)
    found = J.skewed_lookup(left, right, "key")
    values = dict(listed[:-1])
    assert sorted(map(repr, (tuple(r[c] for c in ("id", "key", "value")) for r in found.collect()))) == sorted(repr((i, k, values.get(k))) for i, k in rows)


def test_only_heavy_keys_are_copied_and_no_task_has_them_all(shuffled):
    _, listed, left, right = sides(shuffled)
    plan = J.skewed_lookup(left, right, "key")
    tracker = shuffled.sparkContext.statusTracker()
    shuffled.sparkContext.setJobGroup("plan", "plan")
    J.skewed_lookup(left, right, "key")
    assert not tracker.getJobIdsForGroup("plan")
    shuffled.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    shuffled.conf.set("spark.sql.adaptive.enabled", "false")
    shuffled.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        sizes = [r["n"] for r in J.skewed_lookup(left, right, "key").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        shuffled.conf.set("spark.sql.adaptive.enabled", "true")
        shuffled.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 6000 and max(sizes) < 0.25 * 6000
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in text


def test_a_small_list_is_sent_without_a_sketch(spark):
    _, _, left, right = sides(spark)
    found = J.skewed_lookup(left, spark.createDataFrame([("hot", 1)], "key string, v int").coalesce(1), "key")
    assert found.where("v = 1").count() == left.where("key = 'hot'").count()
    assert J.broadcasts_itself(spark.range(10)) and not J.broadcasts_itself(spark.range(10**9))
    assert "approx_top_k" not in J.skewed_lookup(left, spark.range(3).selectExpr("cast(id as string) as key"), "key")._jdf.queryExecution().optimizedPlan().toString()
