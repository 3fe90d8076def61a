from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyline.operators import compare as C
from tallyline.operators import compare_digests as D


def pair(spark, seed=3):
    rng = random.Random(seed)
    rows = {(k, f"s{k % 7}"): (rng.choice([" x", "y\t", None, ""]), k % 5 if k % 11 else None) for k in range(400)}
    other = {key: value for key, value in rows.items() if key[0] % 97}
    for key in list(other)[::83]:
        other[key] = ("changed", 1)
    other |= {(1000, "new"): ("z", 0), (None, "n"): ("z", 0)}
    a = spark.createDataFrame([(*k, *v) for k, v in rows.items()], "id long, part string, v string, n int")
    b = spark.createDataFrame([(*k, (v[0] or "") + "  ", v[1], "") for k, v in other.items()], "id long, part string, v string, n int, extra string")
    return a, b


@pytest.mark.parametrize("buckets", [None, 1, 37, 100_000])
def test_the_result_is_that_of_the_full_comparison(spark, buckets):
    a, b = pair(spark)
    got, want = D.compare_by_digest(a, b, ["id", "part"], buckets=buckets), C.compare(a, b, ["id", "part"])
    assert got.columns == want.columns and got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_only_buckets_that_differ_are_marked(spark):
    a = spark.range(3000).select("id", F.lit("same").alias("v"), F.pmod("id", F.lit(500)).alias("_bucket"))
    b = a.withColumn("v", F.when(F.col("id") == 1234, "other").otherwise(F.col("v"))).where("id <> 77")
    values = [F.col("id"), F.col("v")]
    marks = D.differing_buckets(a, b, values, values)
    told = a.select("_bucket").distinct().crossJoin(marks.select("_marks")).select("_bucket", D._is_marked(F.col("_marks"), F.col("_bucket")).alias("m"))
    assert sorted(r["_bucket"] for r in told.where("m").collect()) == [77, 234]
    assert D.differing_buckets(a, a, values, values).count() == 0


def test_equal_tables_empty_tables_and_other_types(spark):
    a, b = pair(spark)
    assert {r["RESULT"] for r in D.compare_by_digest(a, a, ["id", "part"]).collect()} == {"MATCHED"}
    none = a.limit(0)
    assert D.compare_by_digest(none, none, ["id"]).count() == 0
    only = D.compare_by_digest(none, a, ["id", "part"]).collect()
    assert {r["RESULT"] for r in only} == {"ONLY_IN_FILE2"} and len(only) == 400
    texts = a.select(*[F.col(c).cast("string").alias(c) for c in a.columns])
    assert {r["RESULT"] for r in D.compare_by_digest(a, texts, ["id", "part"]).collect()} == {"MATCHED"}


def test_key_functions_and_row_order(spark):
    a, b = pair(spark)
    fold = lambda df: [F.upper(F.concat_ws("-", df["id"].cast("string"), df["part"]))]
    ordered = [df.withColumn("_row_order", F.xxhash64(*df.columns)) for df in (a, b)]
    got, want = (f(*ordered, fold) for f in (D.compare_by_digest, C.compare))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_repeated_keys(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    b = spark.createDataFrame([(1, "a"), (1, "a"), (2, "c")], "k int, v string")
    with pytest.raises(C.DuplicateKeyError, match="duplicate key on FILE1: 1"):
        D.compare_by_digest(a, b, ["k"]).count()
    assert D.compare_by_digest(a, a, ["k"]).count() == 3
