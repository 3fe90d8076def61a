from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyline.operators import compare as C
from tallyline.plans.tables import parse_keys, reconcile_files, result_path


def strings(spark, columns, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


def result(df, *ids):
    return {tuple(r[i] for i in ids): (r["RESULT"], r["DIFF_DETAIL"]) for r in df.collect()}


def people(spark):
    cols = ["ID", "NAME", "AGE"]
    return (
        strings(spark, cols, [("1", "John", "25"), ("2", "Jane", "28"), ("3", "Bob", "35")]),
        strings(spark, cols, [("1", "John", "25"), ("2", "Jane", "30"), ("4", "Alice", "40")]),
    )


def test_single_key(spark):
    a, b = people(spark)
    rows = {r["ID"]: tuple(r) for r in C.compare(a, b, ["ID"]).collect()}
    assert rows == {
        "1": ("1", "John", "25", "MATCHED", ""),
        "2": ("2", "Jane", "28", "MISMATCHED", "AGE: '28' -> '30'"),
        "3": ("3", "Bob", "35", "ONLY_IN_FILE1", ""),
        "4": ("4", "Alice", "40", "ONLY_IN_FILE2", ""),
    }


def test_composite_key(spark):
    cols = ["DATE", "STORE_ID", "PRODUCT", "AMOUNT"]
    a = strings(spark, cols, [
        ("2025-12-01", "S001", "Apple", "100"), ("2025-12-01", "S002", "Banana", "200"), ("2025-12-02", "S001", "Apple", "150"),
    ])
    b = strings(spark, cols, [
        ("2025-12-01", "S001", "Apple", "100"), ("2025-12-01", "S002", "Banana", "250"), ("2025-12-03", "S001", "Orange", "300"),
    ])
    found = {(r["DATE"], r["STORE_ID"]): (r["RESULT"], r["DIFF_DETAIL"], r["AMOUNT"]) for r in C.compare(a, b, cols[:3]).collect()}
    assert found == {
        ("2025-12-01", "S001"): ("MATCHED", "", "100"),
        ("2025-12-01", "S002"): ("MISMATCHED", "AMOUNT: '200' -> '250'", "200"),
        ("2025-12-02", "S001"): ("ONLY_IN_FILE1", "", "150"),
        ("2025-12-03", "S001"): ("ONLY_IN_FILE2", "", "300"),
    }


def test_values_are_trimmed_and_keys_are_not(spark):
    a = strings(spark, ["k", "v"], [("1", "\t a \x01"), ("2", "x")])
    b = strings(spark, ["k", "v"], [("1", "a"), ("2 ", "x")])
    assert result(C.compare(a, b, ["k"]), "k") == {
        ("1",): ("MATCHED", ""), ("2",): ("ONLY_IN_FILE1", ""), ("2 ",): ("ONLY_IN_FILE2", ""),
    }


def test_column_on_one_side_only(spark):
    a = strings(spark, ["k", "v"], [("1", "x"), ("2", "x")])
    b = strings(spark, ["k", "c", "d"], [("1", "  ", "n"), ("2", "y", "")])
    out = C.compare(a, b, ["k"])
    assert out.columns == ["k", "v", "c", "d", "RESULT", "DIFF_DETAIL"]
    assert result(out, "k") == {
        ("1",): ("MISMATCHED", "v: 'x' -> ''; d: '' -> 'n'"),
        ("2",): ("MISMATCHED", "v: 'x' -> ''; c: '' -> 'y'"),
    }


def test_typed_columns_compare_by_text(spark):
    a = spark.sql("SELECT * FROM VALUES (1, CAST(NULL AS INT), 1.50), (CAST(NULL AS INT), 7, 2.00) AS t(k, i, d)")
    b = spark.sql("SELECT * FROM VALUES (1L, 5, 1.5D), (CAST(NULL AS BIGINT), 7, 2.0D) AS t(k, i, d)")
    rows = result(C.compare(a, b, ["k"]), "k")
    assert rows == {
        ("1",): ("MISMATCHED", "i: '' -> '5'; d: '1.50' -> '1.5'"),
        ("",): ("MISMATCHED", "d: '2.00' -> '2.0'"),
    }
    same = C.compare(a, a, ["k"])
    assert {r["RESULT"] for r in same.collect()} == {"MATCHED"}


def test_duplicate_key_is_an_error_naming_side_and_key(spark):
    a, b = people(spark)
    with pytest.raises(C.DuplicateKeyError, match="FILE2: 4"):
        C.compare(a, b.union(b.where("ID = '4'")), ["ID"]).collect()


def test_hot_duplicate_key_is_an_error_and_no_product(spark):
    hot = spark.range(30000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    with pytest.raises(C.DuplicateKeyError, match="FILE1: hot"):
        C.compare(hot, hot.where("k <> 'hot'"), ["k"]).collect()
    with pytest.raises(C.DuplicateKeyError, match="FILE2: hot"):
        C.differing_cells(hot.distinct(), hot, ["k"]).collect()
    assert [tuple(r) for r in C.duplicate_keys(hot, ["k"]).collect()] == [("hot", 10000)]


def test_key_rules(spark):
    a, b = people(spark)
    assert C.resolve_keys(a, b, None) == ["ID"]
    with pytest.raises(ValueError, match="both sides: X"):
        C.compare(a, b, ["X"])
    with pytest.raises(ValueError, match="no key given"):
        C.compare(a, b.drop("ID"))
    by_name = C.compare(a, b, lambda df: [F.lower(df["NAME"])])
    assert result(by_name, "NAME")[("Jane",)] == ("MISMATCHED", "AGE: '28' -> '30'")
    assert parse_keys(" ID, DATE ,") == ["ID", "DATE"] and parse_keys(" ") is None and parse_keys(None) is None
    assert result_path("/x/a.csv") == "/x/result_a.csv" and result_path("a.csv") == "result_a.csv"


def test_invariants(spark):
    a = spark.range(200).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).cast("string").alias("v"))
    b = spark.range(100, 260).select(F.col("id").cast("string").alias("k"), (F.col("id") % 5).cast("string").alias("v"))
    forward = {r[0]: r[1] for r in C.summarize(C.compare(a, b, ["k"])).collect()}
    backward = {r[0]: r[1] for r in C.summarize(C.compare(b, a, ["k"])).collect()}
    assert forward["MATCHED"] == backward["MATCHED"] and forward["MISMATCHED"] == backward["MISMATCHED"]
    assert forward["ONLY_IN_FILE1"] == backward["ONLY_IN_FILE2"] == 100 and forward["ONLY_IN_FILE2"] == 60
    assert sum(forward.values()) == C.key_union(a, b, ["k"]).count() == 260
    assert C.only_left(a, b, ["k"]).count() == 100 and C.only_right(a, b, ["k"]).count() == 60
    assert C.differing_cells(a, b, ["k"]).count() == forward["MISMATCHED"]


def test_wide_tables(spark):
    wide = spark.range(5).select(F.col("id").alias("k"), *[(F.col("id") + i).cast("string").alias(f"c{i}") for i in range(300)])
    other = wide.withColumn("c299", F.lit("z"))
    rows = C.compare(wide, other, ["k"]).collect()
    assert {r["DIFF_DETAIL"].split(":")[0] for r in rows} == {"c299"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_has_one_exchange_per_side(spark):
    a, b = people(spark)
    for frame in (C.compare(a, b, ["ID"]), C.compare(a.selectExpr("cast(ID as int) ID"), b.selectExpr("cast(ID as int) ID"), ["ID"]), C.differing_cells(a, b, ["ID"])):
        plan = plan_of(frame)
        assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Exchange") == 2 and "Join" in plan


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    for name, shift in (("left_side", 0), ("right_side", 5)):
        rows = spark.range(100).select((F.col("id") + shift).alias("k"), F.lit("v").alias("v"))
        rows.write.bucketBy(4, "k").sortBy("k").option("path", str(tmp_path / name)).saveAsTable(name)
    try:
        out = C.compare(spark.table("left_side"), spark.table("right_side"), ["k"], null_keys=False)
        assert "Exchange" not in plan_of(out)
        assert {r[0]: r[1] for r in C.summarize(out).collect()} == {"MATCHED": 95, "ONLY_IN_FILE1": 5, "ONLY_IN_FILE2": 5}
    finally:
        spark.sql("DROP TABLE left_side")
        spark.sql("DROP TABLE right_side")


def test_null_and_empty_keys(spark):
    a, b = strings(spark, ["k", "v"], [(None, "x"), ("1", "y")]), strings(spark, ["k", "v"], [("", "x"), ("1", "z")])
    assert result(C.compare(a, b, ["k"]), "k") == {("",): ("MATCHED", ""), ("1",): ("MISMATCHED", "v: 'y' -> 'z'")}
    with pytest.raises(C.DuplicateKeyError, match="duplicate key on FILE1: "):
        C.compare(a.union(b.where("k = ''")), b, ["k"]).collect()
    with pytest.raises(C.DuplicateKeyError, match="null key on FILE1"):
        C.compare(a, b, ["k"], null_keys=False).collect()
    numbers = spark.createDataFrame([(None, "x"), (0, "y")], "k int, v string")
    assert result(C.compare(numbers, numbers.where("k is null"), ["k"]), "v") == {("x",): ("MATCHED", ""), ("y",): ("ONLY_IN_FILE1", "")}
    assert C.compare(a.limit(0), b, ["k"]).count() == 2


def test_reconcile_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿ID,NAME,NOTE\r\n2,\"x, y\",\r\n1,\"l1\nl2\",n\r\n".encode())
    (tmp_path / "b.csv").write_bytes("ID,NAME,NOTE\r\n1,\"l1\nl2\",m,extra\r\n3,\"q\"\"q\"\r\n".encode())
    out = reconcile_files(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), "ID", multi_line=True)
    assert out.endswith("/result_a.csv")
    parts = sorted(p for p in (tmp_path / "result_a.csv").iterdir() if p.name.startswith("part-"))
    assert b"".join(p.read_bytes() for p in parts).decode() == (
        "ID,NAME,NOTE,RESULT,DIFF_DETAIL\r\n"
        '2,"x, y",,ONLY_IN_FILE1,\r\n'
        "1,\"l1\nl2\",n,MISMATCHED,NOTE: 'n' -> 'm'\r\n"
        '3,"q""q",,ONLY_IN_FILE2,\r\n'
    )


def test_a_repeated_key_is_an_error_whatever_is_asked(spark):
    a = strings(spark, ["k", "v"], [("1", "a"), ("1", "b"), ("2", "c")])
    b = strings(spark, ["k", "v"], [("1", "a"), ("1", "b"), ("1", "c")])
    unique = strings(spark, ["k", "v"], [("1", "a"), ("2", "c")])
    for one, two, side in ((a, b, "FILE[12]"), (a, unique, "FILE1"), (unique, b, "FILE2")):
        for ask in (
            lambda df: df.count(),
            lambda df: df.select("v").collect(),
            lambda df: df.select("RESULT").distinct().collect(),
            lambda df: df.limit(1).collect(),
            lambda df: C.summarize(df).collect(),
        ):
            with pytest.raises(C.DuplicateKeyError, match=f"duplicate key on {side}: 1"):
                ask(C.compare(one, two, ["k"]))
        with pytest.raises(C.DuplicateKeyError):
            C.differing_cells(one, two, ["k"]).count()
    assert C.compare(unique, unique, ["k"]).count() == 2


def test_the_check_for_repeated_keys_adds_no_exchange(spark):
    a = spark.range(10).select("id", F.lit("x").alias("v"))
    plan = C.compare(a, a, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
