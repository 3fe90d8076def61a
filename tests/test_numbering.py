from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallyline.operators import lineage_reports as LR
from tallyline.operators.blocks import block_facts, split_nested_blocks
from tallyline.operators.block_reports import _duplicates_text, html_report
from tallyline.operators.lineage_reports import bounded_pieces, step_report_lines, step_summary_pieces
from tallyline.operators.numbering import number_rows
from tallyline.operators.steps import step_rows


def test_numbers_follow_the_order_over_many_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(50), i, rng.choice([None, "x"])) for i in range(5000)]
    found = number_rows(spark.createDataFrame(rows, "a int, b int, _x string").repartition(7), ["a", "b"])
    assert found.columns == ["a", "b", "_x", "line"]
    got = sorted((r["line"], r["a"], r["b"]) for r in found.collect())
    assert got == [(i + 1, a, b) for i, (a, b, _) in enumerate(sorted(rows, key=lambda r: r[:2]))]
    assert sorted(r["line"] for r in found.collect()) == list(range(1, 5001))


def test_ties_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([(None,), (2,), (2,), (1,)], "k int")
    assert sorted((r["line"], r["k"]) for r in number_rows(rows, ["k"], "n").withColumnRenamed("n", "line").collect()) == [(1, None), (2, 1), (3, 2), (4, 2)]
    assert number_rows(rows.limit(0), ["k"]).count() == 0


def test_duplicates_are_counted_within_the_array(spark):
    values = ["b", "a", "b", "c", "a", "a", "d", "c"]
    texts = spark.createDataFrame([(values,), ([],), (["x"],)], "v array<string>").select(_duplicates_text(F.col("v")).alias("t"))
    assert [r["t"] for r in texts.collect()] == ["a(3), b(2), c(2)", "", ""]


def test_pages_come_from_one_grouping(spark):
    scripts = spark.createDataFrame([("a.sql", "a.sql", "BEGIN SELECT 1 FROM t; END;")], "path string, name string, raw string")
    plan = html_report(block_facts(split_nested_blocks(scripts), 4), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_pieces_are_bounded_and_make_up_the_whole(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 40}", i, "".join(rng.choice("ab\n é") for _ in range(rng.choice([0, 1, 9, 10, 11, 95])))) for i in range(400)]
    got = bounded_pieces(spark.createDataFrame(rows, "k string, i int, value string").repartition(5), "k", ["i"], most=10).collect()
    assert max(len(r["value"]) for r in got) <= 10
    for key in {k for k, _, _ in rows}:
        own = sorted((r["piece"], r["value"], r["last"]) for r in got if r["k"] == key)
        assert [p for p, _, _ in own] == list(range(1, len(own) + 1))
        assert "".join(v + ("\0" if last else "") for _, v, last in own) == "".join(v + "\0" for k, _, v in rows if k == key)


def test_one_name_for_all_scripts_is_no_large_row(spark):
    body = "/* STEP001 */ INSERT INTO dw.t{0} SELECT * FROM dw.s{0}; /* STEP002 */ DELETE FROM dw.u{0};"
    scripts = spark.createDataFrame([(f"d{i}/job.sql", "job.sql", body.format(i)) for i in range(300)], "path string, name string, raw string")
    rows = step_rows(scripts)
    pieces = step_summary_pieces(rows, most=1000).collect()
    assert {r["file_name"] for r in pieces} == {"job.sql"} and max(len(r["value"]) for r in pieces) <= 1000
    whole = "".join(r["value"] + ("\n" if r["last"] else "") for r in sorted(pieces, key=lambda r: r["piece"]))
    lines = step_report_lines(rows).orderBy("file_name", "path", "step_ord").collect()
    assert whole == "".join(r["value"] + "\n" for r in lines) and len(lines) == 600 and len(whole) > 100_000


def test_texts_are_made_once_and_not_to_find_the_ranges(spark, tmp_path):
    """Ranges are told from a first run over the rows, which made every text a second time."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(i):
        made.add(1)
        return "x" * (i % 30)

    rows = spark.range(500).selectExpr("concat('k', id % 7) AS k", "id AS i").repartition(3)
    write = lambda dealt: dealt.select("k", "i", costly("i").alias("value"))
    got = bounded_pieces(rows, "k", ["i"], most=10, write=write, tasks=9)
    assert made.value == 500
    pieces = sorted(((r["k"], r["piece"], r["value"], r["last"]) for r in got.collect()))
    want = sorted(((r["k"], r["piece"], r["value"], r["last"]) for r in bounded_pieces(write(rows), "k", ["i"], most=10).collect()))
    assert pieces == want and len(pieces) > 900


def test_the_texts_of_steps_are_written_in_the_ranges(spark, monkeypatch):
    """The rows that are dealt out hold tables; their texts come after."""
    seen = []
    plain = LR.number_rows
    monkeypatch.setattr(LR, "number_rows", lambda df, *a, **k: seen.append((df.columns, k["tasks"])) or plain(df, *a, **k))
    scripts = spark.createDataFrame([("d/job.sql", "job.sql", "/* STEP001 */ INSERT INTO dw.t1 SELECT * FROM dw.s1;")], "path string, name string, raw string")
    assert step_summary_pieces(step_rows(scripts), tasks=6).count() == 1
    assert seen[0][1] == 6 and "value" not in seen[0][0] and {"sources", "targets"} <= set(seen[0][0])
