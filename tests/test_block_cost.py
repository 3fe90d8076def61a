"""Reports over blocks: what they cost, held against the plain form of what they do."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallyline.functions import arrays as A
from tallyline.operators import blocks as B
from tallyline.operators.block_reports import html_report, ragged_report

FACTS = (
    "path string, block_ord int, tables array<string>, columns array<string>, conditions array<string>, "
    "aliases array<struct<name:string,value:string>>, errors array<string>"
)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ragged_rows_are_exploded_by_line_number_only(spark):
    facts = spark.createDataFrame(
        [
            ("a", 1, ["t1", "t2"], [], ["c"], [("n", "v"), ("m", "w"), ("o", "x")], ["e"]), ("a", 1, ["t1"], [], [], [], []),
            (None, 2, [], [], [], [], []), ("b", 3, None, ["x"], [], [], []), (None, 4, [], ["y"], [], [], []),
        ],
        FACTS,
    )
    report = ragged_report(facts)
    assert "arrays_zip" not in _plan(report) and "transform(" not in _plan(report)
    assert sorted(map(tuple, report.collect()), key=repr) == sorted([
        ("a", 1, 1, "t1", "", "c", "n -> v", "e"), ("a", 1, 2, "t2", "", "", "m -> w", ""), ("a", 1, 3, "", "", "", "o -> x", ""),
        ("a", 1, 1, "t1", "", "", "", ""), (None, 4, 1, "", "y", "", "", ""),
    ], key=repr)
    assert ragged_report(facts, errors=False).columns == ["path", "block_ord", "line", "table", "column", "condition", "alias"]


def test_each_pattern_of_the_facts_is_tried_once(spark):
    blocks = spark.createDataFrame([("a", 1, "BEGIN SELECT x AS y FROM t; END;")], "path string, block_ord int, content string")
    plan = _plan(B.block_facts(blocks))
    # Eight lists of hits (aliases and their originals, two counts), and none of them again where they are read.
    assert plan.count("regexp_extract_all(") == 8 and plan.count("array_sort(") == 2


def test_last_values_of_short_and_long_lists(spark):
    rng = random.Random(4)
    rows = [(i, [(f"n{rng.randrange(many)}", rng.choice(["v", "w", None, str(j)])) for j in range(size)]) for i, (many, size) in enumerate(
        [(1, 0), (1, 1), (3, 2), (9, 40), (40, 63), (40, 64), (40, 65), (50, 300), (10**6, 64), (10**6, 200)])]
    df = spark.createDataFrame(rows, "i int, p array<struct<name:string,value:string>>")
    want = {i: list(dict(pairs).items()) for i, pairs in rows}
    assert {r["i"]: [tuple(x) for x in r["p"]] for r in A.keep_last_values(df, "p").collect()} == want
    lists = df.select("i", F.col("p")["name"].alias("n"), F.col("p")["value"].alias("v"))
    zipped = A.zip_last_values(lists, "n", "v", "p")
    assert zipped.columns == ["i", "p"]
    assert {r["i"]: [tuple(x) for x in r["p"]] for r in zipped.collect()} == want


WORDS = ("WHERE ", "where\n", " ON ", "on\t", "GROUP BY ", "xgroup by", "group by1", "Order By x", "WHEN", " when ", ";", "\n", "\t", " ", "a", "b.c", "월", "o", "g", "w", "W ", "=")


def test_conditions_are_those_of_the_plain_pattern(spark):
    plain = r"(?is)\b(WHERE|ON)\b\s+(.*?)(\bGROUP BY\b|\bORDER BY\b|;|\n|\bWHEN\b)"
    rng = random.Random(6)
    texts = ["".join(rng.choice(WORDS) for _ in range(rng.randrange(30))) for _ in range(2000)] + ["where " + "go w" * 50_000 + ";", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string").repartition(4)
    found = df.select(
        "s", F.regexp_extract_all("s", F.lit(plain), F.lit(2)).alias("want"), F.regexp_extract_all("s", F.lit(B.CONDITION), F.lit(1)).alias("own"),
        B.block_conditions(F.col("s")).alias("c"),
    )
    rows = found.collect()
    assert [r["s"] for r in rows if r["want"] != r["own"]] == [] and sum(len(r["own"] or []) for r in rows) > 500
    assert not any("\n" in c or "\t" in c for r in rows for c in r["c"] or [])


def test_lists_of_a_page_are_joined_not_written_one_by_one(spark):
    facts = spark.createDataFrame(
        [
            ("a", 2, "S2", ["t1"], ["c", "d"], [], [("n", "v"), ("m", "w")], ["e", "f"]), ("a", 1, "S1", ["t2", "t1"], [], ["x = 1"], [], []),
            ("b", 1, "S1", [], ["c"], [], [], []),
        ],
        FACTS.replace("tables", "step string, tables", 1),
    )
    pages = html_report(facts)
    assert "concat(<li>, lambda" not in _plan(pages)
    content = {r["path"]: r["content"] for r in pages.collect()}
    assert "<li>중복 테이블: t1(2)</li>\n<li>중복 컬럼: </li>\n" in content["a"] and "<li>중복 테이블: </li>\n<li>중복 컬럼: </li>\n" in content["b"]
    assert (
        "<hr><h3>S2</h3>\n<b>테이블:</b><ul>\n<li>t1</li>\n</ul><b>컬럼:</b><ul>\n<li>c</li>\n<li>d</li>\n</ul><b>조건:</b><ul>\n"
        "</ul><b>테이블 변경 추적:</b><ul>\n<li>n → v</li>\n<li>m → w</li>\n</ul><b>오류:</b><ul>\n"
        "<li style='color:red;'>e</li>\n<li style='color:red;'>f</li>\n</ul>\n</body></html>\n"
    ) in content["a"]
