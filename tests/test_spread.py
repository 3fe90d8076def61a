from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tallyline.functions import text as T
from tallyline.operators import blocks as B
from tallyline.operators import check_sql as CS
from tallyline.operators import lineage as L
from tallyline.operators import lineage_reports as LR
from tallyline.operators import rules as R
from tallyline.registry import inputs as I
from tallyline.registry import script_queries as Q
from tallyline.session import spread
from tallyline.sources.pk_list import parse_pk_lines


@pytest.fixture
def sf(spark, tmp_path):
    rows = spark.range(60_000)
    rows.selectExpr("id AS o_orderkey", "id % 100 AS o_custkey", "'O' AS o_orderstatus").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    rows.where("id < 300").selectExpr("id AS s_suppkey", "id % 25 AS s_nationkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def test_tasks_grow_with_the_rows_and_none_gets_longer(spark, sf):
    scan = I.table(spark, sf, "orders")
    dealt = spread(scan, 5_000)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 12 and max(sizes) < 1.2 * 5_000 and sum(sizes) == 60_000
    assert spread(scan, 1_000_000).rdd.getNumPartitions() == spread(scan).rdd.getNumPartitions() == 4
    assert spread(scan.limit(0), 10).count() == 0


def test_the_corpus_of_scripts_is_dealt_by_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(I, "SCRIPTS_A_TASK", 1_000)
    assert I.scripts(spark, sf).rdd.getNumPartitions() == 60


def test_long_scripts_are_dealt_by_rows(spark, sf):
    found = Q.lineage_linecount_long(spark, sf)
    assert found.rdd.getNumPartitions() == 6
    assert found.where("path = 's7.sql'").first()["targets"] == "DM.L"


PATTERN_CASES = "from a.b xfrom c.d 월from e.f Join g.h _join i.j\nFROM k.l insert into m.n reinsert o.p INSERT q.r with s as (select 1) swith t as ("


def test_word_patterns_stand_at_a_word_boundary(one):
    plain = {
        R.LINECOUNT.sources[0].regex: r"(?i)\b(?:from|join)\s+" + R.NAME_LINECOUNT,
        R.LINECOUNT.targets[0].regex: r"(?i)\binsert\s+(?:into\s+)?" + R.NAME_LINECOUNT,
        R.LINECOUNT.ctes[0].regex: r'(?i)\bwith\s+([\w"]+)\s+as\s*\(',
        R.STD.ctes[0].regex: rf"(?is)\bWITH\s+{R.NAME_STD}\s+AS\s*\(",
        R.STD.targets[-1].regex: rf"(?is)\bDELETE\s+{R.NAME_STD}\s+(?:WHERE|$)",
    }
    for text in (PATTERN_CASES, "delete a where undelete b where DELETE c", "from\njoin from b.c join"):
        for own, want in plain.items():
            assert not own.startswith(("(?i)\\b", "(?is)\\b"))
            found = [one(text, lambda s, p=p: F.regexp_extract_all(s, F.lit(p), F.lit(1))) for p in (own, want)]
            assert found[0] == found[1], (own, text)


def test_comments_are_those_of_the_plain_patterns(one):
    for text in ("", "a", "a -- b\nc", "/* -- */ d", "-- /* x\ny */ z", "a - - / * b", "/* open", "x --", None):
        for style, steps in {
            "scan": ((T.BLOCK_COMMENT, " "),), "std": ((T.BLOCK_COMMENT, " "), (T.LINE_COMMENT_WITH_NEWLINE, " ")),
            "simple": ((T.BLOCK_COMMENT, " "), (T.LINE_COMMENT_KEEP_NEWLINE, " ")), "linecount": ((T.LINE_COMMENT_TO_LINE_END, ""), (T.BLOCK_COMMENT, "")),
        }.items():
            def plain(s, steps=steps):
                for pattern, by in steps:
                    s = F.regexp_replace(s, pattern, by)
                return s
            assert one(text, lambda s, style=style: T.strip_comments(s, style)) == one(text, plain)


def test_a_small_key_list_neither_moves_the_tables_nor_extracts_them_twice(spark):
    scripts = spark.createDataFrame([("a.sql", "insert into DM.T select 1 from DW.A, DW.B")], "path string, raw string").repartition(2)
    lines = spark.createDataFrame([("dw.a, k1, k2", 1)], "line string, _row_order bigint")
    listed = parse_pk_lines(lines)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        found = CS.check_statements(L.extract_tables(scripts), listed, "oracle")
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = found.where("role = 'source'").orderBy("table", "statement_ord").collect()
    finally:
        spark.conf.set(key, before)
    assert "approx_top_k" not in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    # The statements are written once, not again in a filter on their number.
    assert plan.count("group by ") <= 3 * 2
    assert [(r["table"], r["statement_ord"]) for r in rows] == [("DW.A", i) for i in range(1, 7)] + [("DW.B", i) for i in range(1, 6)]
    assert rows[5]["statement"] == "select k1,k2,count(1) from DW.A group by k1,k2 having count(1) > 1;"


BLOCK_CASES = (
    "STEP001 BEGIN a END;", "xSTEP123\n begin step12 BEGIN BEGINS _END end END월 월END BEND ſTEP001 BEGIN END", "select a.b c, d AS e, f.g as h; i AS, j AS (k.  l) x.y.z",
    "월a b from c.`d` x.from e refrom f MERGE INTO g merge\n into h Rename  to i JOIN\tj update k.l; into", "aa.bb. cc..dd  ee as as as f", "STEP001BEGIN a STEP002 BEGINX END END",
    "SELECT " + "w" * 3000 + ", " + "v." * 300 + "u x", "",
)


def test_block_patterns_find_what_the_plain_patterns_find(one):
    name = r"\s+([`\w\.]+)"
    plain = {
        B.BLOCK_TOKEN: (r"(?i)STEP\d{3}\s*BEGIN|\bBEGIN\b|\bEND\b", (0,)),
        B.TABLES[1]: (r"(?i)\b(FROM|JOIN|INTO|UPDATE|MERGE INTO)" + name, (1, 2)),
        B.TABLES[2]: (r"(?i)\b(FROM|JOIN|INTO|UPDATE|MERGE INTO|RENAME TO)" + name, (1, 2)),
        B.TABLES[4]: (r"(?i)\b(FROM|JOIN|INTO|UPDATE|MERGE\s+INTO|RENAME\s+TO)" + name, (1, 2)),
        B.ALIAS_AS: (r"(?i)(\w+(?:\.\w+)*)\s+AS\s+(\w+)", (1, 2)),
        B.ALIAS_ANY: (r"(?i)(\w+(?:\.\w+)*)\s+(?:AS\s+)?(\w+)", (1, 2)),
    }
    for text in BLOCK_CASES:
        def pairs(s):
            return F.array(*[
                F.array(*[F.concat_ws("|", F.regexp_extract_all(s, F.lit(p), F.lit(g))) for p in (own, want)]) for own, (want, groups) in plain.items() for g in groups
            ])
        assert [own for own, want in one(text, pairs) if own != want] == [], text
    assert not any(own.startswith("(?i)\\b") for own in plain)


def test_a_long_word_is_read_once_for_aliases(one):
    """From each of its letters, 300,000 of them are 45,000,000,000 steps."""
    text = "a b;" + "x" * 300_000 + "; c AS d"
    assert one(text, B.block_alias_pairs) == [("b", "a"), ("d", "c")]


REPORTS = (
    Q.step_text_report, Q.lineage_target_map, Q.lineage_source_map, Q.lineage_step_summary, Q.lineage_step_summary_by_path, Q.block_html_report,
)


@pytest.mark.parametrize("query", REPORTS, ids=lambda q: q.__name__)
def test_reports_are_written_by_tasks_told_from_the_rows(spark, tmp_path, monkeypatch, query):
    key = "id - id % 50 DIV 49" if query is Q.block_html_report else "CASE WHEN id > 0 THEN id - id % 50 DIV 49 END"
    orders = spark.range(200).selectExpr(f"{key} AS o_orderkey", "id % 40 AS o_custkey", "'O' AS o_orderstatus")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    few = sorted(map(tuple, query(spark, str(tmp_path)).collect()), key=repr)
    monkeypatch.setattr(I, "SCRIPTS_A_TASK", 20)
    found = query(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 10
    assert sorted(map(tuple, found.collect()), key=repr) == few


def test_rows_of_a_name_with_equal_lists_are_dealt_to_many_tasks(spark):
    rows = spark.range(2_000).selectExpr("concat('p', id) AS path", "'hot.sql' AS name", "array('DW.A', 'DW.B') AS sources", "array('DM.T') AS targets")
    assert list(map(tuple, LR.target_map(rows, tasks=16).collect())) == [("hot.sql", "DM.T", "DW.A; DW.B")]
    assert list(map(tuple, LR._united(rows, ["name"], "sources", "targets", tasks=16).collect())) == [("hot.sql", ["DW.A", "DW.B"], ["DM.T"])]
    plan = LR._united(rows, ["name"], "sources", tasks=16)._jdf.queryExecution().analyzed().toString()
    assert re.search(r"xxhash64\(sources#\d+, path#\d+", plan)
