from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyline.functions import names as N
from tallyline.functions.arrays import keep_last_values
from tallyline.operators import block_reports as BR
from tallyline.operators import blocks as B
from tallyline.operators import lineage as L
from tallyline.operators import lineage_reports as LR
from tallyline.operators import steps as S
from tallyline.plans import scripts as jobs

SAMPLE = """-- STEP001
BEGIN
    INSERT INTO MART.`주문합계` (day, total)
    SELECT o.day, SUM(o.amount) AS total FROM RAW.ORDER_LINES o GROUP BY o.day;
END;

-- STEP002
BEGIN
    MERGE INTO MART.`고객명부` c USING RAW.`신규고객` n ON c.no = n.no
    WHEN NOT MATCHED THEN INSERT (no) VALUES (n.no);
END;

/* STEP003 */
BEGIN
    UPDATE MART.`주문합계` SET closed = 1
    WHERE day IN (SELECT h.day FROM RAW.`휴일달력` h);
END;
"""

CTE = """/* STEP005 */
BEGIN
    INSERT INTO MART.`창고요약`
    WITH `대상` AS (
        SELECT no, name FROM RAW.`점포` p WHERE p.open = 1
    ), HOLDINGS AS (
        SELECT no FROM RAW.`창고재고`
    )
    SELECT no FROM `대상`
END;"""


def tables(spark, sql, rules="std"):
    frame = spark.createDataFrame([("a.sql", sql)], "path string, raw string")
    row = L.sorted_tables(L.extract_tables(frame, rules)).first()
    return row["sources"], row["targets"]


STD_CASES = {
    "sample": (SAMPLE, ["RAW.ORDER_LINES", "RAW.`신규고객`", "RAW.`휴일달력`"], ["MART.`고객명부`", "MART.`주문합계`"]),
    "cte": (CTE, ["RAW.`점포`", "RAW.`창고재고`"], ["MART.`창고요약`"]),
    "merge": ("merge into MART.재고현황 s using RAW.입고 i on s.no = i.no", ["RAW.입고"], ["MART.재고현황"]),
    "comma": (
        "insert into MART.`배송` select 1\nfrom RAW.`주문` o,\n  RAW.`택배사` t where o.t = t.no;",
        ["RAW.`주문`", "RAW.`택배사`"], ["MART.`배송`"],
    ),
    "quirks": (
        "DELETE FROM a.b WHERE x=1; DELETE c.d WHERE 1=1; select extract(day from ts) from `p`.`q`; select * from withdraw.x, y.z where 1",
        ["a.b", "ts", "withdraw.x"], ["a.b", "c.d"],
    ),
    "joins": (
        "select * from a1 left outer join b1 on 1 inner join c1 on 1 right join d1 on 1 cross join e1, f1 group by 1",
        ["a1", "b1", "c1", "d1", "e1"], [],
    ),
    "comments": ("select 1 from t1 -- from t2\n/* from t3\n */ join t4 -- x", ["t1", "t4"], []),
    "keywords and short names": ("from select x, from a, from dual, update set", ["dual"], []),
    "quoted FROM": ("select 'x from q1, q2 where' from r1, r2 where 1", ["q1", "r1", "r2"], []),
    # A list is cut at every comma, so the rest of a quoted name counts as a name of its own.
    "comma in backticks": ("from `a,bb`, cc where", ["`a,bb`", "bb", "cc"], []),
    "join first": ("from join aa, bb where", ["aa", "bb"], []),
    "empty": ("", [], []),
}


@pytest.mark.parametrize("name", STD_CASES)
def test_std_lineage(spark, name):
    sql, sources, targets = STD_CASES[name]
    assert tables(spark, sql) == (sources, targets)


def test_comma_join_clauses_outside_quotes(one):
    text = "select 'x FROM aa, bb WHERE' from cc, dd where 1; from ee, ff"
    assert one(text, L.comma_join_clauses) == ["cc, dd", "ee, ff"]
    # The first part of the second clause starts with a bracket and gives no name.
    assert one("from a1 join b1, c1; from (d1, e1) where", L.comma_join_tables) == ["a1", "e1"]


def test_long_clause_does_not_overflow(one):
    words = ", ".join(f"t{i} x{i}" for i in range(20000))
    assert len(one(f"select 1 from {words}", L.comma_join_tables)) == 20000


SCAN_CASES = [
    ("SELECT * FROM schema1.table1", ["schema1.table1"], []),
    ("INSERT INTO target_table SELECT * FROM source_table", ["source_table"], ["target_table"]),
    ("UPDATE target_table SET c = 1 WHERE id IN (SELECT id FROM source_table)", ["source_table"], ["target_table"]),
    ("DELETE FROM t1 WHERE 1=1", ["t1"], ["t1"]),
    ("MERGE INTO tgt USING src ON 1=1 WHEN MATCHED THEN UPDATE SET a = 1", [], ["SET", "tgt"]),
    ("SELECT * FROM a JOIN dw.`b c` ON 1 -- FROM kept", ["a", "dw.`b c`", "kept"], []),
    ("SELECT * FROM /* x */ aa, bb", ["aa"], []),
]


@pytest.mark.parametrize(("sql", "sources", "targets"), SCAN_CASES)
def test_scan_lineage(spark, sql, sources, targets):
    assert tables(spark, sql, "scan") == (sources, targets)


def test_simple_lineage(spark):
    sql = "INSERT INTO [a b].t1 SELECT * FROM \"x\" . y JOIN `가 나`.다 -- FROM no\nDELETE FROM z;"
    assert tables(spark, sql, "simple") == (['"x"', "`가", "z"], ["[a", "z"])


def test_linecount_lineage(spark):
    sql = "with c1 as (select 1 from \"dw\".t1)\r\ninsert tgt select * from c1 join dual, wh_x.y join dba_table using a.b; insert into `q` -- from n.o"
    assert tables(spark, sql, "linecount") == (["A.B", "DBA_TABLE", "DW.T1"], ["INTO", "TGT"])


def test_stats(spark):
    row = L.extract_stats(spark.createDataFrame([("select  * from `a.b-c` join d -- from e",)], "raw string")).first()
    assert (row["tables"], row["uses_select_all"]) == (["a.b-c", "d", "e"], True)


@pytest.mark.parametrize(
    ("expression", "text", "expected"),
    [
        (N.upper_name, ' "dw".t1 ', "DW.T1"),
        (N.table_key, " dw.`a` ", "DW.A"),
        (N.base_name, "a.b.`c`", "c"),
        (N.quote_hangul, "DW.카드", "`DW.카드`"),
        (N.quote_hangul, "DW.`카드`", "DW.`카드`"),
        (N.quote_hangul, "DW.CARD", "DW.CARD"),
        (lambda c: N.date_column(c, "oracle"), "DM.월.일별", "파티션일자"),
        (lambda c: N.date_column(c, "oracle"), "DM.월별", "기준년월"),
        (lambda c: N.date_column(c, "bq"), "DM.월별", "기준일자"),
    ],
)
def test_names(one, expression, text, expected):
    assert one(text, expression) == expected


def test_last_value_first_place(spark):
    pairs = [("b", "1"), ("a", "2"), ("b", "3"), ("c", "4"), ("a", "5")]
    df = spark.createDataFrame([(pairs,), ([],)], "p array<struct<name:string,value:string>>")
    out = [[tuple(x) for x in r["p"]] for r in keep_last_values(df, "p").collect()]
    assert out == [[("b", "3"), ("a", "5"), ("c", "4")], []]


# --- steps -----------------------------------------------------------------------------


def sample(spark, *extra):
    return spark.createDataFrame([("d/sample.sql", "sample.sql", SAMPLE), *extra], "path string, name string, raw string")


def test_steps(spark):
    rows = S.step_tables(sample(spark)).orderBy("step_ord").collect()
    assert [(r["step_ord"], r["step"], r["sources"], r["targets"]) for r in rows] == [
        (1, "STEP001", ["RAW.ORDER_LINES"], ["MART.`주문합계`"]),
        (2, "STEP002", ["RAW.`신규고객`"], ["MART.`고객명부`"]),
        (3, "STEP003", ["RAW.`휴일달력`"], ["MART.`주문합계`"]),
    ]
    assert S.count_steps(sample(spark)).first()["steps"] == 3
    assert [tuple(r)[-2:] for r in S.step_counts(S.step_tables(sample(spark))).collect()] == [(1, 1)] * 3
    assert S.tables_of_step(sample(spark), "STEP002").first()["targets"] == ["MART.`고객명부`"]


def test_repeated_and_empty_steps(spark):
    raw = "head -- STEP1\nfrom aa --step2 \n -- Step1\nfrom bb /* STEP3 */ "
    rows = S.split_steps(spark.createDataFrame([("p", raw)], "path string, raw string")).orderBy("step_ord").collect()
    assert [tuple(r) for r in rows] == [("p", 1, "STEP1", "from bb")]
    assert S.count_steps(spark.createDataFrame([(raw,)], "raw string")).first()["steps"] == 2


def test_step_summary_merges_same_names(spark):
    df = sample(spark, ("e/sample.sql", "sample.sql", "-- STEP9\nfrom zz"), ("n.sql", "n.sql", "select 1"))
    rows = {r["file_name"]: r for r in LR.step_summary(S.step_rows(df)).collect()}
    bar = "=" * 60
    assert rows["n.sql"]["steps"] == "" and rows["n.sql"]["total_steps"] == 0
    assert rows["sample.sql"]["total_steps"] == 4
    assert rows["sample.sql"]["source_tables"] == "RAW.ORDER_LINES; RAW.`신규고객`; RAW.`휴일달력`; zz"
    assert rows["sample.sql"]["steps"].endswith(
        f"\n\n\n{bar}\nSTEP9\n{bar}\n[Source Tables]\nzz\n\n[Target Tables]\n(No target tables)\n"
    )
    by_path = {r["file_name"]: r["total_steps"] for r in LR.step_summary(S.step_rows(df), key="path").collect()}
    assert by_path == {"d/sample.sql": 3, "e/sample.sql": 1, "n.sql": 0}


def test_step_report_pieces_are_the_csv_records(spark):
    from tallyline.functions.text import csv_line

    quoted = 'from "x" , t2'
    df = sample(
        spark, ("e/sample.sql", "sample.sql", f"-- STEP9\n{quoted}\n--STEP1\nupdate zz"),
        ("n1/n.sql", "n.sql", "select 1"), ("n2/n.sql", "n.sql", "-- STEP1 "), ("o/m.sql", "m.sql", ""), ("p/m.sql", "m.sql", "-- STEP1\nfrom q1"),
    )
    for key in ("name", "path"):
        pieces = LR.step_report_lines(S.step_rows(df), key).orderBy("file_name", "path", "step_ord").collect()
        records = LR.step_summary(S.step_rows(df), key).orderBy("file_name")
        whole = records.select(csv_line(*[F.col(c) for c in records.columns]).alias("v")).collect()
        assert "\n".join(r["value"] for r in pieces) == "\n".join(r["v"] for r in whole)


def test_step_files(spark):
    bar = "=" * 60
    df = spark.createDataFrame([("p.sql", "p.sql", "-- STEP1\nfrom zz join aa\n-- STEP2\nupdate t1")], "path string, name string, raw string")
    text = LR.step_files(S.step_rows(df)).first()["content"]
    assert text == (
        f"{bar}\nSTEP1\n{bar}\n\n[Source Tables]\naa\nzz\n\n[Target Tables]\n(No target tables)\n\n"
        f"{bar}\nSTEP2\n{bar}\n\n[Source Tables]\n(No source tables)\n\n[Target Tables]\nt1\n\n"
    )
    assert f"{bar}\n STEP1\n{bar}\n\n[Source Tables]\nzz\naa\n" in LR.step_files(S.step_rows(df), style="console").first()["content"]


# --- maps ------------------------------------------------------------------------------


def test_maps_merge_scripts_of_one_name(spark):
    found = spark.createDataFrame(
        [("x/a.sql", "a.sql", ["s1", "s2"], ["t2"]), ("y/a.sql", "a.sql", ["s1"], ["t1", "t2"]), ("b.sql", "b.sql", ["s1"], [])],
        "path string, name string, sources array<string>, targets array<string>",
    )
    assert sorted(map(tuple, LR.source_map(found).collect())) == [
        ("a.sql", "s1", "t1; t2"), ("a.sql", "s2", "t2"), ("b.sql", "s1", ""),
    ]
    assert sorted(map(tuple, LR.target_map(found).collect())) == [("a.sql", "t1", "s1"), ("a.sql", "t2", "s1; s2")]
    assert LR.source_map(found, key="path").count() == 4
    assert tuple(LR.lineage_counts(found).first()) == (3, 2, 2)
    assert sorted(r[0] for r in LR.distinct_sources(found).collect()) == ["s1", "s2"]


def test_hot_source_and_hot_name(spark):
    found = spark.range(9000).select(
        F.concat(F.lit("p"), "id").alias("path"),
        F.when(F.col("id") % 3 == 0, "hot.sql").otherwise(F.concat("id", F.lit(".sql"))).alias("name"),
        F.array(F.lit("DW.CAL"), F.concat(F.lit("s"), (F.col("id") % 10).cast("string"))).alias("sources"),
        F.array(F.concat(F.lit("t"), (F.col("id") % 100).cast("string"))).alias("targets"),
    )
    row = LR.source_map(found).where("program = 'hot.sql' AND source_table = 'DW.CAL'").first()
    assert len(row["target_tables"].split("; ")) == 100


# --- blocks ----------------------------------------------------------------------------

NESTED = "STEP001 BEGIN select 1; BEGIN insert into t; END; END;\nSTEP002\nBEGIN merge x END"


def blocks(spark, raw, split=B.split_nested_blocks):
    return split(spark.createDataFrame([("f.sql", raw)], "path string, raw string"))


def test_nested_blocks(spark):
    rows = blocks(spark, NESTED).orderBy("block_ord").collect()
    assert [(r["step"], r["content"]) for r in rows] == [
        ("STEP001", "select 1; BEGIN insert into t; END; END"), ("STEP002", "merge x END"),
    ]


def test_nested_block_edges(spark):
    raw = "END step001 begin a STEP002 BEGIN b end c STEP003BEGIN d End e END STEP004 BEGIN BEGIN END STEP005 BEGINNER x END"
    rows = blocks(spark, raw).orderBy("block_ord").collect()
    assert [(r["step"], r["content"]) for r in rows] == [
        ("step001", "a STEP002 BEGIN b end c STEP003BEGIN d End"),
        ("STEP002", "b end"),
        ("STEP003", "d End"),
        ("STEP004", "BEGIN END STEP005 BEGINNER x END"),
        ("STEP005", "NER x END"),
    ]


def test_flat_blocks(spark):
    rows = blocks(spark, "STEP001 BEGIN a END STEP002 BEGIN  END STEP001 BEGIN b APPEND", B.split_flat_blocks).collect()
    assert [(r["block_ord"], r["step"], r["content"], r["valid"]) for r in rows] == [
        (1, "STEP001", "b APP", True), (2, "STEP002", "", False),
    ]


MERGE_SCRIPT = """STEP001
BEGIN
INSERT INTO `project.dataset.target_table`
SELECT * FROM `project.dataset.source_table`;
END;
STEP002
BEGIN
MERGE INTO project.dataset.another_target AS T
USING project.dataset.another_source AS S
ON T.id = S.id
WHEN MATCHED THEN UPDATE SET T.name = S.name;
END;
"""


def test_html_report_v3(spark):
    page = BR.html_report(B.block_facts(blocks(spark, MERGE_SCRIPT), 3), 3).first()["content"]
    assert page == (
        "<html><head><meta charset='UTF-8'><title>분석 결과</title></head><body>\n<h1>BigQuery 분석 리포트</h1>\n"
        "<h2>요약</h2><ul>\n<li>STEP 수: 2</li>\n<li>총 테이블 수: 4</li>\n<li>총 컬럼 수: 2</li>\n<li>총 조건절 수: 1</li>\n"
        "<li>발견된 오류 수: 4</li>\n</ul>\n"
        "<hr><h3>STEP001</h3>\n<b>테이블:</b><ul>\n<li>project.dataset.target_table</li>\n<li>project.dataset.source_table</li>\n"
        "</ul><b>컬럼:</b><ul>\n<li>*</li>\n</ul><b>조건:</b><ul>\n</ul><b>테이블 변경 추적:</b><ul>\n</ul><b>오류:</b><ul>\n"
        "<li style='color:red;'>BEGIN-END 블록 수 불일치</li>\n<li style='color:red;'>END 구문 뒤에 세미콜론 없음</li>\n</ul>\n"
        "<hr><h3>STEP002</h3>\n<b>테이블:</b><ul>\n<li>project.dataset.another_target</li>\n<li>SET</li>\n"
        "</ul><b>컬럼:</b><ul>\n<li>T.name</li>\n</ul><b>조건:</b><ul>\n<li>T.id = S.id</li>\n"
        "</ul><b>테이블 변경 추적:</b><ul>\n<li>T → project.dataset.another_target</li>\n<li>S → project.dataset.another_source</li>\n"
        "</ul><b>오류:</b><ul>\n<li style='color:red;'>BEGIN-END 블록 수 불일치</li>\n<li style='color:red;'>END 구문 뒤에 세미콜론 없음</li>\n"
        "</ul>\n</body></html>\n"
    )


def test_block_facts_by_version(spark):
    raw = "STEP001 BEGIN SELECT a, , `b` FROM t1 x WHERE c = 1\tAND d\n SELECT e FROM t2; UPDATE t3 SET f = 1, = 2, g=3 WHERE x; END;"
    v4, v2 = (B.block_facts(blocks(spark, raw), v).first() for v in (4, 2))
    assert v4["columns"] == ["a", "b", "e", "f", "", "g"] and v2["columns"] == ["a", "", "b", "f", "g"]
    assert v4["tables"] == ["t1", "t2", "t3"] and v4["conditions"] == ["c = 1 AND d", "x"]
    assert v4["errors"] == ["BEGIN-END 블록 수 불일치(0/1)", "END 구문 뒤에 세미콜론 없음"] and v2["aliases"] == []
    assert (v4["begin_count"], v4["end_count"]) == (0, 1)


def test_block_reports(spark):
    facts = B.block_facts(blocks(spark, MERGE_SCRIPT + "STEP003 BEGIN SELECT T.name FROM SET, x; END"))
    rows = BR.ragged_report(facts).where("block_ord = 1").orderBy("line").collect()
    assert [(r["table"], r["column"]) for r in rows][:2] == [("project.dataset.target_table", "*"), ("project.dataset.source_table", "")]
    assert tuple(BR.block_totals(facts).first())[:2] == (3, 5)
    assert [tuple(r)[:3] for r in BR.block_duplicates(facts, "tables").collect()] == [("f.sql", "SET", 2)]
    page = BR.html_report(facts).first()["content"]
    assert "<li>중복 테이블: SET(2)</li>" in page and "<li>중복 컬럼: T.name(2)</li>" in page


# --- jobs ------------------------------------------------------------------------------


def corpus(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "sample.sql").write_text(SAMPLE, encoding="utf-8")
    (root / "sub" / "cte.sql").write_text(CTE, encoding="utf-8")
    (root / "sub" / "other.SQL").write_text("select 1 from zz", encoding="utf-8")
    (root / "note.txt").write_text("INSERT a\nvs_jb_step = vs_jb_step +1;\n", encoding="utf-8")
    return root


def text_of(folder):
    return b"".join(p.read_bytes() for p in sorted(folder.glob("part-*"))).decode("utf-8")


def test_lineage_job(spark, tmp_path):
    jobs.lineage_job(spark, str(corpus(tmp_path)), str(tmp_path / "out"))
    out = tmp_path / "out"
    assert (out / "sub" / "cte_sql_tables.txt").read_text(encoding="utf-8") == (
        "[Source Tables]\nRAW.`점포`\nRAW.`창고재고`\n\n[Target Tables]\nMART.`창고요약`\n"
    )
    assert text_of(out / "summary.csv").startswith("﻿File Name,Source Tables,Target Tables\ncte.sql,RAW.`점포`; RAW.`창고재고`,MART.`창고요약`\n")
    assert text_of(out / "source_table_mapping.csv").splitlines()[1] == "sample.sql,RAW.ORDER_LINES,MART.`고객명부`; MART.`주문합계`"
    assert text_of(out / "target_table_mapping.csv").splitlines()[-1] == "cte.sql,MART.`창고요약`,RAW.`점포`; RAW.`창고재고`"


def test_step_check_and_scan_jobs(spark, tmp_path):
    root = corpus(tmp_path)
    jobs.step_job(spark, str(root), str(tmp_path / "steps"))
    assert (tmp_path / "steps" / "sample_step_tables.txt").exists()
    assert text_of(tmp_path / "steps" / "step_summary.csv").startswith("﻿File Name,Source Tables,Target Tables,Steps,Total Steps\n")
    (tmp_path / "pk.list").write_text("raw.order_lines,k1,k2")
    assert jobs.check_job(spark, str(root), str(tmp_path / "checks"), pk_list=str(tmp_path / "pk.list"))[0] == 4
    assert "select k1,k2,count(1) from RAW.ORDER_LINES" in (tmp_path / "checks" / "sample_bq.sql").read_text(encoding="utf-8")
    assert jobs.scan_job(spark, str(root), str(tmp_path / "scan"), charset="UTF-8")[0] == 3
    assert (tmp_path / "scan" / "sub" / "other.source_target.txt").read_text() == (
        f"FILE: {root}/sub/other.SQL\n\n[Source Tables]\n  1. zz\n"
    )


def test_line_count_and_block_jobs(spark, tmp_path):
    root = corpus(tmp_path)
    found = jobs.line_count_job(spark, str(root))
    rows = {r["name"]: r for r in found["files"].collect()}
    assert (rows["note.txt"]["lines"], rows["note.txt"]["insert_lines"], rows["note.txt"]["step_lines"]) == (2, 1, 1)
    assert rows["note.txt"]["targets"] == ["A"] and rows["note.txt"]["sources"] == []
    shown = {r["name"]: r for r in found["shown"].collect()}
    assert shown["note.txt"]["targets"] == "A" and shown["note.txt"]["sources"] == "-"
    assert found["skipped"].count() == 0
    small = jobs.line_count_job(spark, str(root), max_bytes=60)
    left_out = {(r["path"], r["reason"]) for r in small["skipped"].collect()}
    assert left_out and {reason for _, reason in left_out} == {"too large"} and len(left_out) + small["files"].count() == 4
    assert {tuple(r) for r in found["extensions"].collect()} == {("sql", 3), ("txt", 1)}
    assert {r[0] for r in found["sources"].collect()} == {"RAW.ORDER_LINES", "RAW."}
    totals = jobs.block_job(spark, str(root), str(tmp_path / "blocks"))["totals"].first()
    assert totals["blocks"] == 2
    assert text_of(tmp_path / "blocks" / "output.csv").splitlines()[0] == "Step,Table,Column,Condition,Alias->Original,Error"
    assert (tmp_path / "blocks" / "sample.sql.html").exists()
