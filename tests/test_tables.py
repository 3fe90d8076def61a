from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from tallyline.operators import checks as K
from tallyline.operators.check_sql import check_file_rows, check_files, check_statements, with_pk_columns
from tallyline.operators.joins import fits_broadcast, lookup
from tallyline.operators.pivot import JOB_KEYS, pivot_last
from tallyline.operators.statements import run_script, split_statements
from tallyline.plans.tables import pivot_job_list, run_script_job
from tallyline.registry import table_queries
from tallyline.sinks.csv_files import write_csv
from tallyline.sources.csv_files import read_csv, read_eav
from tallyline.sources.jdbc import ScriptRunSettings, jdbc_options
from tallyline.sources.pk_list import read_pk_list

# A job list with a key/value row per setting, and the wide report made of it.
JOBS = """﻿APPLICATION_NM5 ,GROUP_NM4,JOBNAME_NM3,CTRM_항목명,CTRM_DATA
ADMMON01,ADM05D,DEU_월가맹점01 ,CMDLINE,\"\"\"ksh run.sh 월가맹점01 %%PRELASTMN DM.월가맹점\"\"\"
ADMMON01,ADM05D,DEU_월가맹점01 ,DAYSCAL,ALLDays
ADMMON01,ADM05D,DEU_월가맹점01 ,DAYSCAL,MONTHSTART
ADMMON01,ADM05D,DEU_월가맹점01 ,TIMEFROM,0000
ADMMON01,ADM05D,DEU_월가맹점01 ,TIMEUNTIL,>
ADMMON01,ADM05D,too short
ADMMON01,ADM05D,too short,KEY
ADMMON01,ADM04D,DEU_공통코드D01,DESCRIPTION,\"[DM.공통코드], 생성\",ignored
ADMMON01,ADM03D,DEU_ONLY,UNKNOWN,x
"""


def test_pivot_job_list(spark, tmp_path):
    (tmp_path / "jobs.csv").write_text(JOBS, encoding="utf-8")
    pivot_job_list(spark, str(tmp_path / "jobs.csv"), str(tmp_path / "out"))
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*"))).decode()
    assert text == (
        "﻿APPLICATION_NM5,GROUP_NM4,JOBNAME_NM3,CMDLINE,DAYSCAL,DESCRIPTION,INCOND,MONTH,TIMEFROM,TIMEUNTIL\n"
        'ADMMON01,ADM05D,DEU_월가맹점01,ksh run.sh 월가맹점01 %%PRELASTMN DM.월가맹점,MONTHSTART,,,,="0000",=">"\n'
        'ADMMON01,ADM04D,DEU_공통코드D01,,,"[DM.공통코드], 생성",,,,\n'
        "ADMMON01,ADM03D,DEU_ONLY,,,,,,,\n"
    )


def test_pivot_of_unpivoted_rows_is_identity(spark):
    wide = spark.range(50).select(F.col("id").cast("string").alias("id"), *[F.concat(F.lit(k), "id").alias(k) for k in JOB_KEYS])
    long = wide.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in JOB_KEYS])).alias("e"))
    rows = long.select("id", "e.*").withColumn("ord", F.monotonically_increasing_id())
    again = pivot_last(rows, ["id"], "k", "v", "ord", JOB_KEYS)
    assert again.exceptAll(wide).isEmpty() and wide.exceptAll(again).isEmpty()


def test_pivot_hot_group_keeps_the_last_value(spark):
    rows = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"),
        F.lit("K").alias("k"), F.col("id").cast("string").alias("v"), F.col("id").alias("ord"),
    )
    out = pivot_last(rows, ["g"], "k", "v", "ord", ["K"])
    assert out.where("g = 'hot'").first()["K"] == "59997" and out.count() == 40001


def test_csv_scan_rules(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,a\r\n1,"x ""q"", y",3\r\n4\r\n"l1\nl2",6,7,8\r\n', encoding="utf-8")
    with pytest.raises(Exception, match="multi_line=True"):
        read_csv(spark, str(tmp_path / "t.csv")).collect()
    rows = read_csv(spark, str(tmp_path / "t.csv"), multi_line=True)
    assert rows.columns == ["a", "b"]
    assert [tuple(r) for r in rows.collect()] == [("3", 'x "q", y'), ("", ""), ("7", "6")]
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        read_csv(spark, str(tmp_path / "empty.csv"))


@pytest.mark.parametrize("multi_line", [False, True])
def test_csv_rows_of_all_kinds(spark, tmp_path, multi_line):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "1.csv").write_bytes("\ufeffid,v\r\n1,a\"b,\"\"c\"\r\r\n\"\",\"x\"\"y\"\nid,v\n".encode())
    (folder / "2.csv").write_bytes(b"id,v\n\n2,z")
    rows = sorted(map(tuple, read_csv(spark, str(folder), multi_line=multi_line).collect()))
    assert rows == sorted([("1", 'ab,"c'), ("", ""), ("", 'x"y'), ("id", "v"), ("", ""), ("2", "z")])
    (folder / "3.csv").write_bytes(b"v,id\n3,4\n")
    with pytest.raises(ValueError, match="different headers"):
        read_csv(spark, str(folder), multi_line=multi_line)


def test_one_column_table_round_trip(spark, tmp_path):
    table = spark.createDataFrame([("a",), ("",), ("b",), ('"',)], "only string").coalesce(1)
    write_csv(table, str(tmp_path / "one"))
    assert [r[0] for r in read_csv(spark, str(tmp_path / "one")).collect()] == ["a", "", "b", '"']


def test_row_order_follows_the_file_across_splits(spark, tmp_path):
    (tmp_path / "big.csv").write_text("h,i,j,k,v\n" + "".join(f"g,g,j,KEY,{i}\n" for i in range(60000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows = read_eav(spark, str(tmp_path / "big.csv"))
        assert rows.rdd.getNumPartitions() > 2
        assert [r["value"] for r in rows.orderBy("_row_order").collect()] == [str(i) for i in range(60000)]
        assert rows.agg(F.max_by("value", "_row_order")).first()[0] == "59999"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


PK_LIST = """# table, key columns
DW.RED_CARE_SALES,sale_date1,sale_date2
 DW.`일서비스멤버2` , 기준일자 ,, 서비스번호
no_columns

dw.마스터가입자3,old
DW.마스터가입자3,기준년월,가입자번호"""


def test_pk_list(spark, tmp_path):
    (tmp_path / "table_pk.list").write_text(PK_LIST, encoding="utf-8")
    found = {r["table_key"]: r["pk_cols"] for r in read_pk_list(spark, str(tmp_path / "table_pk.list")).collect()}
    assert found == {
        "DW.RED_CARE_SALES": ["sale_date1", "sale_date2"],
        "DW.일서비스멤버2": ["기준일자", "서비스번호"],
        "DW.마스터가입자3": ["기준년월", "가입자번호"],
    }
    assert read_pk_list(spark, str(tmp_path / "missing.list")).isEmpty()


def pk_frame(spark):
    return spark.createDataFrame(
        [("DW.RED_CARE_SALES", ["sale_date1", "sale_date2"]), ("DW.일서비스멤버2", ["기준일자", "서비스번호"])],
        "table_key string, pk_cols array<string>",
    )


def extracted(spark):
    return spark.createDataFrame(
        [("qa/sub/job1.sql", ["DW.RED_CARE_SALES", "DW.`일서비스멤버2`"], ["DM.월카드"]), ("none.sql", [], [])],
        "path string, sources array<string>, targets array<string>",
    )


def test_check_statements(spark):
    def statements(dialect, table):
        rows = check_statements(extracted(spark), pk_frame(spark), dialect).where(F.col("table") == table)
        return [r["statement"] for r in rows.orderBy("statement_ord").collect()]

    assert statements("oracle", "DW.RED_CARE_SALES") == [
        "select * from DW.RED_CARE_SALES;",
        "select * from DW.RED_CARE_SALES where 기준일자 = '20260224';",
        "select count(1) from DW.RED_CARE_SALES;",
        "select 기준일자,count(1) from DW.RED_CARE_SALES group by 기준일자 order by 기준일자 desc;",
        "select count(1) from DW.RED_CARE_SALES where 기준일자 = '20260224';",
        "select sale_date1,sale_date2,count(1) from DW.RED_CARE_SALES group by sale_date1,sale_date2 having count(1) > 1;",
    ]
    bq = statements("bq", "DW.`일서비스멤버2`")
    assert bq[1] == "select * from DW.`일서비스멤버2` where `파티션일자` = parse_date('%Y%m%d', '20260224');"
    assert bq[5] == "select `기준일자`,`서비스번호`,count(1) from DW.`일서비스멤버2` group by `기준일자`,`서비스번호` having count(1) > 1;"
    assert statements("oracle", "DW.`일서비스멤버2`")[0] == "select * from DW.일서비스멤버2;"
    assert statements("bq", "DM.월카드")[3] == "select `기준일자`,count(1) from `DM.월카드` group by `기준일자` order by `기준일자` desc;"
    assert "기준년월" in statements("oracle", "DM.월카드")[1] and len(statements("bq", "DM.월카드")) == 5


def test_check_files(spark):
    files = {r["path"]: r["content"] for r in check_file_rows(check_files(extracted(spark), pk_frame(spark))).collect()}
    assert set(files) == {"qa/sub/job1_bq.sql", "qa/sub/job1_oracle.sql", "none_bq.sql", "none_oracle.sql"}
    rule = "/*--------------------*/\n"
    assert files["none_bq.sql"] == f"{rule}/*-- 소스테이블 : 0개 --*/\n{rule}\n{rule}/*-- 타겟테이블 : 0개 --*/\n{rule}\n"
    text = files["qa/sub/job1_oracle.sql"]
    assert text.startswith(f"{rule}/*-- 소스테이블 : 2개 --*/\n{rule}\n/*-- 1) DW.RED_CARE_SALES --*/\nselect * from DW.RED_CARE_SALES;\n")
    assert f"having count(1) > 1;\n\n{rule}/*-- 타겟테이블 : 1개 --*/\n{rule}\n/*-- 1) DM.월카드 --*/\n" in text
    assert text.endswith("'20260224';\n\n") and "parse_date" not in text


def test_lookup_by_broadcast_and_by_salted_join_agree(spark):
    tables = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "dw.red_care_sales").otherwise(F.concat(F.lit("t"), "id")).alias("table")
    )
    small = with_pk_columns(tables, pk_frame(spark))
    from tallyline.functions.names import table_key

    big = lookup(tables.withColumn("table_key", table_key(F.col("table"))), pk_frame(spark), "table_key", broadcast=False)
    assert small.count() == big.count() == 3000
    assert small.where("pk_cols IS NOT NULL").count() == big.where("pk_cols IS NOT NULL").count() == 1000
    assert fits_broadcast(pk_frame(spark)) and not fits_broadcast(spark.range(50), max_rows=20)


def test_checks(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, DATE'2026-02-24', '20260224'), (1, DATE'2026-02-24', '20260223'), (2, DATE'2026-02-25', '20260224') AS t(k, d, s)"
    )
    assert [tuple(r) for r in K.count_by_date(df, "d").collect()] == [(dt.date(2026, 2, 25), 1), (dt.date(2026, 2, 24), 2)]
    assert K.count_at_date(df, "d", "20260224").first()[0] == 2 and K.count_at_date(df, "s", dt.date(2026, 2, 24)).first()[0] == 2
    assert tuple(K.check_summary(df, "d", "20260224").first()) == (3, 2)
    assert set(K.table_checks(df, "d", "20260224")) == {"rows", "rows_at_date", "count", "count_by_date", "count_at_date"}
    assert [tuple(r) for r in K.table_checks(df, "d", "20260224", ["k"])["pk_duplicates"].collect()] == [(1, 2)]


def test_base_date_reaches_the_scan(spark, tmp_path):
    spark.sql("SELECT id, DATE'2026-02-24' + CAST(id AS INT) AS d, 'x' AS wide FROM range(10)").write.parquet(str(tmp_path / "t"))
    plan = K.count_at_date(spark.read.parquet(str(tmp_path / "t")), "d", "20260224")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(d,2026-02-24)" in plan and "ReadSchema: struct<d:date>" in plan


def test_statement_split(spark):
    def split(text):
        rows = split_statements(spark.createDataFrame([(text,)], "raw string")).orderBy("statement_ord")
        return [r["statement"] for r in rows.collect()]

    assert split("select ';' a; select \"x;'y\" b ;; insert 'un;closed") == [
        "select ';' a", "select \"x;'y\" b", "insert 'un;closed",
    ]
    assert split(" a ;\n; b") == ["a", "b"] and split(" ; ") == []


def test_run_script(spark):
    out = run_script(spark, "SELECT 1 AS a, 'x;' AS b; CREATE OR REPLACE TEMP VIEW v AS SELECT 2 AS n; SELECT n, 5, 'more' FROM v;")
    assert out.columns == ["a", "b"] and sorted(map(tuple, out.collect())) == [(1, "x;"), (2, "5")]
    with pytest.raises(ValueError, match="1 columns"):
        run_script(spark, "SELECT 1 AS a, 2 AS b; SELECT 3")
    with pytest.raises(ValueError, match="no statement"):
        run_script(spark, "CREATE OR REPLACE TEMP VIEW w AS SELECT 1 AS n")


def test_run_script_job(spark, tmp_path):
    (tmp_path / "s.sql").write_text("SELECT 'a,b' AS x, CAST(NULL AS STRING) AS y")
    target = run_script_job(spark, ScriptRunSettings(script_path=str(tmp_path / "s.sql"), output_dir=str(tmp_path)))
    assert target.endswith("/result.xlsx")
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "result.xlsx").glob("part-*")))
    assert text == b'x,y\n"a,b",\n'


def test_run_settings():
    env = {"APP_SQL_JDBC_URL": "jdbc:x", "APP_SQL_USERNAME": "u", "APP_SQL_SCRIPT_PATH": "s.sql", "APP_SQL_OUTPUT_DIR": "out"}
    settings = ScriptRunSettings.from_env(env)
    settings.validate()
    assert settings.output_path() == "out/result.xlsx"
    assert jdbc_options(settings, "select 1") == {"url": "jdbc:x", "user": "u", "password": "", "query": "select 1"}
    split = jdbc_options(settings, "select 1", partitionColumn="id", lowerBound="0", upperBound="9", numPartitions="3")
    assert split["dbtable"] == "(select 1) q" and "query" not in split
    for missing, label in (("url", "JDBC URL"), ("user", "user"), ("script_path", "script"), ("output_dir", "output")):
        with pytest.raises(ValueError, match=label):
            ScriptRunSettings(**{**settings.__dict__, missing: " "}).validate()


def test_headed_lines_are_rows_of_their_own(spark, tmp_path, monkeypatch):
    rows = spark.range(5000).selectExpr("case when id % 4 = 0 then '' else concat('k', id, ',x') end as value").repartition(7)
    written = []
    text = DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, path, **o: (written.append(path), text(self, path, **o))[1])
    monkeypatch.setattr(F, "collect_list", lambda *_: pytest.fail("lines gathered in one value"))
    monkeypatch.setattr(table_queries.I, "run_sql", lambda *_, **__: rows)
    got = table_queries.csv_line_scan(spark, "")
    assert got.columns == ["id", "note"] and got.count() == 5000 and got.where("id = 'id'").count() == 0
    files = sorted(Path(written[0]).rglob("part-*"))
    lines = [f.read_text().split("\n") for f in files]
    assert len(files) == 7 and all(x[0] == "id,note" and x.count("id,note") == 1 for x in lines)
