"""Inputs the registered queries derive from the given tables.

Each derivation is one SQL text that Spark and the checking engine both run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyline.session import spread

NL = "chr(10)"
QUOTE = "chr(39)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select(df: DataFrame, sql_columns: str) -> DataFrame:
    """``SELECT <sql_columns>`` over a frame."""
    return df.sparkSession.sql(f"SELECT {sql_columns} FROM {{df}}", df=df)


# --- two versions of a keyed table -------------------------------------------------

ORDERS_A = """o_orderkey, o_custkey, o_orderstatus,
  CAST(o_totalprice AS DECIMAL(18, 2)) AS o_totalprice,
  CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority"""

# Every 7th key is missing, every 11th is added under a new number, every 5th has
# another priority and every 3rd of the rest only blanks around it.
_ORDERS_B_BODY = """o_custkey, o_orderstatus,
  CAST(o_totalprice AS DECIMAL(18, 2)) AS o_totalprice,
  CAST(o_orderdate AS DATE) AS o_orderdate,
  CASE WHEN o_orderkey % 5 = 0 THEN concat(o_orderpriority, '!')
       WHEN o_orderkey % 3 = 0 THEN concat(chr(9), ' ', o_orderpriority, ' ', chr(13))
       ELSE o_orderpriority END AS o_orderpriority"""
ORDERS_B_SQL = f"""SELECT o_orderkey, {_ORDERS_B_BODY} FROM orders WHERE o_orderkey % 7 <> 0
  UNION ALL SELECT o_orderkey + 10000000 AS o_orderkey, {_ORDERS_B_BODY} FROM orders WHERE o_orderkey % 11 = 0"""
ORDERS_A_SQL = f"SELECT {ORDERS_A} FROM orders"


def run_sql(spark: SparkSession, sf_dir: str, sql: str, **names: str) -> DataFrame:
    """Run SQL over parquet tables given as ``name=table``; no views are left behind."""
    frames = {name: table(spark, sf_dir, source) for name, source in names.items()}
    for name in frames:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(sql, **frames)


def orders_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return (
        run_sql(spark, sf_dir, ORDERS_A_SQL, orders="orders"),
        run_sql(spark, sf_dir, ORDERS_B_SQL, orders="orders"),
    )


# --- a corpus of scripts, one per order --------------------------------------------


def _num(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _concat(*parts: str) -> str:
    """SQL that joins literals (with line breaks and quotes) and expressions (``=`` first)."""
    out = []
    for part in parts:
        if part.startswith("="):
            out.append(part[1:])
            continue
        for i, line in enumerate(part.split("\n")):
            if i:
                out.append(NL)
            for j, piece in enumerate(line.split("'")):
                if j:
                    out.append(QUOTE)
                if piece:
                    out.append(f"'{piece}'")
    return "concat(" + ", ".join(out) + ")"


_K, _C = "o_orderkey", "o_custkey"
SCRIPT_NAME = f"concat('job_', {_num(f'{_K} - {_K} % 8')}, '.sql')"
SCRIPT_PATH = f"concat('t', {_num(_K + ' % 8')}, '/', {SCRIPT_NAME})"


def step_bodies(tick: str = "`") -> dict[str, str]:
    """SQL text of each step body; ``tick`` is what comments hold for a backtick."""
    first = _concat(
        "\nBEGIN\n  INSERT INTO DM.TGT_", f"={_num(_C + ' % 50')}",
        "\n  SELECT x.a, y.b AS bb\n  FROM DW.SRC_", f"={_num(_K + ' % 97')}",
        " x\n  LEFT OUTER JOIN DW.DIM_", f"={_num(_K + ' % 13')}",
        " y ON x.id = y.id\n  WHERE x.st = '", "=o_orderstatus",
        "' AND x.note <> 'taken FROM ZZ.Q1, ZZ.Q2; `kept`';\nEND;\n",
    )
    second = _concat(
        f"\nBEGIN -- {tick}aggregate{tick} from OLD.AGG\n  INSERT INTO DM.AGG_", f"={_num(_K + ' % 7')}",
        "\n  WITH CTE_A AS (SELECT id FROM DW.FACT_", f"={_num(_C + ' % 31')}",
        "), CTE_B AS (SELECT id FROM CTE_A)\n  SELECT id FROM CTE_A, CTE_B, DW.CAL c WHERE 1 = 1;\n",
        "  BEGIN\n    INSERT INTO DM.LOG SELECT 1 FROM DW.RUN_", f"={_num(_K + ' % 3')}", ";\n  END;\nEND;\n",
    )
    merge = _concat(
        "\nBEGIN\n  MERGE INTO DM.MRG_", f"={_num(_C + ' % 11')}", " t\n  USING DW.UPD_", f"={_num(_K + ' % 5')}",
        " u\n  ON t.id = u.id\n  WHEN MATCHED THEN UPDATE SET t.v = u.v;\nEND;\n",
    )
    delete = _concat(
        "\nBEGIN\n  DELETE FROM DM.OLD_", f"={_num(_C + ' % 5')}", " WHERE d = 1;\n  DELETE DM.ARC_",
        f"={_num(_K + ' % 5')}", " WHERE d = 2;\n  SET vs_jb_step = vs_jb_step +1;\nEND;\n",
    )
    update = _concat(
        "\nBEGIN\n  UPDATE DM.UPD_", f"={_num(_C + ' % 9')}",
        "\n  SET v = 1, w = 2\n  WHERE id IN (SELECT id FROM DW.`SRC ", f"={_num(_K + ' % 4')}", "`);\nEND",
    )
    return {"first": first, "second": second, "merge": merge, "delete": delete, "update": update}


def script_columns(tick: str = "`") -> str:
    """SQL columns path, name, raw of one script per order.

    Eight scripts in different folders share a file name. A third of the scripts
    repeats a step name, and every script reads the same calendar table.
    """
    bodies = step_bodies(tick)
    raw = ", ".join(
        [
            _concat(f"/* load {tick}", f"={_num(_K)}", f"{tick} from OLD.TAB */\n-- STEP001"),
            bodies["first"],
            "'-- STEP002'",
            bodies["second"],
            f"CASE WHEN {_K} % 3 = 0 THEN concat('-- STEP003', {bodies['merge']})"
            f" WHEN {_K} % 3 = 1 THEN concat('/* STEP003 */', {bodies['delete']})"
            f" ELSE concat('-- STEP001', {bodies['update']}) END",
        ]
    )
    return f"{SCRIPT_PATH} AS path, {SCRIPT_NAME} AS name, concat({raw}) AS raw"


SCRIPTS_SQL = f"SELECT {script_columns()} FROM orders"

# A script is some 600 characters made of three narrow columns: about so many are the work of one task.
SCRIPTS_A_TASK = 20_000


def scripts(spark: SparkSession, sf_dir: str, columns: str | None = None) -> DataFrame:
    """The corpus; only the three columns the texts are made of are read."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), SCRIPTS_A_TASK)
    return select(orders, columns or script_columns())


def script_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that bring scripts together, about as many as made them."""
    return -(-table(spark, sf_dir, "orders").count() // SCRIPTS_A_TASK)


def documents(spark: SparkSession, sf_dir: str, columns: str = "doc_id, text") -> DataFrame:
    return select(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), columns)


# --- a primary-key list -------------------------------------------------------------

# One line per first-step target and per dimension: repeated tables, comments,
# blank columns and lines without columns are part of it.
PK_LINES_SQL = f"""concat(
  CASE WHEN c_custkey % 10 = 9 THEN '# ' ELSE ' ' END,
  CASE WHEN c_custkey % 2 = 0 THEN 'dm.`tgt_' ELSE 'DW.DIM_' END, {_num('c_custkey % 60')},
  CASE WHEN c_custkey % 2 = 0 THEN '`' ELSE '' END,
  CASE WHEN c_custkey % 7 = 3 THEN '' ELSE concat(' , ID_', {_num('c_nationkey')}, ' ,, ', c_mktsegment) END)"""


def pk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list's lines with their order, made from the customers."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return select(customers, f"{PK_LINES_SQL} AS line, c_custkey AS _row_order")


PK_LIST_SQL = f"""SELECT table_key, pk_cols FROM (
  SELECT table_key, pk_cols, row_number() OVER (PARTITION BY table_key ORDER BY ord DESC) AS rn FROM (
    SELECT upper(replace(trim(split_part(line, ',', 1)), '`', '')) AS table_key,
           concat(trim(split_part(line, ',', 2)), ',', trim(split_part(line, ',', 4))) AS pk_cols,
           ord
    FROM (SELECT trim({PK_LINES_SQL}) AS line, c_custkey AS ord FROM customer) l
    WHERE line NOT LIKE '#%' AND line LIKE '%,%') e) r WHERE rn = 1"""
