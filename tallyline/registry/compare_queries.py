"""Queries for the keyed comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.operators import compare as C
from tallyline.operators import compare_digests as D
from tallyline.operators.numbering import number_rows
from tallyline.registry import inputs as I
from tallyline.sources.csv_files import ROW_ORDER

KEY = ["o_orderkey"]
COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
TRIM = r"regexp_replace(regexp_replace({0}, '^[\x00-\x20]+', ''), '[\x00-\x20]+$', '')"


def _text(side: str, column: str) -> str:
    return f"coalesce(CAST({side}.{column} AS VARCHAR), '')"


def compare_sql(
    a_sql: str, b_sql: str, keys: list[str], columns: list[str], only_a: tuple[str, ...] = (), only_b: tuple[str, ...] = (),
    on: str | None = None,
) -> str:
    """The comparison as one full outer join."""
    condition = on or " AND ".join(f"{_text('a', k)} = {_text('b', k)}" for k in keys)

    def text(side: str, column: str) -> str:
        absent = only_b if side == "a" else only_a
        return "''" if column in absent else _text(side, column)

    values = ", ".join(
        f"CASE WHEN a_here IS NOT NULL THEN {text('a', c)} ELSE {text('b', c)} END AS {c}" for c in columns
    )
    details = ", ".join(
        f"CASE WHEN {TRIM.format(text('a', c))} <> {TRIM.format(text('b', c))}"
        f" THEN concat('{c}: ''', {text('a', c)}, ''' -> ''', {text('b', c)}, '''') END"
        for c in columns
    )
    return f"""SELECT {", ".join(columns)},
  CASE WHEN b_here IS NULL THEN 'ONLY_IN_FILE1' WHEN a_here IS NULL THEN 'ONLY_IN_FILE2'
       WHEN detail = '' THEN 'MATCHED' ELSE 'MISMATCHED' END AS "RESULT",
  CASE WHEN a_here IS NULL OR b_here IS NULL THEN '' ELSE detail END AS "DIFF_DETAIL"
FROM (SELECT {values}, concat_ws('; ', {details}) AS detail, a_here, b_here
      FROM (SELECT *, 1 AS a_here FROM ({a_sql})) a
      FULL OUTER JOIN (SELECT *, 1 AS b_here FROM ({b_sql})) b ON {condition})"""


# Only blanks around values differ.
_BLANKS_SQL = """SELECT o_orderkey, concat(chr(9), o_orderstatus, chr(10)) AS o_orderstatus,
  concat('  ', o_orderpriority) AS o_orderpriority FROM orders"""
_PLAIN_SQL = "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders"

# One row in a thousand is changed or gone, all others differ in blanks at most.
_NEAR_SQL = """SELECT o_orderkey, CASE WHEN o_orderkey % 1999 = 0 THEN 'changed' ELSE concat(o_orderstatus, ' ') END AS o_orderstatus,
  o_orderpriority FROM orders WHERE o_orderkey % 2003 <> 0"""

# Side 2 lost one column and gained two, one of them blank.
_DRIFT_SQL = """SELECT o_orderkey, o_orderstatus, ' ' AS remark,
  CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE '' END AS flag FROM orders"""
_DRIFT_COLUMNS = ["o_orderkey", "o_orderstatus", "o_orderpriority", "remark", "flag"]

_TURNS_A = "SELECT conv_id, turn, role, text FROM conversations"
_TURNS_B = """SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 4 = 0 THEN concat(text, ' edited') ELSE text END AS text
  FROM conversations WHERE (conv_id + turn) % 9 <> 0"""

_NAMES_A = "SELECT c_custkey, c_name, c_mktsegment FROM customer"
_NAMES_B = """SELECT c_custkey, upper(c_name) AS c_name, c_mktsegment FROM customer WHERE c_custkey % 6 <> 0"""


def _sides(spark, sf, a_sql, b_sql, name="orders"):
    return I.run_sql(spark, sf, a_sql, **{name: name}), I.run_sql(spark, sf, b_sql, **{name: name})


def compare_full(spark, sf):
    return C.compare(*I.orders_pair(spark, sf), KEY)


# File 1 goes by customer and file 2 backwards by number.
_ORDER_A, _ORDER_B = ("o_custkey", "o_orderkey"), ("-o_orderkey", "o_custkey")


def compare_row_order(spark, sf):
    """The result in the order of its rows: those of file 1, then those that only file 2 has, with their line numbers."""
    a, b = I.orders_pair(spark, sf)
    place = lambda of: F.struct(*[F.expr(x).cast("bigint").alias(f"k{i}") for i, x in enumerate(of)])
    found = C.compare(a.withColumn(ROW_ORDER, place(_ORDER_A)), b.withColumn(ROW_ORDER, place(_ORDER_B)), KEY)
    return number_rows(found, [ROW_ORDER]).select("line", "o_orderkey", "RESULT", "DIFF_DETAIL")


def compare_by_digest(spark, sf):
    return D.compare_by_digest(*I.orders_pair(spark, sf), KEY)


def compare_nearly_equal(spark, sf):
    """One order in a thousand differs."""
    return D.compare_by_digest(*_sides(spark, sf, _PLAIN_SQL, _NEAR_SQL), KEY)


def compare_summary(spark, sf):
    return C.summarize(C.compare(*I.orders_pair(spark, sf), KEY))


def compare_cells(spark, sf):
    return C.differing_cells(*I.orders_pair(spark, sf), KEY)


def compare_only_left(spark, sf):
    return C.only_left(*I.orders_pair(spark, sf), KEY)


def compare_only_right(spark, sf):
    return C.only_right(*I.orders_pair(spark, sf), KEY)


def compare_key_union(spark, sf):
    return C.key_union(*I.orders_pair(spark, sf), KEY)


def compare_whitespace(spark, sf):
    return C.compare(*_sides(spark, sf, _PLAIN_SQL, _BLANKS_SQL), KEY)


def compare_schema_drift(spark, sf):
    return C.compare(*_sides(spark, sf, _PLAIN_SQL, _DRIFT_SQL), KEY)


def compare_default_key(spark, sf):
    a, b = I.orders_pair(spark, sf)
    return C.compare(a, b)


def compare_composite_key(spark, sf):
    return C.compare(*_sides(spark, sf, _TURNS_A, _TURNS_B, "conversations"), ["conv_id", "turn"])


def compare_key_function(spark, sf):
    return C.compare(*_sides(spark, sf, _NAMES_A, _NAMES_B, "customer"), lambda df: [F.lower(df["c_name"])])


def compare_duplicate_keys(spark, sf):
    return C.duplicate_keys(I.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


QUERIES = {
    q.__name__: q
    for q in (
        compare_full, compare_row_order, compare_by_digest, compare_nearly_equal, compare_summary, compare_cells, compare_only_left, compare_only_right, compare_key_union,
        compare_whitespace, compare_schema_drift, compare_default_key, compare_composite_key, compare_key_function,
        compare_duplicate_keys,
    )
}

_FULL = compare_sql(I.ORDERS_A_SQL, I.ORDERS_B_SQL, KEY, COLUMNS)
_CELLS = " UNION ALL ".join(
    f"SELECT CAST(a.o_orderkey AS VARCHAR) AS key, '{c}' AS \"column\", {_text('a', c)} AS value1, {_text('b', c)} AS value2"
    f" FROM a JOIN b ON a.o_orderkey = b.o_orderkey WHERE {TRIM.format(_text('a', c))} <> {TRIM.format(_text('b', c))}"
    for c in COLUMNS
)
_PAIR = f"WITH a AS ({I.ORDERS_A_SQL}), b AS ({I.ORDERS_B_SQL})"

_LINES = f"""WITH a AS ({I.ORDERS_A_SQL}), b AS ({I.ORDERS_B_SQL}),
  p AS (
    SELECT o_orderkey, min(side) AS side, arg_min(k0, side) AS k0, arg_min(k1, side) AS k1
    FROM (SELECT o_orderkey, 1 AS side, {_ORDER_A[0]} AS k0, {_ORDER_A[1]} AS k1 FROM a UNION ALL SELECT o_orderkey, 2, {_ORDER_B[0]}, {_ORDER_B[1]} FROM b)
    GROUP BY o_orderkey
  )
SELECT row_number() OVER (ORDER BY side, k0, k1) AS line, f.o_orderkey, f."RESULT", f."DIFF_DETAIL" FROM ({_FULL}) f JOIN p ON CAST(p.o_orderkey AS VARCHAR) = f.o_orderkey"""

ORACLES = {
    "compare_full": _FULL,
    "compare_row_order": _LINES,
    "compare_by_digest": _FULL,
    "compare_nearly_equal": compare_sql(_PLAIN_SQL, _NEAR_SQL, KEY, ["o_orderkey", "o_orderstatus", "o_orderpriority"]),
    "compare_summary": f'SELECT "RESULT", count(*) AS rows FROM ({_FULL}) GROUP BY "RESULT"',
    "compare_cells": f"{_PAIR} {_CELLS}",
    "compare_only_left": f"{_PAIR} SELECT * FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)",
    "compare_only_right": f"{_PAIR} SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)",
    "compare_key_union": f"""{_PAIR} SELECT CAST(k AS VARCHAR) AS o_orderkey, bool_or(s = 1) AS in_file1, bool_or(s = 2) AS in_file2
      FROM (SELECT o_orderkey AS k, 1 AS s FROM a UNION ALL SELECT o_orderkey, 2 FROM b) GROUP BY k""",
    "compare_whitespace": compare_sql(_PLAIN_SQL, _BLANKS_SQL, KEY, ["o_orderkey", "o_orderstatus", "o_orderpriority"]),
    "compare_schema_drift": compare_sql(
        _PLAIN_SQL, _DRIFT_SQL, KEY, _DRIFT_COLUMNS, only_a=("o_orderpriority",), only_b=("remark", "flag")
    ),
    "compare_default_key": _FULL,
    "compare_composite_key": compare_sql(_TURNS_A, _TURNS_B, ["conv_id", "turn"], ["conv_id", "turn", "role", "text"]),
    "compare_key_function": compare_sql(
        _NAMES_A, _NAMES_B, [], ["c_custkey", "c_name", "c_mktsegment"], on="lower(a.c_name) = lower(b.c_name)"
    ),
    "compare_duplicate_keys": """SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
      count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
}
