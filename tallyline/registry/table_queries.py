"""Queries for the table checks, the pivot, table sources and sinks, and script runs."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from tallyline.operators import checks as K
from tallyline.operators.check_sql import with_pk_columns
from tallyline.operators.joins import skewed_lookup
from tallyline.operators.numbering import number_rows
from tallyline.operators.pivot import FIRST_SEEN, guard_text, pivot_last
from tallyline.operators.statements import run_script
from tallyline.registry import inputs as I
from tallyline.session import materialize, scratch_path
from tallyline.sinks.csv_files import write_csv, write_report
from tallyline.sources.csv_files import EAV_COLUMNS, eav_rows, read_csv, read_eav
from tallyline.sources.pk_list import parse_pk_lines, read_pk_list

DATE, BASE = "o_orderdate", "19960704"
BASE_SQL = "o_orderdate = TIMESTAMP '1996-07-04'"
PK = ["l_orderkey", "l_linenumber"]
EVENT_KEYS = ["click", "error", "purchase", "signup", "view"]


def _orders(spark, sf):
    return I.table(spark, sf, "orders")


def check_rows(spark, sf):
    return K.table_checks(_orders(spark, sf), DATE, BASE)["rows"]


def check_rows_at_date(spark, sf):
    return K.rows_at_date(_orders(spark, sf), DATE, BASE)


def check_count(spark, sf):
    return K.count_rows(I.table(spark, sf, "lineitem"))


def check_count_at_date(spark, sf):
    return K.count_at_date(_orders(spark, sf), DATE, BASE)


def check_count_by_date(spark, sf):
    return K.count_by_date(_orders(spark, sf), DATE)


def check_pk_duplicates(spark, sf):
    return K.pk_duplicates(I.table(spark, sf, "lineitem"), PK)


def check_summary(spark, sf):
    return K.check_summary(_orders(spark, sf), DATE, BASE)


# --- pivot -----------------------------------------------------------------------

EAV_SQL = """SELECT concat(' u', CAST(user_id % 10 AS STRING)) AS application, CAST(user_id AS STRING) AS "group",
  'events ' AS job, CASE WHEN event_id % 50 = 0 THEN 'unknown' ELSE concat(event_type, ' ') END AS key,
  concat(chr(9), props) AS value, event_id FROM events""".replace('"', "`")


def _eav(spark, sf):
    return I.run_sql(spark, sf, EAV_SQL, events="events")


def pivot_eav(spark, sf):
    return pivot_last(_eav(spark, sf), ["application", "group", "job"], "key", "value", "event_id", EVENT_KEYS)


def pivot_first_encounter(spark, sf):
    """The wide rows numbered in the order in which their first rows are met."""
    wide = pivot_last(_eav(spark, sf), ["application", "group", "job"], "key", "value", "event_id", EVENT_KEYS, first_seen=True)
    return number_rows(wide, [FIRST_SEEN]).drop(FIRST_SEEN)


def pivot_excel_guard(spark, sf):
    return guard_text(pivot_eav(spark, sf), ["view", "click"])


_PIVOT_SQL = "SELECT trim(application) AS application, \"group\", trim(job) AS job, {cols} FROM ({eav}) GROUP BY 1, 2, 3".format(
    cols=", ".join(
        f"coalesce(max_by(trim(value, concat(' ', chr(9))), event_id) FILTER (WHERE trim(key) = '{k}'), '') AS {k}"
        for k in EVENT_KEYS
    ),
    eav=EAV_SQL.replace("`", '"'),
)

# --- CSV -------------------------------------------------------------------------

AWKWARD_SQL = """SELECT CAST(c_custkey AS STRING) AS id, concat('x, "', c_name, '" y') AS name,
  CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN concat('two', chr(10), 'lines') ELSE c_mktsegment END AS segment
  FROM customer"""


def csv_scan(spark, sf):
    path = scratch_path(spark, "csv-scan")
    write_csv(I.run_sql(spark, sf, AWKWARD_SQL, customer="customer"), path)
    return read_csv(spark, path, multi_line=True)


@contextmanager
def small_blocks(spark, path, count=150):
    """Cut files into about ``count`` blocks, of 300 bytes at least, for what runs inside."""
    whole = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("n")).first()["n"] or 0
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(max(300, whole // count)))
        yield
    finally:
        spark.conf.set(key, before)


def csv_block_scan(spark, sf):
    """Files cut into many small blocks, inside quoted values too, read by as many tasks."""
    path = scratch_path(spark, "csv-blocks")
    write_csv(I.run_sql(spark, sf, AWKWARD_SQL, customer="customer"), path)
    with small_blocks(spark, path):
        return materialize(read_csv(spark, path, multi_line=True), "csv-block-rows")


LINES_SQL = """SELECT CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN concat('k', CAST(c_custkey AS STRING), ',a"b, ""', c_name, repeat(chr(34), 3))
  WHEN c_custkey % 4 = 2 THEN concat('"k', CAST(c_custkey AS STRING), '"') ELSE concat('k', CAST(c_custkey AS STRING), ',', c_mktsegment, ',extra') END AS value
  FROM customer"""


def csv_line_scan(spark, sf):
    """Files read by line: blank and short rows, quotes in mid-field, extra fields, a header in each file."""
    path = scratch_path(spark, "csv-lines")
    write_headed_lines(I.run_sql(spark, sf, LINES_SQL, customer="customer"), "id,note", path)
    return read_csv(spark, path)


def write_headed_lines(rows, header, path):
    """Text files of the lines ``value``, each with the header first; files grow in number with the input, a row is one line."""
    parts = max(3, rows.rdd.getNumPartitions())
    dealt = rows.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).alias("part"), F.lit(1).alias("place"), "value")
    heads = rows.sparkSession.range(parts).select(F.col("id").alias("part"), F.lit(0).alias("place"), F.lit(header).alias("value"))
    ordered = dealt.unionByName(heads).repartition(parts, "part").sortWithinPartitions("part", "place")
    ordered.select("part", "value").write.partitionBy("part").text(path)


def csv_report_lines(spark, sf):
    """The ordered report read back as raw lines (the customers without line breaks)."""
    rows = I.run_sql(spark, sf, AWKWARD_SQL, customer="customer").withColumn("segment", F.replace("segment", F.lit("\n"), F.lit("|")))
    path = scratch_path(spark, "report")
    write_report(rows, path, order_by=[F.col("id").cast("long")], line_sep="\r\n")
    return spark.read.option("lineSep", "\r\n").text(path)


EAV_LINE_SQL = """SELECT event_id, concat(' u', CAST(user_id AS STRING), ',"g, ', event_type, '" ,job',
  CASE WHEN event_id % 4 = 0 THEN '' ELSE concat(',key', CAST(event_id % 5 AS STRING)) END,
  CASE WHEN event_id % 4 = 1 THEN '' ELSE concat(',', repeat(chr(34), 3), 'v ', CAST(event_id AS STRING), repeat(chr(34), 3)) END,
  CASE WHEN event_id % 4 = 3 THEN ',more,"x,y"' ELSE '' END) AS line FROM events"""


def eav_arity_filter(spark, sf):
    return eav_rows(I.run_sql(spark, sf, EAV_LINE_SQL, events="events"))


def eav_scan(spark, sf):
    """Key/value rows through a headed line CSV."""
    path = scratch_path(spark, "eav")
    rows = I.run_sql(spark, sf, EAV_LINE_SQL, events="events")
    write_csv(eav_rows(rows).select(*EAV_COLUMNS), path)
    return read_eav(spark, path).select(*EAV_COLUMNS)


_EAV_ORACLE = """SELECT concat('u', CAST(user_id AS VARCHAR)) AS application, concat('g, ', event_type) AS "group", 'job' AS job,
  concat('key', CAST(event_id % 5 AS VARCHAR)) AS key, concat('v ', CAST(event_id AS VARCHAR)) AS value{extra}
  FROM events WHERE event_id % 4 IN (2, 3)"""

# --- primary-key list --------------------------------------------------------------


def _pk(spark, sf):
    return parse_pk_lines(I.pk_lines(spark, sf))


def pk_list_parse(spark, sf):
    return _pk(spark, sf).select("table_key", F.array_join("pk_cols", ",").alias("pk_cols"))


def pk_list_scan(spark, sf):
    """The list through a text file, written in line order."""
    path = scratch_path(spark, "pk-list")
    I.pk_lines(spark, sf).orderBy("_row_order").select("line").write.text(path)
    return read_pk_list(spark, path).select("table_key", F.array_join("pk_cols", ",").alias("pk_cols"))


_TABLE_NAMES_SQL = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'DW.CAL'
  WHEN o_orderkey % 3 = 1 THEN concat('DM.`tgt_', CAST(o_custkey % 80 AS STRING), '`')
  ELSE concat(' dw.dim_', CAST(o_custkey % 80 AS STRING)) END AS table_name FROM orders"""


def pk_lookup(spark, sf):
    names = I.run_sql(spark, sf, _TABLE_NAMES_SQL, orders="orders")
    return with_pk_columns(names, _pk(spark, sf), "table_name").withColumn("pk_cols", F.array_join("pk_cols", ","))


_HOT_SQL = """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 2 THEN 7 WHEN l_linenumber = 3 THEN NULL ELSE l_suppkey END AS s_suppkey
  FROM lineitem"""


def lookup_heavy_key(spark, sf):
    """Lines of which a third and more share one supplier and some have none, with the supplier's name, as a shuffle join."""
    lines, listed = I.run_sql(spark, sf, _HOT_SQL, lineitem="lineitem"), I.run_sql(spark, sf, "SELECT s_suppkey, s_name FROM supplier", supplier="supplier")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        return materialize(skewed_lookup(lines, listed, "s_suppkey"), "heavy")
    finally:
        spark.conf.set(key, before)


# --- script run --------------------------------------------------------------------

_SCRIPT = """SELECT o_orderstatus AS status, count(*) AS n FROM {orders} GROUP BY o_orderstatus;
 ;
SELECT concat(c_mktsegment, ';'), count(*), 'dropped' FROM {customer} GROUP BY c_mktsegment"""


def run_script_query(spark, sf):
    script = _SCRIPT.format(
        orders=f"parquet.`{sf}/orders.parquet`", customer=f"parquet.`{sf}/customer.parquet`"
    )
    return run_script(spark, script)


QUERIES = {
    q.__name__: q
    for q in (
        check_rows, check_rows_at_date, check_count, check_count_at_date, check_count_by_date, check_pk_duplicates,
        check_summary, pivot_eav, pivot_first_encounter, pivot_excel_guard, csv_scan, csv_block_scan, csv_line_scan, csv_report_lines, eav_arity_filter, eav_scan,
        pk_list_parse, pk_list_scan, pk_lookup, lookup_heavy_key,
    )
} | {"run_script": run_script_query}

_AWKWARD = AWKWARD_SQL
ORACLES = {
    "check_rows": "SELECT * FROM orders",
    "check_rows_at_date": f"SELECT * FROM orders WHERE {BASE_SQL}",
    "check_count": "SELECT count(1) AS count FROM lineitem",
    "check_count_at_date": f"SELECT count(1) AS count FROM orders WHERE {BASE_SQL}",
    "check_count_by_date": "SELECT o_orderdate, count(1) AS count FROM orders GROUP BY o_orderdate ORDER BY o_orderdate DESC",
    "check_pk_duplicates": "SELECT l_orderkey, l_linenumber, count(1) AS count FROM lineitem GROUP BY 1, 2 HAVING count(1) > 1",
    "check_summary": f"SELECT count(1) AS count, count(1) FILTER (WHERE {BASE_SQL}) AS count_at_date FROM orders",
    "pivot_eav": _PIVOT_SQL,
    "pivot_first_encounter": _PIVOT_SQL.replace(" FROM (", ", row_number() OVER (ORDER BY min(event_id)) AS line FROM (", 1),
    "pivot_excel_guard": f"""SELECT application, "group", job, error, purchase, signup,
      CASE WHEN click <> '' THEN concat('="', click, '"') ELSE click END AS click,
      CASE WHEN view <> '' THEN concat('="', view, '"') ELSE view END AS view FROM ({_PIVOT_SQL})""",
    "csv_scan": _AWKWARD,
    "csv_block_scan": _AWKWARD,
    "csv_line_scan": """SELECT CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('k', CAST(c_custkey AS VARCHAR)) END AS id,
      CASE WHEN c_custkey % 4 = 1 THEN concat('ab, "', c_name, '"') WHEN c_custkey % 4 = 3 THEN c_mktsegment ELSE '' END AS note FROM customer""",
    "csv_report_lines": f"""SELECT 'id,name,segment' AS value UNION ALL
      SELECT concat(id, ',"', replace(name, '"', '""'), '",', replace(segment, chr(10), '|')) FROM ({_AWKWARD})""",
    "eav_arity_filter": _EAV_ORACLE.format(extra=", event_id"),
    "eav_scan": _EAV_ORACLE.format(extra=""),
    "pk_list_parse": I.PK_LIST_SQL,
    "pk_list_scan": I.PK_LIST_SQL,
    "pk_lookup": f"""SELECT n.o_orderkey, n.table_name, p.pk_cols FROM ({_TABLE_NAMES_SQL}) n
      LEFT JOIN ({I.PK_LIST_SQL}) p ON p.table_key = upper(trim(replace(n.table_name, '`', '')))""",
    "lookup_heavy_key": f"SELECT l.*, s.s_name FROM ({_HOT_SQL}) l LEFT JOIN supplier s ON l.s_suppkey = s.s_suppkey",
    "run_script": """SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1
      UNION ALL SELECT concat(c_mktsegment, ';'), count(*) FROM customer GROUP BY 1""",
}
