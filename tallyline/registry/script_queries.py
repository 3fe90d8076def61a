"""Queries over the corpus of scripts: lineage, steps, blocks, check texts, statements."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tallyline.functions.names import KEYWORDS, admits_linecount_source
from tallyline.operators import block_reports as BR
from tallyline.operators import blocks as B
from tallyline.operators import check_sql as CS
from tallyline.operators import lineage as L
from tallyline.operators import lineage_reports as LR
from tallyline.operators import steps as S
from tallyline.operators.line_stats import file_line_stats
from tallyline.operators.statements import split_statements
from tallyline.registry import inputs as I
from tallyline.registry.table_queries import _pk
from tallyline.session import materialize, spread

JOINED = LR.joined


def _scripts(spark, sf):
    return I.scripts(spark, sf)


def _clean(spark, sf, rules="std"):
    return L.without_comments(_scripts(spark, sf), rules)


def _sql():
    return F.col(L.SQL), F.col(L.UPPER)


def _lists(extracted):
    return extracted.select("path", JOINED(F.col("sources")).alias("sources"), JOINED(F.col("targets")).alias("targets"))


# --- lineage -----------------------------------------------------------------------


def lineage_targets(spark, sf):
    return _clean(spark, sf).select("path", JOINED(L.target_tables(*_sql())).alias("tables"))


def lineage_delete_nofrom(spark, sf):
    return _clean(spark, sf).select("path", JOINED(L.delete_without_from(*_sql())).alias("tables"))


def lineage_sources(spark, sf):
    return _clean(spark, sf).select("path", JOINED(L.source_tables(*_sql(), drop_ctes=False)).alias("tables"))


def lineage_with_from(spark, sf):
    return _clean(spark, sf).select("path", JOINED(L.with_from_tables(*_sql())).alias("tables"))


def lineage_comma_join(spark, sf):
    return _clean(spark, sf).select("path", JOINED(L.comma_join_tables(F.col(L.SQL))).alias("tables"))


def lineage_cte_names(spark, sf):
    return _clean(spark, sf).select("path", JOINED(L.cte_names(*_sql())).alias("tables"))


def _std(spark, sf):
    return L.extract_tables(_scripts(spark, sf))


def lineage_tables(spark, sf):
    return _lists(_std(spark, sf))


def lineage_long(spark, sf):
    return L.long_form(_std(spark, sf), "path")


def lineage_scan(spark, sf):
    return _lists(L.extract_tables(_scripts(spark, sf), "scan"))


def lineage_simple(spark, sf):
    return _lists(L.extract_tables(_scripts(spark, sf), "simple"))


def lineage_linecount(spark, sf):
    return _lists(L.extract_tables(_scripts(spark, sf), "linecount"))


# Scripts of more than 600,000 characters: a comment and a WITH stand behind all of them.
LONG_SQL = """SELECT concat('s', CAST(s_suppkey AS STRING), '.sql') AS path, concat('SELECT 1 FROM DW.`월마감`, DUAL JOIN WH_A ON 1 JOIN DW.S', CAST(s_suppkey AS STRING), chr(13), chr(10),
  repeat('x = 1 AND ', 60000), ' /* FROM OLD.T */ INSERT INTO DM.L WITH DBA_TABLE AS (SELECT 1 FROM DW.N', CAST(s_nationkey AS STRING), ') SELECT 1 FROM DBA_TABLE') AS raw FROM supplier"""

# So many of them are the work of one task.
LONG_SCRIPTS_A_TASK = 50


def lineage_linecount_long(spark, sf):
    """Long scripts are read to their end."""
    suppliers = spread(I.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), LONG_SCRIPTS_A_TASK)
    return _lists(L.extract_tables(spark.sql(LONG_SQL.replace("FROM supplier", "FROM {supplier}"), supplier=suppliers), "linecount"))


def lineage_file_summary(spark, sf):
    return LR.file_summary(_std(spark, sf), extra=("path",))


def lineage_source_map(spark, sf):
    return LR.source_map(_std(spark, sf), tasks=I.script_tasks(spark, sf))


def lineage_target_map(spark, sf):
    return LR.target_map(_std(spark, sf), tasks=I.script_tasks(spark, sf))


def lineage_source_map_by_path(spark, sf):
    return LR.source_map(_std(spark, sf), key="path")


def lineage_counts(spark, sf):
    return LR.lineage_counts(_std(spark, sf))


def distinct_sources(spark, sf):
    return LR.distinct_sources(file_stats(spark, sf))


def lineage_file_text(spark, sf):
    return LR.file_text(_std(spark, sf))


def lineage_numbered_text(spark, sf):
    """Numbered report; the tables are put in name order first, which the check can reproduce."""
    return LR.numbered_text(L.sorted_tables(L.extract_tables(_scripts(spark, sf), "scan")))


def lineage_numbered_found(spark, sf):
    """Numbered report in the order in which the rules find the tables."""
    return LR.numbered_text(L.extract_tables(_scripts(spark, sf), "scan"))


# --- steps -------------------------------------------------------------------------


def step_split(spark, sf):
    return S.split_steps(_scripts(spark, sf)).drop("name")


def step_count(spark, sf):
    return S.count_steps(_scripts(spark, sf)).select("path", "steps")


def step_tables(spark, sf):
    found = S.step_tables(_scripts(spark, sf))
    return found.select("path", "step", JOINED(F.col("sources")).alias("sources"), JOINED(F.col("targets")).alias("targets"))


def step_lookup(spark, sf):
    found = S.tables_of_step(_scripts(spark, sf), "STEP003")
    return found.select("path", "step", JOINED(F.col("sources")).alias("sources"), JOINED(F.col("targets")).alias("targets"))


def step_table_counts(spark, sf):
    return S.step_counts(S.step_tables(_scripts(spark, sf))).drop("name")


def lineage_step_summary(spark, sf):
    return LR.step_summary(S.step_rows(_scripts(spark, sf)), tasks=I.script_tasks(spark, sf))


def lineage_step_summary_by_path(spark, sf):
    return LR.step_summary(S.step_rows(_scripts(spark, sf)), key="path", tasks=I.script_tasks(spark, sf))


def step_report_lines(spark, sf):
    return LR.step_report_lines(materialize(S.step_rows(_scripts(spark, sf)), "steps"), tasks=I.script_tasks(spark, sf))


def step_summary_pieces(spark, sf):
    """The step summary by file name as numbered rows of 500 characters at most."""
    return LR.step_summary_pieces(materialize(S.step_rows(_scripts(spark, sf)), "steps"), most=500, tasks=I.script_tasks(spark, sf))


def step_text_report(spark, sf):
    return LR.step_files(S.step_rows(_scripts(spark, sf)), tasks=I.script_tasks(spark, sf))


# --- blocks ------------------------------------------------------------------------


def block_split_flat(spark, sf):
    return B.split_flat_blocks(_scripts(spark, sf)).drop("name")


def block_split_nested(spark, sf):
    return B.split_nested_blocks(_scripts(spark, sf)).drop("name")


def _blocks(spark, sf):
    return block_split_nested(spark, sf)


def _facts(spark, sf, version=4):
    return B.block_facts(_blocks(spark, sf), version)


def block_tables(spark, sf):
    return _blocks(spark, sf).select("path", "block_ord", JOINED(B.block_tables(F.col("content"))).alias("items"))


def block_tables_flat(spark, sf):
    flat = block_split_flat(spark, sf)
    return flat.select("path", "block_ord", JOINED(B.block_tables(F.col("content"), 1)).alias("items"))


def block_columns(spark, sf):
    return _blocks(spark, sf).select("path", "block_ord", JOINED(B.block_columns(F.col("content"))).alias("items"))


def block_columns_first(spark, sf):
    """Versions 2 and 3: the first SELECT list and the first SET list only."""
    return _blocks(spark, sf).select("path", "block_ord", JOINED(B.block_columns(F.col("content"), 3)).alias("items"))


def block_conditions(spark, sf):
    return _blocks(spark, sf).select("path", "block_ord", JOINED(B.block_conditions(F.col("content"))).alias("items"))


def _alias_rows(facts):
    return facts.select(
        "path", "block_ord", JOINED(F.transform("aliases", lambda a: F.concat(a["name"], F.lit(" -> "), a["value"]))).alias("items")
    )


def block_aliases(spark, sf):
    return _alias_rows(_facts(spark, sf))


def block_aliases_as(spark, sf):
    """Versions 2 and 3: aliases after AS only."""
    return _alias_rows(_facts(spark, sf, 3))


def block_errors(spark, sf):
    return _facts(spark, sf).select("path", "block_ord", F.array_join("errors", "; ").alias("items"), "begin_count", "end_count")


def block_ragged_report(spark, sf):
    return BR.ragged_report(_facts(spark, sf)).drop("step")


def block_totals(spark, sf):
    return BR.block_totals(_facts(spark, sf))


def block_duplicates(spark, sf):
    """Tables found in more than one block of the whole corpus."""
    return BR.block_duplicates(_facts(spark, sf), "tables", by=()).select("value", "count")


def block_duplicates_by_script(spark, sf):
    return BR.block_duplicates(_facts(spark, sf), "columns").select("path", "value", "count")


def block_html_report(spark, sf):
    return BR.html_report(materialize(_facts(spark, sf), "facts"), tasks=I.script_tasks(spark, sf))


# --- line statistics, check texts, statements --------------------------------------


def file_stats(spark, sf):
    return file_line_stats(_scripts(spark, sf))


def file_line_stats_query(spark, sf):
    stats = file_stats(spark, sf)
    return stats.select(
        "path", "lines", "insert_lines", "step_lines", "ext",
        JOINED(F.col("sources")).alias("sources"), JOINED(F.col("targets")).alias("targets"),
    )


def check_sql_bq(spark, sf):
    return CS.check_statements(_std(spark, sf), _pk(spark, sf), "bq")


def check_sql_oracle(spark, sf):
    return CS.check_statements(_std(spark, sf), _pk(spark, sf), "oracle")


# Names of daily and monthly tables in Hangul, quoted, undotted, and those that the line counter does not take for sources.
_NAMES_SQL = """SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN concat('DM.일실적_', CAST(c_custkey AS STRING)) WHEN 1 THEN concat('dm.월카드_', CAST(c_custkey AS STRING))
  WHEN 2 THEN concat('`DW`.`일월_', CAST(c_custkey AS STRING), '`') WHEN 3 THEN 'DUAL' WHEN 4 THEN concat('WH_', CAST(c_custkey AS STRING), '.월')
  WHEN 5 THEN 'DBA_TABLE' WHEN 6 THEN concat('plain_', CAST(c_custkey AS STRING)) WHEN 7 THEN concat('일.dw.t', CAST(c_custkey AS STRING)) ELSE 'USER_TAB_COLUMNS' END AS name
  FROM customer"""


def check_names(spark, sf):
    """How both dialects write a table, its date column and its keys, and whether the line counter takes the name for a source."""
    names = I.run_sql(spark, sf, _NAMES_SQL, customer="customer")
    keys = F.array(F.lit("a"), F.lit("월"))
    parts = {n: c for d in CS.DIALECTS for n, c in CS.reference_columns(F.col("name"), keys, d).items()}
    return names.select("c_custkey", "name", *[c.alias(n) for n, c in parts.items()], admits_linecount_source(F.col("name")).alias("source"))


def check_sql_file(spark, sf):
    return CS.check_files(_std(spark, sf), _pk(spark, sf))


def statement_split(spark, sf):
    return split_statements(_scripts(spark, sf)).drop("name")


QUERIES = {
    q.__name__: q
    for q in (
        lineage_targets, lineage_linecount_long, lineage_delete_nofrom, lineage_sources, lineage_with_from, lineage_comma_join,
        lineage_cte_names, lineage_tables, lineage_long, lineage_scan, lineage_simple, lineage_linecount,
        lineage_file_summary, lineage_source_map, lineage_target_map, lineage_source_map_by_path, lineage_counts,
        distinct_sources, lineage_file_text, lineage_numbered_text, lineage_numbered_found, step_split, step_count, step_tables, step_lookup,
        step_table_counts, lineage_step_summary, lineage_step_summary_by_path, step_report_lines, step_summary_pieces, step_text_report, block_split_flat,
        block_split_nested, block_tables, block_tables_flat, block_columns, block_columns_first, block_conditions,
        block_aliases, block_aliases_as, block_errors, block_ragged_report, block_totals, block_duplicates,
        block_duplicates_by_script, block_html_report, check_sql_bq, check_sql_oracle, check_names, check_sql_file,
        statement_split,
    )
} | {"file_line_stats": file_line_stats_query}


# --- the same results in SQL ---------------------------------------------------------

_PART = r"(?:[A-Za-z0-9_$\p{L}-]+|`[^`]+`)"
_STD_NAME = rf"(`[^`]+`|{_PART}(?:\.{_PART})*)"
_SCAN_NAME = r"(`[^`]+`|[A-Za-z0-9_$.]+\.`[^`]+`|[A-Za-z0-9_$.]+\.[A-Za-z0-9_$]+|[A-Za-z0-9_$]+)"
_ID = r'(?:`[^`]+`|"[^"]+"|\[[^\]]+\]|[\p{L}0-9_\$]+)'
_SIMPLE_NAME = rf"({_ID}(?:\s*\.\s*{_ID})?)"
_COUNT_NAME = r'([\w".]+)'
_VALID = "length(replace(t, '`', '')) > 1 AND upper(replace(t, '`', '')) NOT IN ({})".format(
    ", ".join(f"'{k}'" for k in KEYWORDS)
)
_TRIMMED = r"regexp_replace(regexp_replace({0}, '^[\x00-\x20]+', ''), '[\x00-\x20]+$', '')"
_NO_BLOCKS = r"regexp_replace({0}, '(?s)/\*.*?\*/', '{1}', 'g')"
_STD_CLEAN = rf"regexp_replace({_NO_BLOCKS.format('{0}', ' ')}, '--.*?(\r?\n|$)', ' ', 'g')"


def _find(name: str, *keywords: str, flags: str = "(?is)") -> str:
    return "flatten([" + ", ".join(rf"regexp_extract_all(sql, '{flags}\b{k}\s+{name}', 1)" for k in keywords) + "])"


_TARGETS = "flatten([{}, regexp_extract_all(sql, '{}', 1)])".format(
    _find(_STD_NAME, r"MERGE\s+INTO", r"INSERT\s+INTO", r"DELETE\s+FROM", "UPDATE"),
    rf"(?is)\bDELETE\s+{_STD_NAME}\s+(?:WHERE|$)",
)
_CTES = "flatten([regexp_extract_all(sql, '{}', 1), regexp_extract_all(sql, '{}', 1)])".format(
    rf"(?is)\bWITH\s+{_STD_NAME}\s+AS\s*\(", rf"(?is),\s*{_STD_NAME}\s+AS\s*\("
)
# Without lookahead the end of the clause is consumed; literals are emptied instead of counting quotes.
_RANGE = r"(?is)\bFROM\s+(.*?)(?:\s+WHERE|\s+GROUP\b|\s+ORDER\b|\s+HAVING\b|\s+UNION\b|\s+LIMIT\b|\s+SELECT\b|\)|;|$)"


def _std_ctes(source: str, keys: str) -> str:
    """CTEs ``tgt``, ``src_all``, ``ctes``, ``src`` of (keys, t) over ``source`` with a column raw."""
    return rf"""clean AS (SELECT {keys}, {_STD_CLEAN.format('raw')} AS sql FROM {source}),
    tgt AS (SELECT DISTINCT {keys}, t FROM (SELECT {keys}, unnest({_TARGETS}) AS t FROM clean) WHERE {_VALID}),
    ctes AS (SELECT DISTINCT {keys}, t FROM (SELECT {keys}, unnest({_CTES}) AS t FROM clean)),
    clauses AS (SELECT {keys}, trim(unnest(regexp_extract_all(regexp_replace(sql, '''[^'']*''', '''''', 'g'), '{_RANGE}', 1))) AS clause FROM clean),
    parts AS (SELECT {keys}, unnest(string_split(regexp_replace(clause, '(?is)^(.+?)JOIN.*$', '\1'), ',')) AS part FROM clauses
      WHERE clause NOT ILIKE '%SELECT%' AND clause NOT ILIKE '%WITH%'),
    comma AS (SELECT DISTINCT {keys}, t FROM (SELECT {keys}, regexp_extract(part, '^\s*{_STD_NAME}', 1) AS t FROM parts) WHERE {_VALID}),
    src_all AS (SELECT DISTINCT {keys}, t FROM (SELECT {keys}, unnest({_find(_STD_NAME, 'FROM', 'JOIN', 'USING')}) AS t FROM clean) WHERE {_VALID}
      UNION SELECT {keys}, t FROM comma),
    src AS (SELECT {keys}, t FROM src_all EXCEPT SELECT {keys}, t FROM ctes)"""


_WITH_STD = f"WITH scripts AS ({I.SCRIPTS_SQL}), {_std_ctes('scripts', 'path, name')}"


def _agg(cte: str, keys: str = "path", out: str = "tables") -> str:
    return f"(SELECT {keys}, string_agg(t, '; ' ORDER BY t) AS {out} FROM {cte} GROUP BY {keys})"


def _per_script(cte: str) -> str:
    return f"{_WITH_STD} SELECT s.path, coalesce(a.tables, '') AS tables FROM scripts s LEFT JOIN {_agg(cte)} a USING (path)"


def _both(with_sql: str, src: str = "src", tgt: str = "tgt", columns: str = "s.path") -> str:
    return f"""{with_sql} SELECT {columns}, coalesce(a.tables, '') AS sources, coalesce(b.tables, '') AS targets
      FROM scripts s LEFT JOIN {_agg(src)} a USING (path) LEFT JOIN {_agg(tgt)} b USING (path)"""


def _simple_rules(clean: str, targets: str, sources: str, shape: str = "t", where: str = "true", where_src: str = "true") -> str:
    return f"""WITH scripts AS ({I.SCRIPTS_SQL}), clean AS (SELECT path, {clean} AS sql FROM scripts),
      tgt AS (SELECT DISTINCT path, {shape} AS t FROM (SELECT path, unnest({targets}) AS t FROM clean) WHERE {where}),
      src AS (SELECT DISTINCT path, {shape} AS t FROM (SELECT path, unnest({sources}) AS t FROM clean) WHERE {where} AND {where_src})"""


_WRITES = (r"INSERT\s+INTO", "UPDATE", r"MERGE\s+INTO", r"DELETE\s+FROM")
_WITH_SCAN = _simple_rules(_NO_BLOCKS.format("raw", " "), _find(_SCAN_NAME, *_WRITES), _find(_SCAN_NAME, "FROM", "JOIN"))
_WITH_SIMPLE = _simple_rules(
    rf"regexp_replace({_NO_BLOCKS.format('raw', ' ')}, '--[^\r\n]*', ' ', 'g')",
    _find(_SIMPLE_NAME, *_WRITES), _find(_SIMPLE_NAME, "FROM", "JOIN"),
    shape="split_part(t, ' ', 1)",
)
_COUNT_CTES = rf"""(SELECT path, upper(replace(unnest(regexp_extract_all(sql, '(?i)\bwith\s+([\w"]+)\s+as\s*\(', 1)), '"', '')) AS t FROM clean)"""
_WITH_COUNT = (
    _simple_rules(
        _NO_BLOCKS.format(r"regexp_replace(raw, '(?m)--.*$', '', 'g')", ""),
        "flatten([{}, {}])".format(
            rf"regexp_extract_all(sql, '(?i)\binsert\s+(?:into\s+)?{_COUNT_NAME}', 1)",
            _find(_COUNT_NAME, "update", r"delete\s+from", r"merge\s+into"),
        ),
        _find(_COUNT_NAME, "(?:from|join)", "using"),
        shape="""upper(replace(t, '"', ''))""",
        where_src="""upper(t) <> 'DUAL' AND NOT starts_with(upper(replace(t, '"', '')), 'WH_') AND contains(t, '.')""",
    )
    + f", src_ok AS (SELECT path, t FROM src EXCEPT SELECT path, t FROM {_COUNT_CTES})"
)


def _map_oracle(one: str, other: str, one_col: str, other_col: str, key: str = "name") -> str:
    return f"""{_WITH_STD} SELECT o.{key} AS program, o.t AS {one_col},
      coalesce(string_agg(DISTINCT x.t, '; ' ORDER BY x.t), '') AS {other_col}
      FROM {one} o LEFT JOIN {other} x ON o.path = x.path GROUP BY o.{key}, o.t"""


_MARKER = r"(?i)(?:/\*\s*STEP(\d+)\s*\*/|--\s*STEP(\d+))"
_STEPS = rf"""scripts AS ({I.SCRIPTS_SQL}),
  cut AS (SELECT path, name, generate_subscripts(m, 1) AS ord, m, b FROM
    (SELECT path, name, regexp_extract_all(raw, '{_MARKER}', 0) AS m, string_split_regex(raw, '{_MARKER}') AS b FROM scripts)),
  all_steps AS (SELECT path, name, ord, concat('STEP', regexp_extract(m[ord], '(\d+)', 1)) AS step, {_TRIMMED.format('b[ord + 1]')} AS body FROM cut),
  named AS (SELECT path, name, step, min(ord) AS first_ord, max_by(body, ord) AS raw FROM all_steps WHERE body <> '' GROUP BY 1, 2, 3),
  steps AS (SELECT path, name, row_number() OVER (PARTITION BY path ORDER BY first_ord) AS step_ord, step, raw FROM named)"""
_WITH_STEPS = f"WITH {_STEPS}, {_std_ctes('steps', 'path, name, step')}"
_WITH_ONE_STEP = f"WITH {_STEPS}, one AS (SELECT * FROM steps WHERE step = 'STEP003'), {_std_ctes('one', 'path, step')}"


def _step_lists(steps: str) -> str:
    return f"""SELECT s.path, s.step, coalesce(a.tables, '') AS sources, coalesce(b.tables, '') AS targets FROM {steps} s
      LEFT JOIN {_agg('src', 'path, step')} a USING (path, step) LEFT JOIN {_agg('tgt', 'path, step')} b USING (path, step)"""


_STEP_TABLES = f"""SELECT s.path, s.name, s.step_ord, s.step, a.tables AS src_list, b.tables AS tgt_list, a.lines AS src_lines, b.lines AS tgt_lines,
  coalesce(a.n, 0) AS n_sources, coalesce(b.n, 0) AS n_targets FROM steps s
  LEFT JOIN (SELECT path, step, string_agg(t, '; ' ORDER BY t) AS tables, string_agg(concat(t, chr(10)), '' ORDER BY t) AS lines, count(*) AS n FROM src GROUP BY 1, 2) a USING (path, step)
  LEFT JOIN (SELECT path, step, string_agg(t, '; ' ORDER BY t) AS tables, string_agg(concat(t, chr(10)), '' ORDER BY t) AS lines, count(*) AS n FROM tgt GROUP BY 1, 2) b USING (path, step)"""
_B = "repeat('=', 60), chr(10)"
_SRC_LINES = "coalesce(src_lines, concat('(No source tables)', chr(10)))"
_TGT_LINES = "coalesce(tgt_lines, concat('(No target tables)', chr(10)))"
_DETAIL = f"concat({_B}, step, chr(10), {_B}, '[Source Tables]', chr(10), {_SRC_LINES}, chr(10), '[Target Tables]', chr(10), {_TGT_LINES})"
_STEP_FILE = f"concat({_B}, step, chr(10), {_B}, chr(10), '[Source Tables]', chr(10), {_SRC_LINES}, chr(10), '[Target Tables]', chr(10), {_TGT_LINES}, chr(10))"


def _step_summary_oracle(key: str) -> str:
    return f"""{_WITH_STEPS}, st AS ({_STEP_TABLES}),
      texts AS (SELECT {key}, string_agg({_DETAIL}, concat(chr(10), chr(10)) ORDER BY path, step_ord) AS steps, count(*) AS total_steps FROM st GROUP BY {key}),
      s_all AS (SELECT {key}, string_agg(DISTINCT t, '; ' ORDER BY t) AS tables FROM src GROUP BY {key}),
      t_all AS (SELECT {key}, string_agg(DISTINCT t, '; ' ORDER BY t) AS tables FROM tgt GROUP BY {key})
      SELECT texts.{key} AS file_name, coalesce(s_all.tables, '') AS source_tables, coalesce(t_all.tables, '') AS target_tables, steps, total_steps
      FROM texts LEFT JOIN s_all USING ({key}) LEFT JOIN t_all USING ({key})"""


# Nested blocks: the generator's own bodies, from after BEGIN up to the last END.
_BODIES = I.step_bodies()


def _content(body: str) -> str:
    return _TRIMMED.format(rf"regexp_replace({body}, '(?s)^\nBEGIN(.*END).*$', '\1')")


_PATH = f"{I.SCRIPT_PATH} AS path"
_NESTED = f"""SELECT path, block_ord, step, content FROM (
  SELECT {_PATH}, 1 AS block_ord, 'STEP001' AS step, {_content(_BODIES['first'])} AS content FROM orders
  UNION ALL SELECT {_PATH}, 2, 'STEP002', {_content(_BODIES['second'])} FROM orders
  UNION ALL SELECT {_PATH}, 3, 'STEP003', {_content(_BODIES['merge'])} FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT {_PATH}, 3, 'STEP001', {_content(_BODIES['update'])} FROM orders WHERE o_orderkey % 3 = 2)"""
_FLAT_RX = r"(?is)(STEP\d{3})\s*BEGIN(.*?)END"
_FLAT = rf"""SELECT path, row_number() OVER (PARTITION BY path ORDER BY first_ord) AS block_ord, step, content, content <> '' AS valid FROM (
  SELECT path, step, min(ord) AS first_ord, max_by(content, ord) AS content FROM (
    SELECT path, ord, n[ord] AS step, {_TRIMMED.format('c[ord]')} AS content FROM (
      SELECT path, generate_subscripts(n, 1) AS ord, n, c FROM (
        SELECT path, regexp_extract_all(raw, '{_FLAT_RX}', 1) AS n, regexp_extract_all(raw, '{_FLAT_RX}', 2) AS c FROM ({I.SCRIPTS_SQL}))))
  GROUP BY path, step)"""


def _ordered(expr: str, source: str = "blocks") -> str:
    """(path, block_ord, ord, v) for every element of a list expression over the content."""
    return f"(SELECT path, block_ord, generate_subscripts(l, 1) AS ord, unnest(l) AS v FROM (SELECT path, block_ord, {expr} AS l FROM {source}))"


def _distinct(rows: str) -> str:
    return f"(SELECT path, block_ord, v, min(ord) AS ord FROM {rows} GROUP BY 1, 2, 3)"


def _no_quotes(expr: str) -> str:
    return f"regexp_replace({expr}, '[`\"'']', '', 'g')"


_TABLE_RX = r"(?i)\b(FROM|JOIN|INTO|UPDATE|MERGE\s+INTO|RENAME\s+TO)\s+([`\w\.]+)"
_TABLE_RX1 = r"(?i)\b(FROM|JOIN|INTO|UPDATE|MERGE INTO)\s+([`\w\.]+)"
_SELECT_RX, _SET_RX = r"(?is)SELECT\s+(.*?)\s+FROM", r"(?is)SET\s+(.*?)\s*(WHERE|;|\n)"
_COND_RX = r"(?is)\b(WHERE|ON)\b\s+(.*?)(\bGROUP BY\b|\bORDER BY\b|;|\n|\bWHEN\b)"
_ALIAS_RX, _ALIAS_AS_RX = r"(?i)(\w+(?:\.\w+)*)\s+(?:AS\s+)?(\w+)", r"(?i)(\w+(?:\.\w+)*)\s+AS\s+(\w+)"


def _table_rows(rx: str) -> str:
    rows = _ordered(f"regexp_extract_all(content, '{rx}', 2)")
    return _distinct(f"(SELECT path, block_ord, ord, {_no_quotes('v')} AS v FROM {rows})")


def _column_rows(limit: str = "") -> str:
    def parts(rx: str, base: int) -> str:
        lists = _ordered(f"regexp_extract_all(content, '{rx}', 1){limit}")
        split = f"(SELECT path, block_ord, ord, string_split(v, ',') AS l FROM {lists})"
        return f"SELECT path, block_ord, {base} + ord * 1000 + generate_subscripts(l, 1) AS ord, unnest(l) AS v FROM {split}"

    selected = f"SELECT path, block_ord, ord, {_no_quotes(_TRIMMED.format('v'))} AS v FROM ({parts(_SELECT_RX, 0)}) WHERE {_TRIMMED.format('v')} <> ''"
    assigned = f"SELECT path, block_ord, ord, {_TRIMMED.format('split_part(v, chr(61), 1)')} AS v FROM ({parts(_SET_RX, 1000000)})"
    return _distinct(f"({selected} UNION ALL {assigned})")


def _condition_rows() -> str:
    rows = _ordered(f"regexp_extract_all(content, '{_COND_RX}', 2)")
    flat = _TRIMMED.format(r"regexp_replace(v, '[\n\t]+', ' ', 'g')")
    return _distinct(f"(SELECT path, block_ord, ord, {flat} AS v FROM {rows})")


def _alias_rows_sql(rx: str) -> str:
    pairs = f"""(SELECT path, block_ord, generate_subscripts(n, 1) AS ord, unnest(n) AS alias, unnest(o) AS original FROM
      (SELECT path, block_ord, regexp_extract_all(content, '{rx}', 2) AS n, regexp_extract_all(content, '{rx}', 1) AS o FROM blocks))"""
    return f"(SELECT path, block_ord, concat(alias, ' -> ', max_by(original, ord)) AS v, min(ord) AS ord FROM {pairs} GROUP BY path, block_ord, alias)"


_BEGINS = r"len(regexp_extract_all(content, '(?i)\bBEGIN\b'))"
_ENDS = r"len(regexp_extract_all(content, '(?i)\bEND\b'))"
_ERRORS = f"""list_filter([
  CASE WHEN NOT regexp_matches(content, '(?i)select|insert|merge') THEN '{B.NO_QUERY}' END,
  CASE WHEN {_BEGINS} <> {_ENDS} THEN concat('{B.UNBALANCED}(', {_BEGINS}, '/', {_ENDS}, ')') END,
  CASE WHEN NOT ends_with(content, ';') THEN '{B.NO_SEMICOLON}' END], lambda x: x IS NOT NULL)"""
_WITH_BLOCKS = f"WITH blocks AS ({_NESTED})"
_WITH_FLAT = f"WITH blocks AS ({_FLAT})"


def _items(with_sql: str, rows: str) -> str:
    return f"""{with_sql} SELECT b.path, b.block_ord, coalesce(i.items, '') AS items FROM blocks b
      LEFT JOIN (SELECT path, block_ord, string_agg(v, '; ' ORDER BY v) AS items FROM {rows} GROUP BY 1, 2) i USING (path, block_ord)"""


def _numbered(rows: str, name: str) -> str:
    return f"(SELECT path, block_ord, row_number() OVER (PARTITION BY path, block_ord ORDER BY ord) AS line, v AS \"{name}\" FROM {rows})"


_LISTS = {
    "table": _table_rows(_TABLE_RX), "column": _column_rows(), "condition": _condition_rows(),
    "alias": _alias_rows_sql(_ALIAS_RX), "error": _ordered(_ERRORS),
}
_RAGGED = f"""{_WITH_BLOCKS}, {", ".join(f'l_{n} AS {_numbered(r, n)}' for n, r in _LISTS.items())},
  ids AS ({" UNION ".join(f"SELECT path, block_ord, line FROM l_{n}" for n in _LISTS)})
  SELECT ids.path, ids.block_ord, ids.line, {", ".join(f"coalesce(\"{n}\", '') AS \"{n}\"" for n in _LISTS)} FROM ids
  {" ".join(f"LEFT JOIN l_{n} USING (path, block_ord, line)" for n in _LISTS)}"""


def _check_lines(table: str, dialect: str) -> str:
    """(stmt_ord, statement) rows for ``table`` with ``pk_cols``, as one list expression."""
    if dialect == "bq":
        ref, date, base = table, "'`기준일자`'", "'parse_date(''%Y%m%d'', ''20260224'')'"
    else:
        ref, date, base = f"replace({table}, '`', '')", "'기준일자'", "'''20260224'''"
    return f"""list_filter([
      concat('select * from ', {ref}, ';'),
      concat('select * from ', {ref}, ' where ', {date}, ' = ', {base}, ';'),
      concat('select count(1) from ', {ref}, ';'),
      concat('select ', {date}, ',count(1) from ', {ref}, ' group by ', {date}, ' order by ', {date}, ' desc;'),
      concat('select count(1) from ', {ref}, ' where ', {date}, ' = ', {base}, ';'),
      CASE WHEN pk_cols IS NOT NULL THEN concat('select ', pk_cols, ',count(1) from ', {ref}, ' group by ', pk_cols, ' having count(1) > 1;') END],
      lambda x: x IS NOT NULL)"""


_WITH_CHECKS = f"""{_WITH_STD}, pk AS ({I.PK_LIST_SQL}),
  listed AS (SELECT path, 'source' AS role, t AS "table" FROM src UNION ALL SELECT path, 'target', t FROM tgt),
  keyed AS (SELECT l.*, pk.pk_cols FROM listed l LEFT JOIN pk ON pk.table_key = upper(replace(l."table", '`', '')))"""


def _check_oracle(dialect: str) -> str:
    return f"""{_WITH_CHECKS} SELECT path, role, "table", generate_subscripts(l, 1) AS statement_ord, unnest(l) AS statement
      FROM (SELECT path, role, "table", {_check_lines('"table"', dialect)} AS l FROM keyed)"""


_RULE = "'/*--------------------*/', chr(10)"


def _check_section(role: str, title: str, dialect: str) -> str:
    return f"""concat({_RULE}, '/*-- {title} : ', coalesce({role}_n, 0), '개 --*/', chr(10), {_RULE}, chr(10), coalesce({role}_{dialect}, ''))"""


_CHECK_FILE = f"""{_WITH_CHECKS},
  texts AS (SELECT path, role, "table", row_number() OVER (PARTITION BY path, role ORDER BY "table") AS n,
    array_to_string({_check_lines('"table"', 'bq')}, chr(10)) AS bq, array_to_string({_check_lines('"table"', 'oracle')}, chr(10)) AS oracle FROM keyed),
  per_role AS (SELECT path, role, count(*) AS n,
    string_agg(concat('/*-- ', n, ') ', "table", ' --*/', chr(10), bq, chr(10), chr(10)), '' ORDER BY n) AS bq,
    string_agg(concat('/*-- ', n, ') ', "table", ' --*/', chr(10), oracle, chr(10), chr(10)), '' ORDER BY n) AS oracle
    FROM texts GROUP BY path, role),
  wide AS (SELECT s.path, a.n AS src_n, a.bq AS src_bq, a.oracle AS src_oracle, b.n AS tgt_n, b.bq AS tgt_bq, b.oracle AS tgt_oracle
    FROM scripts s LEFT JOIN per_role a ON a.path = s.path AND a.role = 'source' LEFT JOIN per_role b ON b.path = s.path AND b.role = 'target')
  SELECT path, concat({_check_section('src', '소스테이블', 'bq')}, {_check_section('tgt', '타겟테이블', 'bq')}) AS bq,
    concat({_check_section('src', '소스테이블', 'oracle')}, {_check_section('tgt', '타겟테이블', 'oracle')}) AS oracle FROM wide"""


def _listing(cte: str) -> str:
    return f"(SELECT path, string_agg(concat(t, chr(10)), '' ORDER BY t) AS lines FROM {cte} GROUP BY path)"


def _in_order(found: str) -> str:
    """The lists ``found`` in the texts of ``clean``, each name at its first place, as numbered lines."""
    firsts = f"SELECT path, t, min(ord) AS ord FROM (SELECT path, generate_subscripts(l, 1) AS ord, unnest(l) AS t FROM (SELECT path, {found} AS l FROM clean)) GROUP BY 1, 2"
    return f"""(SELECT path, string_agg(concat('  ', n, '. ', t, chr(10)), '' ORDER BY n) AS lines
      FROM (SELECT path, t, row_number() OVER (PARTITION BY path ORDER BY ord) AS n FROM ({firsts})) GROUP BY path)"""


def _numbering(cte: str) -> str:
    return f"""(SELECT path, string_agg(concat('  ', n, '. ', t, chr(10)), '' ORDER BY n) AS lines FROM
      (SELECT path, t, row_number() OVER (PARTITION BY path ORDER BY t) AS n FROM {cte}) GROUP BY path)"""


_LINES = "string_split(CASE WHEN ends_with(raw, chr(10)) THEN left(raw, length(raw) - 1) ELSE raw END, chr(10))"

ORACLES = {
    "lineage_targets": _per_script("tgt"),
    "lineage_delete_nofrom": rf"""{_WITH_STD}, del AS (SELECT DISTINCT path, t FROM (SELECT path,
      unnest(regexp_extract_all(sql, '(?is)\bDELETE\s+{_STD_NAME}\s+(?:WHERE|$)', 1)) AS t FROM clean) WHERE {_VALID})
      SELECT s.path, coalesce(a.tables, '') AS tables FROM scripts s LEFT JOIN {_agg('del')} a USING (path)""",
    "lineage_sources": _per_script("src_all"),
    "lineage_with_from": rf"""{_WITH_STD}, wf AS (SELECT DISTINCT path, t FROM (SELECT path,
      unnest(regexp_extract_all(sql, '(?is)\bWITH\s+.*?\bFROM\s+{_STD_NAME}', 1)) AS t FROM clean) WHERE {_VALID})
      SELECT s.path, coalesce(a.tables, '') AS tables FROM scripts s LEFT JOIN {_agg('wf')} a USING (path)""",
    "lineage_comma_join": _per_script("comma"),
    "lineage_cte_names": _per_script("ctes"),
    "lineage_tables": _both(_WITH_STD),
    "lineage_long": f"""{_WITH_STD} SELECT path, 'source' AS role, t AS "table" FROM src UNION ALL SELECT path, 'target', t FROM tgt""",
    "lineage_scan": _both(_WITH_SCAN),
    "lineage_simple": _both(_WITH_SIMPLE),
    "lineage_linecount": _both(_WITH_COUNT, src="src_ok"),
    "lineage_file_summary": f"""{_WITH_STD} SELECT s.name AS file_name, coalesce(a.tables, '') AS source_tables,
      coalesce(b.tables, '') AS target_tables, s.path FROM scripts s LEFT JOIN {_agg('src')} a USING (path) LEFT JOIN {_agg('tgt')} b USING (path)""",
    "lineage_source_map": _map_oracle("src", "tgt", "source_table", "target_tables"),
    "lineage_target_map": _map_oracle("tgt", "src", "target_table", "source_tables"),
    "lineage_source_map_by_path": _map_oracle("src", "tgt", "source_table", "target_tables", "path"),
    "lineage_counts": f"""{_WITH_STD} SELECT (SELECT count(*) FROM scripts) AS files,
      (SELECT count(DISTINCT t) FROM src) AS source_tables, (SELECT count(DISTINCT t) FROM tgt) AS target_tables""",
    "distinct_sources": f"{_WITH_COUNT} SELECT DISTINCT t AS source_table FROM src_ok",
    "lineage_file_text": f"""{_WITH_STD} SELECT s.path, concat('[Source Tables]', chr(10), coalesce(a.lines, ''), chr(10),
      '[Target Tables]', chr(10), coalesce(b.lines, '')) AS content
      FROM scripts s LEFT JOIN {_listing('src')} a USING (path) LEFT JOIN {_listing('tgt')} b USING (path)""",
    "lineage_linecount_long": """SELECT concat('s', CAST(s_suppkey AS VARCHAR), '.sql') AS path,
      list_aggregate(list_sort(['DW.', concat('DW.S', CAST(s_suppkey AS VARCHAR)), concat('DW.N', CAST(s_nationkey AS VARCHAR))]), 'string_agg', '; ') AS sources,
      'DM.L' AS targets FROM supplier""",
    "lineage_numbered_text": f"""{_WITH_SCAN} SELECT s.path, concat('FILE: ', s.path, chr(10), chr(10),
      CASE WHEN b.lines IS NULL THEN '' ELSE concat('[Target Tables]', chr(10), b.lines, chr(10)) END,
      CASE WHEN a.lines IS NULL THEN '' ELSE concat('[Source Tables]', chr(10), a.lines) END) AS content
      FROM scripts s LEFT JOIN {_numbering('src')} a USING (path) LEFT JOIN {_numbering('tgt')} b USING (path)""",
    "lineage_numbered_found": f"""WITH scripts AS ({I.SCRIPTS_SQL}), clean AS (SELECT path, {_NO_BLOCKS.format("raw", " ")} AS sql FROM scripts)
      SELECT s.path, concat('FILE: ', s.path, chr(10), chr(10),
      CASE WHEN b.lines IS NULL AND a.lines IS NULL THEN concat('(추출된 테이블 없음)', chr(10)) ELSE '' END,
      CASE WHEN b.lines IS NULL THEN '' ELSE concat('[Target Tables]', chr(10), b.lines, chr(10)) END,
      CASE WHEN a.lines IS NULL THEN '' ELSE concat('[Source Tables]', chr(10), a.lines) END) AS content
      FROM scripts s LEFT JOIN {_in_order(_find(_SCAN_NAME, "FROM", "JOIN"))} a USING (path) LEFT JOIN {_in_order(_find(_SCAN_NAME, *_WRITES))} b USING (path)""",
    "step_split": f"WITH {_STEPS} SELECT path, step_ord, step, raw AS body FROM steps",
    "step_count": f"WITH {_STEPS} SELECT path, count(*) AS steps FROM all_steps WHERE body <> '' GROUP BY path",
    "step_tables": f"{_WITH_STEPS} {_step_lists('steps')}",
    "step_lookup": f"{_WITH_ONE_STEP} {_step_lists('one')}",
    "step_table_counts": f"{_WITH_STEPS} SELECT path, step_ord, step, n_sources, n_targets FROM ({_STEP_TABLES})",
    "lineage_step_summary": _step_summary_oracle("name"),
    "lineage_step_summary_by_path": _step_summary_oracle("path"),
    "step_text_report": f"""{_WITH_STEPS} SELECT path, string_agg({_STEP_FILE}, '' ORDER BY step_ord) AS content FROM ({_STEP_TABLES}) GROUP BY path""",
    "block_split_flat": _FLAT,
    "block_split_nested": _NESTED,
    "block_tables": _items(_WITH_BLOCKS, _table_rows(_TABLE_RX)),
    "block_tables_flat": _items(_WITH_FLAT, _table_rows(_TABLE_RX1)),
    "block_columns": _items(_WITH_BLOCKS, _column_rows()),
    "block_columns_first": _items(_WITH_BLOCKS, _column_rows("[1:1]")),
    "block_conditions": _items(_WITH_BLOCKS, _condition_rows()),
    "block_aliases": _items(_WITH_BLOCKS, _alias_rows_sql(_ALIAS_RX)),
    "block_aliases_as": _items(_WITH_BLOCKS, _alias_rows_sql(_ALIAS_AS_RX)),
    "block_errors": f"""{_WITH_BLOCKS} SELECT path, block_ord, array_to_string({_ERRORS}, '; ') AS items,
      {_BEGINS} AS begin_count, {_ENDS} AS end_count FROM blocks""",
    "block_ragged_report": _RAGGED,
    "block_totals": f"""{_WITH_BLOCKS} SELECT (SELECT count(*) FROM blocks) AS blocks, (SELECT count(*) FROM {_LISTS['table']}) AS tables,
      (SELECT count(*) FROM {_LISTS['column']}) AS columns, (SELECT count(*) FROM {_LISTS['condition']}) AS conditions,
      (SELECT count(*) FROM {_LISTS['error']}) AS errors""",
    "block_duplicates": f"{_WITH_BLOCKS} SELECT v AS value, count(*) AS count FROM {_LISTS['table']} GROUP BY v HAVING count(*) > 1",
    "block_duplicates_by_script": f"""{_WITH_BLOCKS} SELECT path, v AS value, count(*) AS count FROM {_LISTS['column']}
      GROUP BY path, v HAVING count(*) > 1""",
    "file_line_stats": rf"""{_WITH_COUNT} SELECT s.path, len({_LINES}) AS lines,
      len(list_filter({_LINES}, lambda x: contains(upper(x), 'INSERT'))) AS insert_lines,
      len(list_filter({_LINES}, lambda x: regexp_matches(x, '(?i)vs_jb_step\s*\+1\s*;'))) AS step_lines, 'sql' AS ext,
      coalesce(a.tables, '') AS sources, coalesce(b.tables, '') AS targets
      FROM scripts s LEFT JOIN {_agg('src_ok')} a USING (path) LEFT JOIN {_agg('tgt')} b USING (path)""",
    "check_sql_bq": _check_oracle("bq"),
    "check_sql_oracle": _check_oracle("oracle"),
    "check_names": rf"""SELECT c_custkey, name, CASE WHEN NOT contains(name, '`') AND regexp_matches(name, '[\x{{AC00}}-\x{{D7AF}}]') THEN concat('`', name, '`') ELSE name END AS bq_ref,
      concat('`', CASE WHEN contains(base, '일') THEN '파티션일자' ELSE '기준일자' END, '`') AS bq_date, 'a,`월`' AS bq_keys, replace(name, '`', '') AS oracle_ref,
      CASE WHEN contains(base, '일') THEN '파티션일자' WHEN contains(base, '월') THEN '기준년월' ELSE '기준일자' END AS oracle_date, 'a,월' AS oracle_keys,
      name <> 'DUAL' AND NOT starts_with(name, 'WH_') AND (contains(name, '.') OR name IN ('DBA_TABLE', 'DBA_TAB_COLUMNS', 'USER_TAB_COLUMNS')) AS source
      FROM (SELECT *, split_part(name, '.', -1) AS base FROM ({_NAMES_SQL}))""",
    "check_sql_file": _CHECK_FILE,
    "statement_split": rf"""SELECT path, row_number() OVER (PARTITION BY path ORDER BY ord) AS statement_ord, statement FROM (
      SELECT path, ord, {_TRIMMED.format('v')} AS statement FROM (
        SELECT path, generate_subscripts(l, 1) AS ord, unnest(l) AS v FROM (
          SELECT path, regexp_extract_all(raw, '(?:[^;'']|''[^'']*'')+', 0) AS l FROM ({I.SCRIPTS_SQL})))) WHERE statement <> ''""",
}


def _li(rows: str, name: str, attributes: str = "") -> str:
    return f"""l_{name} AS (SELECT path, block_ord, string_agg(concat('<li{attributes}>', v, '</li>', chr(10)), '' ORDER BY ord) AS items,
      count(*) AS n FROM {rows} GROUP BY 1, 2)"""


def _dups(rows: str, name: str) -> str:
    return f"""d_{name} AS (SELECT path, string_agg(concat(v, '(', n, ')'), ', ' ORDER BY n DESC, block_ord, ord) AS items FROM
      (SELECT path, v, count(*) AS n, min(block_ord) AS block_ord, arg_min(ord, block_ord) AS ord FROM {rows} GROUP BY path, v HAVING count(*) > 1)
      GROUP BY path)"""


_ARROWS = _LISTS["alias"].replace("' -> '", "' → '")
_HTML_PARTS = {"table": _LISTS["table"], "column": _LISTS["column"], "condition": _LISTS["condition"], "alias": _ARROWS}
_HTML = f"""{_WITH_BLOCKS}, {", ".join(_li(rows, name) for name, rows in _HTML_PARTS.items())},
  {_li(_LISTS['error'], 'error', " style=''color:red;''")}, {_dups(_LISTS['table'], 'table')}, {_dups(_LISTS['column'], 'column')},
  sections AS (SELECT b.path, b.block_ord, concat('<hr><h3>', b.step, '</h3>', chr(10),
    '<b>테이블:</b><ul>', chr(10), coalesce(l_table.items, ''), '</ul><b>컬럼:</b><ul>', chr(10), coalesce(l_column.items, ''),
    '</ul><b>조건:</b><ul>', chr(10), coalesce(l_condition.items, ''), '</ul><b>테이블 변경 추적:</b><ul>', chr(10), coalesce(l_alias.items, ''),
    '</ul><b>오류:</b><ul>', chr(10), coalesce(l_error.items, ''), '</ul>', chr(10)) AS text,
    coalesce(l_table.n, 0) AS t, coalesce(l_column.n, 0) AS c, coalesce(l_condition.n, 0) AS w, coalesce(l_error.n, 0) AS e
    FROM blocks b {" ".join(f"LEFT JOIN l_{n} USING (path, block_ord)" for n in (*_HTML_PARTS, "error"))}),
  pages AS (SELECT path, count(*) AS blocks, sum(t) AS t, sum(c) AS c, sum(w) AS w, sum(e) AS e, string_agg(text, '' ORDER BY block_ord) AS body
    FROM sections GROUP BY path)
  SELECT p.path, concat('<html><head><meta charset=''UTF-8''><title>분석 결과</title></head><body>', chr(10),
    '<h1>BigQuery 분석 리포트</h1>', chr(10), '<h2>요약</h2><ul>', chr(10), '<li>STEP 수: ', blocks, '</li>', chr(10),
    '<li>총 테이블 수: ', t, '</li>', chr(10), '<li>총 컬럼 수: ', c, '</li>', chr(10), '<li>총 조건절 수: ', w, '</li>', chr(10),
    '<li>발견된 오류 수: ', e, '</li>', chr(10), '<li>중복 테이블: ', coalesce(d_table.items, ''), '</li>', chr(10),
    '<li>중복 컬럼: ', coalesce(d_column.items, ''), '</li>', chr(10), '</ul>', chr(10), body, '</body></html>', chr(10)) AS content
  FROM pages p LEFT JOIN d_table USING (path) LEFT JOIN d_column USING (path)"""
ORACLES["block_html_report"] = _HTML


ORACLES["step_report_lines"] = f"""{_WITH_STEPS}, st AS ({_STEP_TABLES}),
  s_all AS (SELECT name, string_agg(DISTINCT t, '; ' ORDER BY t) AS tables FROM src GROUP BY name),
  t_all AS (SELECT name, string_agg(DISTINCT t, '; ' ORDER BY t) AS tables FROM tgt GROUP BY name),
  placed AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, step_ord) AS place, count(*) OVER (PARTITION BY name) AS total FROM st)
  SELECT p.name AS file_name, path, CAST(step_ord - 1 AS INTEGER) AS step_ord,
    concat(CASE WHEN place = 1 THEN concat(p.name, ',', coalesce(s_all.tables, ''), ',', coalesce(t_all.tables, ''), ',"') ELSE '' END,
           regexp_replace({_DETAIL}, '\\n$', ''),
           CASE WHEN place = total THEN concat(chr(10), '",', total) ELSE concat(chr(10), chr(10)) END) AS value
  FROM placed p LEFT JOIN s_all USING (name) LEFT JOIN t_all USING (name)"""
ORACLES["step_summary_pieces"] = f"""WITH r AS ({ORACLES["step_report_lines"]}),
  c AS (SELECT *, (length(value) - 1) // 500 AS most, unnest(range(0, (length(value) - 1) // 500 + 1)) AS cut FROM r)
  SELECT file_name, row_number() OVER (PARTITION BY file_name ORDER BY path, step_ord, cut) AS piece,
    substr(value, cut * 500 + 1, 500) AS value, cut = most AS last FROM c"""


def _as_ints(key: str, *columns: str) -> None:
    """Positions and counters are 32-bit in Spark; give the checking side the same type."""
    casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in columns)
    ORACLES[key] = f"SELECT * REPLACE ({casts}) FROM ({ORACLES[key]})"


for _key, _columns in {
    "step_split": ("step_ord",), "step_count": ("steps",), "step_table_counts": ("step_ord", "n_sources", "n_targets"),
    "block_split_flat": ("block_ord",), "block_tables_flat": ("block_ord",), "block_errors": ("begin_count", "end_count"),
    "block_ragged_report": ("line",), "check_sql_bq": ("statement_ord",), "check_sql_oracle": ("statement_ord",),
    "statement_split": ("statement_ord",), "file_line_stats": ("lines", "insert_lines", "step_lines"),
}.items():
    _as_ints(_key, *_columns)

__all__ = ["ORACLES", "QUERIES"]
