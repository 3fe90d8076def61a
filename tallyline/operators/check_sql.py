"""Text of the standard checks for the tables of a script, in two dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.arrays import explode_items, posexplode_items, sorted_set
from tallyline.functions.names import date_column, quote_hangul, table_key
from tallyline.operators.joins import fits_broadcast, lookup, skewed_lookup
from tallyline.operators.lineage import long_form

DIALECTS = ("bq", "oracle")
DEFAULT_BASE_DATE = "20260224"


def with_pk_columns(tables: DataFrame, pk_list: DataFrame | None, table: str = "table") -> DataFrame:
    """Add ``pk_cols`` of each table; null where the list does not hold it.

    A list is counted first, in one job over its own lines: one that fits is sent to the tasks. The tables then neither
    move nor are extracted a second time for the sketch of heavy keys that a shuffle join takes.
    """
    if pk_list is None:
        return tables.withColumn("pk_cols", F.lit(None).cast("array<string>"))
    keyed = tables.withColumn("table_key", table_key(F.col(table)))
    if fits_broadcast(pk_list):
        return lookup(keyed, pk_list, "table_key", broadcast=True).drop("table_key")
    return skewed_lookup(keyed, pk_list, "table_key").drop("table_key")


def reference_columns(table: Column, pk_cols: Column, dialect: str) -> dict[str, Column]:
    """How the dialect writes a table, its date column and its key columns (null without a key)."""
    if dialect == "bq":
        # Every date column is Hangul, so it is always in backticks here.
        date = F.concat(F.lit("`"), date_column(table, dialect), F.lit("`"))
        ref, keys = quote_hangul(table), F.transform(pk_cols, quote_hangul)
    elif dialect == "oracle":
        date, ref, keys = date_column(table, dialect), F.replace(table, F.lit("`"), F.lit("")), pk_cols
    else:
        raise ValueError(f"unknown dialect: {dialect}")
    return {
        f"{dialect}_ref": ref, f"{dialect}_date": date,
        f"{dialect}_keys": F.when(F.size(pk_cols) > 0, F.array_join(keys, ",")),
    }


def statements_of(ref: Column, date: Column, keys: Column, dialect: str, base_date: str) -> list[Column]:
    """The check statements of one table, in order; the last is null without a key."""
    base = f"parse_date('%Y%m%d', '{base_date}')" if dialect == "bq" else f"'{base_date}'"
    at_base = F.concat(F.lit(" where "), date, F.lit(f" = {base};"))
    return [
        F.concat(F.lit("select * from "), ref, F.lit(";")),
        F.concat(F.lit("select * from "), ref, at_base),
        F.concat(F.lit("select count(1) from "), ref, F.lit(";")),
        F.concat(
            F.lit("select "), date, F.lit(",count(1) from "), ref,
            F.lit(" group by "), date, F.lit(" order by "), date, F.lit(" desc;"),
        ),
        F.concat(F.lit("select count(1) from "), ref, at_base),
        F.concat(
            F.lit("select "), keys, F.lit(",count(1) from "), ref, F.lit(" group by "), keys, F.lit(" having count(1) > 1;")
        ),
    ]


def check_statements(
    extracted: DataFrame, pk_list: DataFrame | None, dialect: str, base_date: str = DEFAULT_BASE_DATE
) -> DataFrame:
    """One row per script, role, table and statement."""
    tables = with_pk_columns(long_form(extracted, "path"), pk_list)
    parts = reference_columns(F.col("table"), F.col("pk_cols"), dialect)
    written = tables.select("path", "role", "table", *[c.alias(n) for n, c in parts.items()])
    statements = statements_of(*[F.col(n) for n in parts], dialect, base_date)
    # Only the last can be null; compacting the array would not be compiled.
    texts = F.when(statements[-1].isNotNull(), F.array(*statements)).otherwise(F.array(*statements[:-1]))
    rows = posexplode_items(written.select("path", "role", "table", texts.alias("_all")), "_all", "_pos", "statement")
    return rows.select(
        "path", "role", "table", (F.col("_pos") + 1).alias("statement_ord"), "statement"
    )


def _section(title: str, entries: Column, dialect: str, base_date: str) -> Column:
    """Heading with the number of tables, then the numbered tables with their statements."""

    def one(entry: Column) -> Column:
        # Names are quoted once per table: within lambdas nothing is shared unless it is bound.
        parts = dict(zip(("ref", "date", "keys"), reference_columns(entry["table"], entry["pk_cols"], dialect).values()))
        bound = F.array(F.struct(*[c.alias(n) for n, c in parts.items()]))
        written = lambda p: F.concat_ws("\n", *statements_of(p["ref"], p["date"], p["keys"], dialect, base_date))
        statements, number = F.get(F.transform(bound, written), F.lit(0)), entry["number"].cast("string")
        return F.concat(F.lit("/*-- "), number, F.lit(") "), entry["table"], F.lit(" --*/\n"), statements, F.lit("\n\n"))

    rule = "/*--------------------*/\n"
    return F.concat(
        F.lit(f"{rule}/*-- {title} : "), F.size(entries).cast("string"), F.lit(f"개 --*/\n{rule}\n"),
        F.array_join(F.transform(entries, one), ""),
    )


def check_files(extracted: DataFrame, pk_list: DataFrame | None, base_date: str = DEFAULT_BASE_DATE) -> DataFrame:
    """(path, bq, oracle): the check file of each script per dialect.

    Tables are numbered in name order, sources before targets. Only names of
    tables and key columns are shuffled: once to meet the key list, unless it is small,
    and once to come together per script; the texts are made after that.
    """

    def numbered(items: str, part: int) -> Column:
        return F.transform(
            sorted_set(F.col(items)),
            lambda t, i: F.struct(F.lit(part).alias("part"), (i + 1).alias("number"), t.alias("table")),
        )

    all_tables = F.concat(numbered("sources", 1), numbered("targets", 2))
    rows = extracted.select("path", F.explode_outer(all_tables).alias("_t")).select("path", "_t.*")
    entry = F.when(F.col("table").isNotNull(), F.struct("part", "number", "table", "pk_cols"))
    named = with_pk_columns(rows, pk_list)
    per_file = named.groupBy("path").agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
    halves = per_file.select(
        "path",
        F.filter("_entries", lambda e: e["part"] == 1).alias("_sources"),
        F.filter("_entries", lambda e: e["part"] == 2).alias("_targets"),
    )
    return halves.select(
        "path",
        *[
            F.concat(
                _section("소스테이블", F.col("_sources"), d, base_date), _section("타겟테이블", F.col("_targets"), d, base_date)
            ).alias(d)
            for d in DIALECTS
        ],
    )


def check_file_rows(files: DataFrame) -> DataFrame:
    """(path, content) for every check file: ``<script>_bq.sql`` and ``<script>_oracle.sql``."""
    base = F.regexp_replace("path", r"\.sql$", "")
    both = F.array(
        *[F.struct(F.concat(base, F.lit(f"_{d}.sql")).alias("path"), F.col(d).alias("content")) for d in DIALECTS]
    )
    return explode_items(files.select(both.alias("_files")), "_files", "_file").select("_file.*")
