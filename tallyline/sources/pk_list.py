"""Primary-key lists: lines of ``table,column,column…``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.names import table_key
from tallyline.functions.text import trim_blanks
from tallyline.sources.csv_files import ROW_ORDER, read_lines


def parse_pk_lines(lines: DataFrame, line: str = "line", order: str = ROW_ORDER) -> DataFrame:
    """(table_key, pk_cols) from list lines; of repeated tables the last line counts.

    Blank lines, ``#`` comments and lines without a column are left out.
    """
    parts = F.split(trim_blanks(F.col(line)), r"\s*,\s*", -1)
    cols = F.filter(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), trim_blanks), lambda c: c != "")
    entries = (
        lines.where(~trim_blanks(F.col(line)).startswith("#"))
        .select(table_key(F.get(parts, F.lit(0))).alias("table_key"), cols.alias("pk_cols"), F.col(order).alias("_order"))
        .where(F.size("pk_cols") > 0)
    )
    return entries.groupBy("table_key").agg(F.max_by("pk_cols", "_order").alias("pk_cols"))


def read_pk_list(spark: SparkSession, path: str, *, charset: str = "UTF-8") -> DataFrame:
    """A key list from a file; a missing file is an empty list."""
    try:
        lines = read_lines(spark, path, charset=charset)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "table_key string, pk_cols array<string>")
    return parse_pk_lines(lines)
