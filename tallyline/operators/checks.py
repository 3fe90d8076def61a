"""The standard checks of a table, run on a DataFrame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType


def _is_base_date(df: DataFrame, date_col: str, base_date: str | dt.date) -> Column:
    """``date_col = base_date`` against a literal of the column's type, so that it reaches the scan."""
    kind = df.schema[date_col].dataType
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        day = dt.datetime.strptime(base_date, "%Y%m%d").date() if isinstance(base_date, str) else base_date
        return F.col(date_col) == F.lit(day).cast(kind)
    text = base_date if isinstance(base_date, str) else base_date.strftime("%Y%m%d")
    return F.col(date_col) == F.lit(text)


def rows_at_date(df: DataFrame, date_col: str, base_date: str | dt.date) -> DataFrame:
    """All rows of the base date (``yyyyMMdd`` or a date)."""
    return df.where(_is_base_date(df, date_col, base_date))


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


def count_at_date(df: DataFrame, date_col: str, base_date: str | dt.date) -> DataFrame:
    return count_rows(rows_at_date(df, date_col, base_date))


def count_by_date(df: DataFrame, date_col: str) -> DataFrame:
    """Rows per date, latest first."""
    return df.groupBy(date_col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc(date_col))


def pk_duplicates(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Key values held by more than one row; counts are combined before the shuffle."""
    return df.groupBy(*pk).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)


def table_checks(
    df: DataFrame, date_col: str, base_date: str | dt.date, pk: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """The five checks of a table, and the key check where its key is known."""
    checks = {
        "rows": df,
        "rows_at_date": rows_at_date(df, date_col, base_date),
        "count": count_rows(df),
        "count_by_date": count_by_date(df, date_col),
        "count_at_date": count_at_date(df, date_col, base_date),
    }
    if pk:
        checks["pk_duplicates"] = pk_duplicates(df, pk)
    return checks


def check_summary(df: DataFrame, date_col: str, base_date: str | dt.date) -> DataFrame:
    """Total count and count at the base date in one scan."""
    return df.agg(
        F.count(F.lit(1)).alias("count"), F.count_if(_is_base_date(df, date_col, base_date)).alias("count_at_date")
    )
