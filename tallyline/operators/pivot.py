"""Key/value rows to one wide row per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.text import csv_field, excel_text, text_or_blank, trim_blanks
from tallyline.sources.csv_files import ROW_ORDER

# The columns of the job report and the two written as spreadsheet text.
JOB_IDS = {"application": "APPLICATION_NM5", "group": "GROUP_NM4", "job": "JOBNAME_NM3"}
JOB_KEYS = ("CMDLINE", "DAYSCAL", "DESCRIPTION", "INCOND", "MONTH", "TIMEFROM", "TIMEUNTIL")
TEXT_GUARDED = ("TIMEFROM", "TIMEUNTIL")

FIRST_SEEN = "_first_seen"


def pivot_last(
    df: DataFrame,
    ids: Sequence[str],
    key: str,
    value: str,
    order: str,
    keys: Sequence[str],
    *,
    first_seen: bool = False,
) -> DataFrame:
    """One row per ``ids`` with a column for each of ``keys``: the last value by ``order``.

    Ids, keys and values are trimmed. A key outside ``keys`` adds no column, yet
    its row still counts for the ids; a key without a row gives the empty text.
    Listing the keys saves the job a plain pivot needs to find them, and the
    last values are combined before the single shuffle.
    """
    named = df.select(
        *[trim_blanks(text_or_blank(F.col(c))).alias(c) for c in ids],
        trim_blanks(text_or_blank(F.col(key))).alias("_key"),
        trim_blanks(text_or_blank(F.col(value))).alias("_value"),
        F.col(order).alias("_order"),
    )
    picked = [
        F.max_by(F.when(F.col("_key") == k, F.col("_value")), F.when(F.col("_key") == k, F.col("_order"))).alias(k)
        for k in keys
    ]
    seen = [F.min("_order").alias(FIRST_SEEN)] if first_seen else []
    wide = named.groupBy(*ids).agg(*picked, *seen)
    return wide.select(*ids, *[F.coalesce(F.col(f"`{k}`"), F.lit("")).alias(k) for k in keys], *([FIRST_SEEN] if seen else []))


def pivot_jobs(rows: DataFrame, *, first_seen: bool = False) -> DataFrame:
    """The fixed ten-column job table from key/value rows."""
    wide = pivot_last(rows, list(JOB_IDS), "key", "value", ROW_ORDER, JOB_KEYS, first_seen=first_seen)
    return wide.withColumnsRenamed(JOB_IDS)


def guard_text(df: DataFrame, columns: Sequence[str] = TEXT_GUARDED) -> DataFrame:
    """Write the named columns as ``="value"`` where they are not empty."""
    return df.withColumns({c: excel_text(F.col(c)) for c in columns})


def job_report_fields(df: DataFrame) -> list[Column]:
    """CSV fields of the job table; guarded values are written unquoted."""
    return [excel_text(F.col(c)) if c in TEXT_GUARDED else csv_field(F.col(c)) for c in df.columns if c != FIRST_SEEN]
