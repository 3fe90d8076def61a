"""Line, keyword and table statistics of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.text import file_extension, joined_or_dash, lines_of, shorten
from tallyline.operators.lineage import SQL, UPPER, source_tables, target_tables, without_comments

# Fixed value: the line that advances a job step.
STEP_LINE = r"(?i)vs_jb_step\s*\+1\s*;"


def file_line_stats(scripts: DataFrame, text: str = "raw") -> DataFrame:
    """Lines, INSERT lines, STEP lines, extension, targets and sources of every file."""
    keep = [c for c in scripts.columns if c != text]
    ready = without_comments(scripts, "linecount", text).withColumn("_lines", lines_of(F.col(text)))
    sql, upper_sql = F.col(SQL), F.col(UPPER)
    return ready.select(
        *keep,
        F.size("_lines").alias("lines"),
        F.size(F.filter("_lines", lambda x: F.contains(F.upper(x), F.lit("INSERT")))).alias("insert_lines"),
        F.size(F.filter("_lines", lambda x: x.rlike(STEP_LINE))).alias("step_lines"),
        file_extension(F.col("name")).alias("ext"),
        target_tables(sql, upper_sql, "linecount").alias("targets"),
        source_tables(sql, upper_sql, "linecount").alias("sources"),
    )


def display_stats(stats: DataFrame) -> DataFrame:
    """The statistics as shown: names cut at 30 characters, targets at 20, sources at 30."""
    return stats.select(
        shorten(F.col("name"), 30).alias("name"),
        "lines", "insert_lines", "step_lines", "ext",
        shorten(joined_or_dash(F.col("targets")), 20).alias("targets"),
        shorten(joined_or_dash(F.col("sources")), 30).alias("sources"),
    )


def extension_counts(files: DataFrame) -> DataFrame:
    """Number of files per extension."""
    return files.groupBy(file_extension(F.col("name")).alias("ext")).agg(F.count(F.lit(1)).alias("files"))
