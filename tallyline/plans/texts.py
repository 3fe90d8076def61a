"""Rewriting the texts of a corpus: charset, whitespace, comment backticks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.text import strip_comment_backticks, strip_trailing_spaces, tabs_to_spaces
from tallyline.session import charset_support, materialize
from tallyline.sinks.file_tree import write_files, write_tree
from tallyline.sources.scripts import SQL, encode_text, read_scripts, scan_scripts


def rewrite_job(
    spark: SparkSession,
    source: str,
    target: str,
    *,
    from_charset: str = "UTF-8",
    to_charset: str = "UTF-8",
    transform: Callable[[Column], Column] | None = None,
    glob: str = SQL,
    strict: bool = True,
    whole: bool = False,
) -> tuple[int, int]:
    """Read every script, apply ``transform`` to its text and write it under the same relative path.

    With ``strict`` a script that one of the charsets cannot express is left out
    (``skipped_rewrites`` lists them), otherwise what it cannot express is
    replaced. With ``whole`` the target becomes exactly these files, or stays as
    it was if the job fails. Returns the files and bytes written.
    """
    scripts = read_scripts(spark, source, glob=glob, charset=from_charset, strict=strict)
    text = transform(F.col("raw")) if transform else F.col("raw")
    encoded = encode_text(spark, scripts.select("path", text.alias("text")), "text", to_charset, "bytes", strict=strict)
    return (write_tree if whole else write_files)(encoded, target, F.col("path"), F.col("bytes"))


def scan_rewrites(
    spark: SparkSession,
    source: str,
    *,
    from_charset: str = "UTF-8",
    to_charset: str = "UTF-8",
    transform: Callable[[Column], Column] | None = None,
    glob: str = SQL,
) -> DataFrame:
    """What a strict rewrite makes of every file: (path, length, bytes, reason), of which ``bytes`` or ``reason`` is null.

    One reading of the files, stored; the same rows are written by :func:`write_rewrites` and listed by those interested
    in what was left out.
    """
    scanned = scan_scripts(spark, source, glob=glob, charset=from_charset, strict=True)
    text = transform(F.col("raw")) if transform else F.col("raw")
    with charset_support(spark):
        encoded = scanned.select("path", "length", "reason", text.alias("text")).withColumn("bytes", F.encode("text", to_charset))
        lost = F.decode("bytes", to_charset) != F.col("text")
        told = F.when(F.col("reason").isNull() & lost, f"not {to_charset}").otherwise(F.col("reason"))
        tagged = encoded.select("path", "length", "bytes", told.alias("reason"))
    return materialize(tagged.select("path", "length", F.when(F.col("reason").isNull(), F.col("bytes")).alias("bytes"), "reason"), "rewrites")


def write_rewrites(tagged: DataFrame, target: str) -> tuple[int, int]:
    """Write the rows of :func:`scan_rewrites` that have bytes; returns the files and bytes written."""
    return write_files(tagged.where("reason is null"), target, F.col("path"), F.col("bytes"))


def skipped_rewrites(
    spark: SparkSession, source: str, *, from_charset: str = "UTF-8", to_charset: str = "UTF-8", glob: str = SQL
) -> DataFrame:
    """Scripts that a strict :func:`rewrite_job` leaves out: (path, length, reason)."""
    tagged = scan_rewrites(spark, source, from_charset=from_charset, to_charset=to_charset, glob=glob)
    return tagged.where("reason is not null").select("path", "length", "reason")


def euc_kr_to_utf8(spark: SparkSession, source: str, target: str) -> tuple[int, int]:
    return rewrite_job(spark, source, target, from_charset="EUC-KR")


def utf8_to_euc_kr(spark: SparkSession, source: str, target: str) -> tuple[int, int]:
    return rewrite_job(spark, source, target, to_charset="EUC-KR")


def remove_trailing_spaces(spark: SparkSession, source: str, target: str) -> tuple[int, int]:
    return rewrite_job(spark, source, target, transform=strip_trailing_spaces)


def expand_tabs(spark: SparkSession, source: str, target: str, width: int = 4) -> tuple[int, int]:
    return rewrite_job(spark, source, target, transform=lambda c: tabs_to_spaces(c, width))


def remove_comment_backticks(
    spark: SparkSession, source: str, target: str, *, from_charset: str = "MS949", to_charset: str = "MS949"
) -> tuple[int, int]:
    return rewrite_job(
        spark, source, target, from_charset=from_charset, to_charset=to_charset,
        transform=strip_comment_backticks, strict=False,
    )
