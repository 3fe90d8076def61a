"""Corpora of SQL scripts: one row per script."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.text import file_name
from tallyline.session import charset_support, materialize

# File-name globs of the jobs.
SQL = "*.sql"
SQL_ANY_CASE = "*.[sS][qQ][lL]"
SQL_OR_BQ = "*.{sql,bq}"
ANY = "*"

_REPLACEMENT = "\ufffd"


def _relative(path: Column, root: str) -> Column:
    """The path below ``root``; the file name where ``root`` is the file itself."""
    bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/")
    at = F.instr(path, bare + "/")
    below = F.substring(path, at + F.lit(len(bare) + 1), F.length(path))
    return F.when(at > 0, below).otherwise(file_name(path))


def _expressed(content: str, charset: str, out: str) -> Column:
    """Whether all bytes of ``content`` mean something; a text that already held U+FFFD encodes back to the same bytes."""
    return ~F.contains(F.col(out), F.lit(_REPLACEMENT)) | (F.encode(F.col(out), charset) == F.col(content))


def decode_text(spark: SparkSession, df: DataFrame, content: str, charset: str, out: str, *, strict: bool = False) -> DataFrame:
    """Add ``out``: the bytes of ``content`` read in ``charset``.

    Bad bytes become U+FFFD; with ``strict`` a row with bad bytes is dropped, as
    a file that cannot be read is skipped.
    """
    with charset_support(spark):
        decoded = df.withColumn(out, F.decode(F.col(content), charset))
        return decoded.where(_expressed(content, charset, out)) if strict else decoded


def encode_text(spark: SparkSession, df: DataFrame, text: str, charset: str, out: str, *, strict: bool = False) -> DataFrame:
    """Add ``out``: ``text`` as bytes in ``charset``.

    What the charset cannot express becomes ``?``; with ``strict`` such a row is dropped.
    """
    with charset_support(spark):
        encoded = df.withColumn(out, F.encode(F.col(text), charset))
        return encoded.where(F.decode(F.col(out), charset) == F.col(text)) if strict else encoded


def read_scripts(
    spark: SparkSession,
    path: str,
    *,
    glob: str = SQL,
    charset: str = "UTF-8",
    strict: bool = False,
    max_bytes: int | None = None,
) -> DataFrame:
    """Scripts below a folder (or one file) as (path, name, length, raw).

    ``path`` is relative to the folder. Files that cannot be read are left
    out; :func:`skipped_scripts` lists them. A size limit is checked on the file listing, before any content is read.
    """
    files = (
        spark.read.format("binaryFile")
        .options(recursiveFileLookup=True, pathGlobFilter=glob, ignoreCorruptFiles=True)
        .load(path)
    )
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    named = files.select(_relative(F.col("path"), path).alias("path"), file_name(F.col("path")).alias("name"), "length", "content")
    return decode_text(spark, named, "content", charset, "raw", strict=strict).drop("content")


def _found(spark: SparkSession, path: str, glob: str, charset: str, strict: bool, max_bytes: int | None) -> tuple[DataFrame, DataFrame]:
    """The listing (``file``, ``path``, ``length``, ``large``), and what could be read of it: (``file``, ``raw``, ``bad``)."""
    reader = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=glob)
    large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    listed = reader.load(path).select(F.col("path").alias("file"), _relative(F.col("path"), path).alias("path"), "length", large.alias("large"))
    files = reader.options(ignoreCorruptFiles=True).load(path).where(~large)
    # The condition keeps the content in the plan whatever is asked for, so every file is opened.
    opened = files.where(F.octet_length("content") >= 0).select(F.col("path").alias("file"), "content")
    with charset_support(spark):
        decoded = opened.withColumn("raw", F.decode("content", charset))
        bad = ~_expressed("content", charset, "raw") if strict else F.lit(False)
        return listed, decoded.select("file", "raw", bad.alias("bad"))


_SCANNED = ("path", "name", "length", "raw", "reason")


def scan_scripts(
    spark: SparkSession,
    path: str,
    *,
    glob: str = SQL,
    charset: str = "UTF-8",
    strict: bool = False,
    max_bytes: int | None = None,
) -> DataFrame:
    """Every file of some bytes below ``path`` once (Spark's readers pass over empty ones): (path, name, length, raw, reason), of which ``raw`` or ``reason`` is null.

    ``reason`` is ``too large``, ``unreadable`` or ``not <charset>``. Contents are read in one pass, as this is called, and
    stored, so :func:`accepted` and :func:`rejected` are two views of the same reading; what the pass has not come back
    with is told by the listing, which opens no file.
    """
    listed, found = _found(spark, path, glob, charset, strict, max_bytes)
    raw = F.when(~F.col("bad"), F.col("raw"))
    stored = materialize(found.select("file", raw.alias("raw"), F.when(F.col("bad"), f"not {charset}").alias("reason")), "scripts")
    facts = listed.select("file", "path", file_name(F.col("path")).alias("name"), "length", "large")
    read = stored.join(facts, "file").select(*_SCANNED)
    lost = facts.join(stored.select("file"), "file", "left_anti")
    reason = F.when(F.col("large"), "too large").otherwise("unreadable")
    return read.unionByName(lost.select("path", "name", "length", F.lit(None).cast("string").alias("raw"), reason.alias("reason")))


def accepted(scanned: DataFrame) -> DataFrame:
    """The scripts of :func:`scan_scripts`, in the shape of :func:`read_scripts`."""
    return scanned.where("reason is null").drop("reason")


def rejected(scanned: DataFrame) -> DataFrame:
    """The files that :func:`scan_scripts` found no text in: (path, length, reason)."""
    return scanned.where("reason is not null").select("path", "length", "reason")


def skipped_scripts(
    spark: SparkSession,
    path: str,
    *,
    glob: str = SQL,
    charset: str = "UTF-8",
    strict: bool = False,
    max_bytes: int | None = None,
) -> DataFrame:
    """Files that :func:`read_scripts` leaves out with the same arguments: (path, length, reason), reasons as in :func:`scan_scripts`.

    Reads the contents and stores nothing; :func:`scan_scripts` is for those who want the texts too.
    """
    listed, found = _found(spark, path, glob, charset, strict, max_bytes)
    told = listed.join(found.select("file", "bad"), "file", "left")
    reason = F.when(F.col("large"), "too large").when(F.col("bad").isNull(), "unreadable").when(F.col("bad"), f"not {charset}")
    return told.select("path", "length", reason.alias("reason")).where("reason is not null")


def scripts_from_table(df: DataFrame, path: Column, text: Column) -> DataFrame:
    """Scripts already held in a table, in the shape of :func:`read_scripts`."""
    return df.select(path.alias("path"), text.alias("raw")).select(
        "path", file_name(F.col("path")).alias("name"), F.octet_length("raw").cast("long").alias("length"), "raw"
    )
