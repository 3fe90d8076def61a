"""CSV output: a plain Spark table, or an ordered report whose parts join to one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.text import csv_field, csv_line

BOM = "\ufeff"
CRLF = "\r\n"
LF = "\n"


def write_csv(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """A CSV folder with a header in every part, for readers that take part files singly.

    Spark's CSV writer turns a line break inside a value into the line ending in
    use; it is ``\\n`` here so that values keep theirs. An empty value of a
    one-column table is written as two quotes, as the writer leaves out what
    would be a blank line.
    """
    alone = len(df.columns) == 1
    rows = df.select(F.coalesce(F.col(f"`{df.columns[0]}`").cast("string"), F.lit("")).alias(df.columns[0])) if alone else df
    (
        rows.write.mode(mode)
        .options(header=True, quote='"', escape='"', emptyValue='""' if alone else "", nullValue="", lineSep=LF)
        .options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(path)
    )


def report_lines(
    df: DataFrame,
    *,
    fields: list[Column] | None = None,
    headers: list[str] | None = None,
    order_by: list[Column] | None = None,
    bom: bool = False,
) -> DataFrame:
    """The report as ordered text lines: the header, then one CSV record per row.

    The header is an ordinary row that sorts first, so a range-sorted write puts
    it at the top of the first part and the parts joined in name order are the
    one file. ``fields`` replace the default quoting of the columns.
    """
    names = headers or df.columns
    shown = [csv_field(F.col(f"`{c}`")) for c in df.columns] if fields is None else fields
    return headed_lines(df, F.concat_ws(",", *shown), names, order_by or [], bom=bom)


def headed_lines(df: DataFrame, line: Column, headers: list[str], order_by: list[Column], *, bom: bool = False) -> DataFrame:
    """Ordered text lines below a header line, which is an ordinary row that sorts first."""
    keys = [f"_k{i}" for i in range(len(order_by))]
    body = df.select(F.lit(1).alias("_part"), *[k.alias(n) for k, n in zip(order_by, keys)], line.alias("value"))
    title = F.concat(F.lit(BOM if bom else ""), csv_line(*[F.lit(n) for n in headers]))
    head = df.sparkSession.range(1).select(
        F.lit(0).alias("_part"),
        *[F.lit(None).cast(body.schema[n].dataType).alias(n) for n in keys],
        title.alias("value"),
    )
    return head.unionByName(body).orderBy("_part", *keys).select("value")


def write_report(df: DataFrame, path: str, *, line_sep: str = LF, mode: str = "errorifexists", **report) -> None:
    """Write :func:`report_lines`; values are written byte for byte."""
    report_lines(df, **report).write.mode(mode).option("lineSep", line_sep).text(path)
