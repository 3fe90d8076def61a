"""CSV tables as all-string DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.text import MARK, trim_blanks
from tallyline.operators.joins import lookup
from tallyline.session import charset_support
from tallyline.sources.csv_blocks import block_facts, file_lines, outside_quotes

ROW_ORDER = "_row_order"
_RECORD = "\ufffe"


def scan_order() -> Column:
    """A sort key that follows the rows of each file.

    A split is read by one task from start to end, so the running id orders the
    rows within it; splits of a file are ordered by their first byte.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _marked(text: Column, line_breaks: bool) -> Column:
    """The text without its quotes: commas outside them are marks, line breaks there record marks.

    A quote opens and closes wherever it stands. Cutting at the quotes puts the
    quoted parts at odd places; an empty part between two of them is a doubled
    quote, which stands for itself.
    """

    def piece(part: Column, i: Column, count: Column) -> Column:
        plain = F.replace(part, F.lit(","), F.lit(MARK))
        if line_breaks:
            plain = F.regexp_replace(plain, r"\r\n?|\n", _RECORD)
        doubled = (part == "") & (i > 0) & (i < count - 1)
        return F.when(i % 2 == 1, part).when(doubled, F.lit('"')).otherwise(plain)

    cut = _let(F.split(text, '"', -1), lambda parts: F.transform(parts, lambda part, i: piece(part, i, F.size(parts))))
    return F.when(F.contains(text, F.lit('"')), F.array_join(cut, "")).otherwise(piece(text, F.lit(0), F.lit(1)))


def csv_fields(line: Column) -> Column:
    """The fields of one CSV line, quotes resolved; an empty line is one empty field."""
    return F.split(_marked(line, False), MARK, -1)


def csv_records(text: Column) -> Column:
    """The records of a whole CSV text, each an array of fields; line breaks inside quotes stay as they are."""
    records = F.split(_marked(text, True), _RECORD, -1)
    ended = _let(records, lambda all: F.when((F.element_at(all, -1) == "") & ~text.endswith('"'), F.slice(all, 1, F.size(all) - 1)).otherwise(all))
    return F.transform(ended, lambda record: F.split(record, MARK, -1))


def _without_bom(text: Column) -> Column:
    return F.when(text.startswith("\ufeff"), F.substring(text, 2, 2**31 - 1)).otherwise(text)


def _whole_records(spark: SparkSession, path: str, charset: str) -> DataFrame:
    """(file, at, fields) of every record; a file is read by one task."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    with charset_support(spark):
        texts = files.select("file", _without_bom(F.decode("content", charset)).alias("text"))
    return texts.select("file", F.posexplode(csv_records(F.col("text"))).alias("at", "fields"))


#: Charsets in which a byte of a quote or a line feed is not always one: their files are read whole.
_WIDE_CHARSETS = ("UTF-16", "UTF-32", "UTF16", "UTF32", "UCS-2", "UNICODE")


def _block_records(spark: SparkSession, path: str, charset: str) -> tuple[DataFrame, DataFrame]:
    """(file, block, at, fields) of every record of files read block by block, and (file, path)."""
    lines = file_lines(spark, path)
    blocks = block_facts(lines)
    text = F.decode("value", charset)
    first = (F.col("block") == 0) & (F.col("at") == 0)
    with charset_support(spark):
        pieces = outside_quotes(lines, blocks).select("file", "block", "at", F.when(first, _without_bom(text)).otherwise(text).alias("text"))
    # The line feed that ended a piece makes a blank line a record of its own.
    records = F.when(F.contains("text", F.lit("\r")), csv_records(F.concat("text", F.lit("\n")))).otherwise(F.array(csv_fields(F.col("text"))))
    found = pieces.select("file", "block", "at", F.posexplode(records).alias("part", "fields"))
    return found, blocks.where("block = 0").select("file", "path")


def _line_records(spark: SparkSession, path: str, charset: str) -> DataFrame:
    """(file, block, row, fields) of every line, split by Spark; a quote that is open at a line's end is an error."""
    raw = spark.read.text(path).select("value", scan_order().alias("order"))
    value = F.col("value")
    if charset.upper() not in ("UTF-8", "UTF8"):
        with charset_support(spark):
            raw = raw.select(F.decode(value.cast("binary"), charset).alias("value"), "order")
    open_quote = F.raise_error(F.concat(F.lit("a quoted value goes over lines, read with multi_line=True: "), F.col("order.file"))).cast("array<string>")
    line = _without_bom(value)
    fields = F.when(F.size(F.split(line, '"', -1)) % 2 == 0, open_quote).otherwise(csv_fields(line))
    return raw.select("order.*", fields.alias("fields"))


#: Files whose first rows are sent to all tasks; beyond it they are joined.
_FIRST_ROWS = 100_000


def read_csv(
    spark: SparkSession,
    path: str,
    *,
    multi_line: bool = False,
    charset: str = "UTF-8",
    row_order: bool = False,
) -> DataFrame:
    """A quoted CSV table with a header row; every value is text and none is null.

    A quote opens and closes wherever it stands, a doubled one inside quotes is
    a quote. Short rows are padded with empty values, a blank line is a row of
    empty values, extra fields are dropped, and of columns with the same name
    the last one counts. The files of a folder must have one header, or reading
    stops with an error. Files split into tasks. A line break inside quotes is
    an error; with ``multi_line`` it belongs to the value, which may go over
    any number of a file's blocks (:mod:`csv_blocks`). A quote that is never
    closed makes the rest of its file one record then. Files in UTF-16 and the
    like are read whole, by one task each, as are compressed ones.

    The headers are looked at when this is called, in one job; ``multi_line``
    counts the quotes of all blocks in a job before it.
    """
    if multi_line and not charset.upper().startswith(_WIDE_CHARSETS):
        rows, paths = _block_records(spark, path, charset)
        head = "block = 0 and at = 0 and part = 0"
        firsts, body = rows.where(head), rows.where(f"not ({head})")
        order = F.struct(F.col("path").alias("file"), "block", F.struct("at", "part").alias("row"))
        if row_order:
            body = lookup(body, paths, "file")
    elif multi_line:
        rows = _whole_records(spark, path, charset)
        firsts = rows.where("at = 0").select("file", "fields")
        body, order = rows.where("at > 0"), F.struct("file", F.lit(0).cast("bigint").alias("block"), F.col("at").cast("bigint").alias("row"))
    else:
        rows = _line_records(spark, path, charset)
        firsts = rows.where("block = 0").groupBy("file").agg(F.min_by("fields", "row").alias("fields"), F.min("row").alias("row"))
        order = F.struct("file", "block", "row")
    seen = firsts.groupBy("fields").agg(F.count(F.lit(1)).alias("files"), F.min("file").alias("file")).take(2)
    if not seen:
        raise ValueError(f"no header row: {path}")
    if len(seen) > 1:
        raise ValueError(f"different headers: {seen[0]['fields']} in {seen[0]['file']}, {seen[1]['fields']} in {seen[1]['file']}")
    if not multi_line:
        heads = firsts.select("file", "row")
        body = rows.join(F.broadcast(heads) if seen[0]["files"] <= _FIRST_ROWS else heads, ["file", "row"], "left_anti")
    positions = {name: i for i, name in enumerate(seen[0]["fields"])}
    cols = [F.coalesce(F.get("fields", F.lit(i)), F.lit("")).alias(name) for name, i in positions.items()]
    if row_order:
        cols.append(order.alias(ROW_ORDER))
    return body.select(*cols)


def read_lines(spark: SparkSession, path: str, *, header: bool = False, charset: str = "UTF-8") -> DataFrame:
    """The physical lines of text files as (line, _row_order); blank lines are dropped.

    The CSV source is used without separator and quotes because it alone can
    leave out the first line of each file while still splitting large files.
    """
    rows = (
        spark.read.schema("line string")
        .options(sep=MARK, quote="", escape="", header=header, encoding=charset)
        .csv(path)
    )
    return rows.select("line", scan_order().alias(ROW_ORDER)).where(F.col("line").isNotNull())


def line_fields(line: Column) -> Column:
    """Fields of one CSV line: quotes toggle and disappear, fields are trimmed.

    Cutting at the quotes puts the quoted parts at odd positions; commas are
    turned into marks at the even ones only.
    """
    parts = F.split(line, '"', -1)
    marked = F.transform(parts, lambda part, i: F.when(i % 2 == 0, F.replace(part, F.lit(","), F.lit(MARK))).otherwise(part))
    return F.transform(F.split(F.array_join(marked, ""), MARK, -1), trim_blanks)


EAV_COLUMNS = ("application", "group", "job", "key", "value")


def eav_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """Key/value rows from lines of at least five fields; further fields are ignored."""
    keep = [c for c in lines.columns if c != line]
    fields = lines.select(*keep, line_fields(F.col(line)).alias("_fields"))
    named = [F.get("_fields", F.lit(i)).alias(name) for i, name in enumerate(EAV_COLUMNS)]
    return fields.select(*named, *keep).where(F.col("value").isNotNull())


def read_eav(spark: SparkSession, path: str, *, charset: str = "UTF-8") -> DataFrame:
    """Key/value rows of a headed line CSV, with ``_row_order``."""
    return eav_rows(read_lines(spark, path, header=True, charset=charset))
