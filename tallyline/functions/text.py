"""Column expressions over text: trimming, comments, whitespace, charsets, CSV fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The blanks that trimming removes are U+0000 to U+0020.
BLANKS = "".join(chr(code) for code in range(0x21))

# The blanks that end a line, as the class of white space in patterns.
LINE_BLANKS = " \t\n\x0b\f\r"

# Comment patterns of the rule sets.
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
LINE_COMMENT_WITH_NEWLINE = r"--.*?(\r?\n|$)"
LINE_COMMENT_KEEP_NEWLINE = r"--[^\r\n]*"
LINE_COMMENT_TO_LINE_END = r"(?m)--.*$"

# Pieces a script falls into when only comments and literals matter.
_SCRIPT_PIECE = (
    r"--[^\n]*+\n?"
    r"|/\*[\s\S]*?(?:\*/|\z)"
    r"|'[^']*+'?"
    r'|"[^"]*+"?'
    r"|[^-/'\"]++"
    r"|[-/]"
)

# U+FFFF is a noncharacter, so it can mark a place inside real text.
MARK = "\uffff"


def text_or_blank(col: Column) -> Column:
    """The value as text, null as the empty string."""
    return F.coalesce(col.cast("string"), F.lit(""))


def trim_blanks(col: Column) -> Column:
    """Trim every character up to U+0020 from both ends (Spark's ``trim`` takes spaces only)."""
    return F.btrim(col, F.lit(BLANKS))


def _without(sql: Column, opening: str, comment: str, by: str) -> Column:
    """``sql`` with ``by`` for every match; a text that does not hold the opening letters is not searched."""
    return F.when(F.contains(sql, F.lit(opening)), F.regexp_replace(sql, comment, by)).otherwise(sql)


def strip_comments(sql: Column, style: str = "std") -> Column:
    """Remove SQL comments the way the named rule set does.

    ``std``        block comments, then line comments with their newline; both become a space
    ``scan``       block comments only
    ``simple``     block, then line comments; newlines stay
    ``linecount``  line comments first, then block comments; both leave nothing
    ``none``       nothing
    """
    if style == "none":
        return sql
    if style == "scan":
        return _without(sql, "/*", BLOCK_COMMENT, " ")
    if style == "std":
        return _without(_without(sql, "/*", BLOCK_COMMENT, " "), "--", LINE_COMMENT_WITH_NEWLINE, " ")
    if style == "simple":
        return _without(_without(sql, "/*", BLOCK_COMMENT, " "), "--", LINE_COMMENT_KEEP_NEWLINE, " ")
    if style == "linecount":
        return _without(_without(sql, "--", LINE_COMMENT_TO_LINE_END, ""), "/*", BLOCK_COMMENT, "")
    raise ValueError(f"unknown comment style: {style}")


def strip_comment_backticks(sql: Column) -> Column:
    """Remove backticks inside comments; code and quoted literals keep theirs."""
    pieces = F.regexp_extract_all(sql, F.lit(_SCRIPT_PIECE), F.lit(0))
    cleaned = F.transform(
        pieces,
        lambda piece: F.when(
            piece.startswith("--") | piece.startswith("/*"), F.translate(piece, "`", "")
        ).otherwise(piece),
    )
    return F.when(F.contains(sql, F.lit("`")), F.array_join(cleaned, "")).otherwise(sql)


def strip_trailing_spaces(content: Column) -> Column:
    """Remove trailing whitespace (a carriage return included) from every line."""
    lines = F.split(content, "\n", -1)
    return F.array_join(F.transform(lines, lambda line: F.rtrim(line, F.lit(LINE_BLANKS))), "\n")


def tabs_to_spaces(content: Column, width: int) -> Column:
    """Replace every tab by ``width`` spaces."""
    return F.replace(content, F.lit("\t"), F.lit(" " * width))


def normalize_newlines(content: Column) -> Column:
    """Line breaks as ``\\n``, and a final one after the last line of a non-empty text."""
    unix = F.when(
        F.contains(content, F.lit("\r")), F.regexp_replace(content, r"\r\n?", "\n")
    ).otherwise(content)
    return F.when((unix == "") | unix.endswith("\n"), unix).otherwise(F.concat(unix, F.lit("\n")))


def lines_of(content: Column) -> Column:
    """The lines of a text as an array; a final newline opens no further line."""
    unix = normalize_newlines(content)
    return F.when(unix == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(unix, r"\n\z", ""), "\n", -1)
    )


def csv_field(col: Column) -> Column:
    """Quote a CSV field only where it holds a comma, a quote or a line break."""
    value = text_or_blank(col)
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[,"\\n\\r]'), quoted).otherwise(value)


def csv_line(*cols: Column) -> Column:
    """One CSV record as text."""
    return F.concat_ws(",", *[csv_field(c) for c in cols])


def excel_text(col: Column) -> Column:
    """Guard a non-empty value as ``="value"`` so that a spreadsheet keeps it as text."""
    value = text_or_blank(col)
    return F.when(value != "", F.concat(F.lit('="'), value, F.lit('"'))).otherwise(value)


def file_name(path: Column) -> Column:
    """The last part of a path."""
    return F.substring_index(path, "/", -1)


def file_extension(name: Column) -> Column:
    """Lower-case text after the last dot; ``noext`` for none, a leading or a final dot."""
    ext = F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1))
    return F.when(ext == "", F.lit("noext")).otherwise(ext)


def output_name(path: Column, suffix: str) -> Column:
    """Replace a final ``.sql`` by ``suffix``; folders stay."""
    return F.regexp_replace(path, r"\.sql$", suffix)


def base_output_name(path: Column, suffix: str) -> Column:
    """Replace any final extension of the file name by ``suffix``; folders stay."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(suffix))


def shorten(col: Column, size: int) -> Column:
    """Cut a text longer than ``size`` and end it with three dots."""
    return F.when(F.length(col) > size, F.concat(F.substring(col, 1, size - 3), F.lit("..."))).otherwise(col)


def joined_or_dash(items: Column) -> Column:
    """An array joined by ``^``; ``-`` where it is empty."""
    return F.when(F.size(items) == 0, F.lit("-")).otherwise(F.array_join(items, "^"))
