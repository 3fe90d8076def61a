"""Column expressions over table names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.text import trim_blanks

# Words that are never a table name in the standard rule set.
KEYWORDS = (
    "SELECT", "FROM", "WHERE", "INSERT", "UPDATE", "DELETE", "JOIN", "LEFT", "RIGHT",
    "INNER", "OUTER", "ON", "AND", "OR", "NOT", "IN", "EXISTS", "BETWEEN", "LIKE",
    "ORDER", "GROUP", "BY", "HAVING", "LIMIT", "OFFSET", "UNION", "ALL", "DISTINCT",
    "AS", "INTO", "VALUES", "SET", "CASCADE", "RESTRICT", "PUBLIC", "PRIVATE",
    "GRANT", "REVOKE", "COMMIT", "ROLLBACK", "SAVEPOINT", "TRANSACTION", "BEGIN",
    "END", "IF", "THEN", "ELSE", "CASE", "WHEN", "NULL", "TRUE", "FALSE", "USING",
)

# Undotted sources the line counter accepts.
LINECOUNT_ALLOWED = ("DBA_TABLE", "DBA_TAB_COLUMNS", "USER_TAB_COLUMNS")

# The Hangul blocks (syllables, compatibility jamo, jamo).
HANGUL = r"[\uAC00-\uD7AF\u3130-\u318F\u1100-\u11FF]"


def is_valid_name(name: Column) -> Column:
    """At least two characters without backticks, and not a keyword; expects a clean name."""
    bare = F.replace(name, F.lit("`"), F.lit(""))
    return (F.length(bare) > 1) & ~F.upper(bare).isin(*KEYWORDS)


def upper_name(name: Column) -> Column:
    """Trimmed, without double quotes, first word only, upper case."""
    bare = F.replace(trim_blanks(name), F.lit('"'), F.lit(""))
    return F.upper(F.substring_index(bare, " ", 1))


def admits_linecount_source(name: Column) -> Column:
    """Dotted or allowed names, but not DUAL and not names starting with ``WH_``."""
    return (
        (name != "DUAL")
        & ~name.startswith("WH_")
        & (F.contains(name, F.lit(".")) | name.isin(*LINECOUNT_ALLOWED))
    )


def table_key(name: Column) -> Column:
    """The form under which a table is looked up: no backticks, trimmed, upper case."""
    return F.upper(trim_blanks(F.replace(name, F.lit("`"), F.lit(""))))


def base_name(name: Column) -> Column:
    """The part after the last dot, without backticks."""
    return F.replace(F.substring_index(name, ".", -1), F.lit("`"), F.lit(""))


def quote_hangul(name: Column) -> Column:
    """Backtick a name that holds Hangul, unless it has a backtick already."""
    needs = ~F.contains(name, F.lit("`")) & name.rlike(HANGUL)
    return F.when(needs, F.concat(F.lit("`"), name, F.lit("`"))).otherwise(name)


def date_column(name: Column, dialect: str) -> Column:
    """The date column a table is checked on, told from its name."""
    base = base_name(name)
    daily = F.contains(base, F.lit("일"))
    if dialect == "oracle":
        return (
            F.when(daily, F.lit("파티션일자"))
            .when(F.contains(base, F.lit("월")), F.lit("기준년월"))
            .otherwise(F.lit("기준일자"))
        )
    return F.when(daily, F.lit("파티션일자")).otherwise(F.lit("기준일자"))
