"""Source and target tables of SQL scripts.

Everything here is a projection: one script is one row, and no row moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.arrays import empty_strings, explode_items, sorted_set
from tallyline.functions.names import is_valid_name
from tallyline.functions.text import MARK, normalize_newlines, strip_comments
from tallyline.operators import rules as R
from tallyline.operators.rules import Pattern, RuleSet, rule_set

SQL, UPPER = "_sql", "_upper"
_CLAUSE_END = "\ufffe"


def without_comments(scripts: DataFrame, rules: RuleSet | str = "std", text: str = "raw") -> DataFrame:
    """Add the comment-free text and its upper case, each computed once per script."""
    chosen = rule_set(rules)
    raw = normalize_newlines(F.col(text)) if chosen.unix_newlines else F.col(text)
    return scripts.withColumn(SQL, strip_comments(raw, chosen.comments)).withColumn(UPPER, F.upper(SQL))


def _found(patterns: tuple[Pattern, ...], sql: Column, upper_sql: Column) -> Column:
    arrays = [p.found_in(sql, upper_sql) for p in patterns]
    return F.concat(*arrays) if arrays else empty_strings()


def _marked_clauses(sql: Column) -> Column:
    """The FROM clauses that start outside single quotes, each after a mark; nothing else is left.

    Each clause is first bracketed by two marks. Cutting the text at its quotes
    puts the quoted parts at odd positions, where the opening marks are taken
    out again; then all text outside the brackets is dropped. Every step reads
    the text once, however many clauses it has.
    """
    marked = F.regexp_replace(sql, R.FROM_CLAUSE, f"{MARK}$1{_CLAUSE_END}")
    parts = F.transform(
        F.split(marked, "'", -1),
        lambda part, i: F.when(i % 2 == 1, F.replace(part, F.lit(MARK), F.lit(""))).otherwise(part),
    )
    unquoted = F.when(F.contains(sql, F.lit("'")), F.array_join(parts, "'")).otherwise(marked)
    return F.regexp_replace(unquoted, f"(?:\\A|{_CLAUSE_END})[^{MARK}]*+", "")


def comma_join_clauses(sql: Column) -> Column:
    """FROM clauses that start outside single quotes, as they stand."""
    pieces = F.split(_marked_clauses(sql), MARK, -1)
    return F.slice(pieces, 2, F.size(pieces))


def comma_join_tables(sql: Column) -> Column:
    """First name of each part of the comma-separated FROM clauses.

    Clauses that hold the letters SELECT or WITH are left out; a clause ends at
    its first JOIN, unless it starts with it.
    """
    clauses = _marked_clauses(sql)
    flat = F.regexp_replace(clauses, f"(?i){MARK}[^{MARK}]*?(?:SELECT|WITH)[^{MARK}]*+", "")
    cut = F.regexp_replace(flat, f"(?i)({MARK}(?![\\x00-\\x20]*JOIN)[^{MARK}]*?)JOIN[^{MARK}]*+", "$1")
    firsts = F.regexp_extract_all(cut, F.lit(f"[{MARK},][\\x00-\\x20]*{R.NAME_IN_LIST}"), F.lit(1))
    return F.filter(F.array_distinct(firsts), is_valid_name)


def _admitted(items: Column, chosen: RuleSet) -> Column:
    """Cleaned and admitted names; equal names are settled once."""
    distinct = F.array_distinct(items)
    cleaned = F.transform(distinct, chosen.clean) if chosen.clean else distinct
    return F.filter(cleaned, chosen.admit) if chosen.admit else cleaned


def cte_names(sql: Column, upper_sql: Column, rules: RuleSet | str = "std") -> Column:
    """Names that WITH clauses define, exactly as written."""
    chosen = rule_set(rules)
    found = F.array_distinct(_found(chosen.ctes, sql, upper_sql))
    return F.array_distinct(F.transform(found, chosen.clean)) if chosen.clean else found


def target_tables(sql: Column, upper_sql: Column, rules: RuleSet | str = "std") -> Column:
    """Distinct tables the script changes, in the order the patterns find them."""
    chosen = rule_set(rules)
    return F.array_distinct(_admitted(_found(chosen.targets, sql, upper_sql), chosen))


def source_tables(sql: Column, upper_sql: Column, rules: RuleSet | str = "std", *, drop_ctes: bool = True) -> Column:
    """Distinct tables the script reads, CTE names removed."""
    chosen = rule_set(rules)
    found = _admitted(_found(chosen.sources, sql, upper_sql), chosen)
    if chosen.admit_source:
        found = F.filter(found, chosen.admit_source)
    if chosen.comma_joins:
        listed = F.when(F.contains(sql, F.lit(",")), comma_join_tables(sql)).otherwise(empty_strings())
        found = F.concat(found, listed)
    if drop_ctes and chosen.ctes:
        return F.array_except(found, cte_names(sql, upper_sql, chosen))
    return F.array_distinct(found)


def with_from_tables(sql: Column, upper_sql: Column) -> Column:
    """The first source after each WITH."""
    return F.array_distinct(_admitted(R.WITH_FROM.found_in(sql, upper_sql), R.STD))


def delete_without_from(sql: Column, upper_sql: Column) -> Column:
    """Targets of ``DELETE name WHERE``."""
    return F.array_distinct(_admitted(R.STD.targets[-1].found_in(sql, upper_sql), R.STD))


def extract_tables(scripts: DataFrame, rules: RuleSet | str = "std", text: str = "raw") -> DataFrame:
    """Replace the script text by ``sources`` and ``targets``."""
    chosen = rule_set(rules)
    keep = [c for c in scripts.columns if c != text]
    ready = without_comments(scripts, chosen, text)
    sql, upper_sql = F.col(SQL), F.col(UPPER)
    return ready.select(
        *keep, source_tables(sql, upper_sql, chosen).alias("sources"), target_tables(sql, upper_sql, chosen).alias("targets")
    )


def extract_stats(scripts: DataFrame, text: str = "raw") -> DataFrame:
    """Tables after FROM or JOIN and whether ``SELECT *`` occurs, comments included."""
    keep = [c for c in scripts.columns if c != text]
    return scripts.select(
        *keep,
        F.array_distinct(F.regexp_extract_all(text, F.lit(R.STATS_TABLE), F.lit(2))).alias("tables"),
        F.col(text).rlike(R.STATS_SELECT_STAR).alias("uses_select_all"),
    )


def role_entries() -> Column:
    """(role, table) of every table of a script, as an array."""

    def tagged(role: str) -> Column:
        return F.transform(f"{role}s", lambda t: F.struct(F.lit(role).alias("role"), t.alias("table")))

    return F.concat(tagged("source"), tagged("target"))


def long_form(extracted: DataFrame, *ids: str) -> DataFrame:
    """One row per id, role (``source`` or ``target``) and table."""
    both = extracted.select(*ids, role_entries().alias("_tables"))
    return explode_items(both, "_tables", "_entry").select(*ids, "_entry.*")


def sorted_tables(extracted: DataFrame) -> DataFrame:
    """Sources and targets in name order."""
    return extracted.withColumns({c: sorted_set(F.col(c)) for c in ("sources", "targets")})


__all__ = [
    "comma_join_clauses", "comma_join_tables", "cte_names", "delete_without_from", "extract_stats",
    "extract_tables", "long_form", "role_entries", "sorted_tables", "source_tables", "target_tables", "with_from_tables",
    "without_comments",
]
