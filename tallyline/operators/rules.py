"""Rule sets: which patterns name the source and target tables of a script.

Spark's regular expressions are Java's, so the patterns below are used by
``regexp_extract_all`` as they stand.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions import names

# Name grammars of the rule sets.
_PART = r"(?:[A-Za-z0-9_$\p{L}-]+|`[^`]+`)"
NAME_STD = rf"(`[^`]+`|{_PART}(?:\.{_PART})*)"
NAME_SCAN = r"(`[^`]+`|[A-Za-z0-9_$.]+\.`[^`]+`|[A-Za-z0-9_$.]+\.[A-Za-z0-9_$]+|[A-Za-z0-9_$]+)"
_ID_SIMPLE = r'(?:`[^`]+`|"[^"]+"|\[[^\]]+\]|[\p{L}0-9_\$]+)'
NAME_SIMPLE = rf"({_ID_SIMPLE}(?:\s*\.\s*{_ID_SIMPLE})?)"
NAME_LINECOUNT = r'([\w".]+)'


@dataclass(frozen=True)
class Pattern:
    """A pattern whose ``group`` is a table name, and a word no match can be without."""

    regex: str
    word: str
    group: int = 1

    def found_in(self, sql: Column, upper_sql: Column) -> Column:
        """All names found; texts without the word are not searched at all."""
        hits = F.regexp_extract_all(sql, F.lit(self.regex), F.lit(self.group))
        return F.when(F.contains(upper_sql, F.lit(self.word)), hits).otherwise(F.array().cast("array<string>"))


def _after(keyword: str, name: str, flags: str = "(?is)") -> Pattern:
    """A name after a keyword, which may go on after its first word.

    The word boundary is looked for behind the word, not before it: most
    places then fail on their first letter.
    """
    word, _, rest = keyword.partition(" ")
    follows = rf"\s+{rest}" if rest else ""
    return Pattern(rf"{flags}{word}(?<=\b{word}){follows}\s+{name}", word.upper())


@dataclass(frozen=True)
class RuleSet:
    """How one family of jobs reads a script.

    ``targets`` and ``sources`` are applied in order. ``ctes`` name tables that
    are no sources. ``clean`` and ``admit`` work on one name; there is nothing
    to clean where the name grammar admits neither blanks nor separators.
    """

    name: str
    comments: str
    targets: tuple[Pattern, ...]
    sources: tuple[Pattern, ...]
    clean: Callable[[Column], Column] | None = None
    ctes: tuple[Pattern, ...] = ()
    admit: Callable[[Column], Column] | None = None
    admit_source: Callable[[Column], Column] | None = None
    comma_joins: bool = False
    unix_newlines: bool = False


# ``JOIN name`` also matches every LEFT, INNER and RIGHT [OUTER] JOIN, and the first
# FROM after a WITH is one of the FROM matches, so neither needs a pattern of its own.
STD = RuleSet(
    name="std",
    comments="std",
    targets=(
        _after("MERGE INTO", NAME_STD),
        _after("INSERT INTO", NAME_STD),
        _after("DELETE FROM", NAME_STD),
        _after("UPDATE", NAME_STD),
        Pattern(rf"(?is)DELETE(?<=\bDELETE)\s+{NAME_STD}\s+(?:WHERE|$)", "DELETE"),
    ),
    sources=(
        _after("FROM", NAME_STD),
        _after("JOIN", NAME_STD),
        _after("USING", NAME_STD),
    ),
    ctes=(
        Pattern(rf"(?is)WITH(?<=\bWITH)\s+{NAME_STD}\s+AS\s*\(", "WITH"),
        Pattern(rf"(?is),\s*{NAME_STD}\s+AS\s*\(", ","),
    ),
    admit=names.is_valid_name,
    comma_joins=True,
)

SCAN = RuleSet(
    name="scan",
    comments="scan",
    targets=(
        _after("INSERT INTO", NAME_SCAN),
        _after("UPDATE", NAME_SCAN),
        _after("MERGE INTO", NAME_SCAN),
        _after("DELETE FROM", NAME_SCAN),
    ),
    sources=(_after("FROM", NAME_SCAN), _after("JOIN", NAME_SCAN)),
)

SIMPLE = RuleSet(
    name="simple",
    comments="simple",
    targets=(
        _after("INSERT INTO", NAME_SIMPLE),
        _after("UPDATE", NAME_SIMPLE),
        _after("MERGE INTO", NAME_SIMPLE),
        _after("DELETE FROM", NAME_SIMPLE),
    ),
    sources=(_after("FROM", NAME_SIMPLE), _after("JOIN", NAME_SIMPLE)),
    clean=lambda name: F.substring_index(name, " ", 1),
)

LINECOUNT = RuleSet(
    name="linecount",
    comments="linecount",
    targets=(
        Pattern(rf"(?i)insert(?<=\binsert)\s+(?:into\s+)?{NAME_LINECOUNT}", "INSERT"),
        _after("update", NAME_LINECOUNT, "(?i)"),
        _after("delete from", NAME_LINECOUNT, "(?i)"),
        _after("merge into", NAME_LINECOUNT, "(?i)"),
    ),
    sources=(
        Pattern(rf"(?i)[fj](?:(?<=\bf)rom|(?<=\bj)oin)\s+{NAME_LINECOUNT}", ""),
        _after("using", NAME_LINECOUNT, "(?i)"),
    ),
    clean=names.upper_name,
    ctes=(Pattern(r'(?i)with(?<=\bwith)\s+([\w"]+)\s+as\s*\(', "WITH"),),
    admit_source=names.admits_linecount_source,
    unix_newlines=True,
)

RULE_SETS = {rules.name: rules for rules in (STD, SCAN, SIMPLE, LINECOUNT)}

# The statistics patterns (no comment removal, names without backticks).
STATS_TABLE = r"(?i)(FROM|JOIN)\s+`?([\w.-]+)`?"
STATS_SELECT_STAR = r"(?i)SELECT\s+\*"

# The first source after a WITH, the range of a FROM clause, and a name in
# a comma-separated list, where a comma inside backticks separates too.
WITH_FROM = Pattern(rf"(?is)\bWITH\s+.*?\bFROM\s+{NAME_STD}", "WITH")
FROM_CLAUSE = (
    r"(?is)FROM(?<=\bFROM)\s+([^\s);]*+.*?)"
    r"(?=\s+(?:WHERE|(?:GROUP|ORDER|HAVING|UNION|LIMIT|SELECT)\b)|[);]|$)"
)
_LIST_PART = r"(?:[A-Za-z0-9_$\p{L}-]+|`[^`,]+`)"
NAME_IN_LIST = rf"(`[^`,]+`|{_LIST_PART}(?:\.{_LIST_PART})*)"


def rule_set(rules: RuleSet | str) -> RuleSet:
    return RULE_SETS[rules] if isinstance(rules, str) else rules
