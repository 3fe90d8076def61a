"""Keyed comparison of two tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import SparkRuntimeException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, IntegralType, StringType

from tallyline.functions.text import text_or_blank, trim_blanks
from tallyline.sources.csv_files import ROW_ORDER

RESULT, DIFF_DETAIL = "RESULT", "DIFF_DETAIL"
MATCHED, MISMATCHED = "MATCHED", "MISMATCHED"
ONLY_IN_FILE1, ONLY_IN_FILE2 = "ONLY_IN_FILE1", "ONLY_IN_FILE2"

Keys = Sequence[str] | Callable[[DataFrame], list[Column]] | None


#: Raised when the result is computed: a key occurs more than once on one side. The message names side and key.
DuplicateKeyError = SparkRuntimeException


def unified_columns(df1: DataFrame, df2: DataFrame) -> list[str]:
    """Columns of side 1 in order, then those only side 2 has."""
    return [c for c in dict.fromkeys([*df1.columns, *df2.columns]) if c != ROW_ORDER]


def default_key(df1: DataFrame, df2: DataFrame) -> list[str]:
    """The first column of side 1, which side 2 must have too."""
    cols = [c for c in df1.columns if c != ROW_ORDER]
    if not cols or not df2.columns:
        raise ValueError("a table has no columns")
    if cols[0] not in df2.columns:
        raise ValueError(f"no key given and column {cols[0]!r} is missing on side 2; name the key columns")
    return [cols[0]]


def resolve_keys(df1: DataFrame, df2: DataFrame, keys: Keys) -> Sequence[str] | Callable[[DataFrame], list[Column]]:
    """Key columns checked on both sides, or the default key, or the caller's function."""
    if callable(keys):
        return keys
    if not keys:
        return default_key(df1, df2)
    for key in keys:
        if key not in df1.columns or key not in df2.columns:
            raise ValueError(f"key column must exist on both sides: {key}")
    return list(keys)


def _col(df: DataFrame, name: str) -> Column:
    return df[f"`{name}`"]


def _renders_uniquely(a: DataType, b: DataType) -> bool:
    """Same type, and equal values exactly where their texts are equal and free of blanks."""
    return a == b and isinstance(a, (IntegralType, BooleanType, DateType))


@dataclass(frozen=True)
class _Keys:
    """Both sides with their key columns, none of which is null where nulls are allowed for.

    Text keys take null as the empty text. Whole numbers, booleans and dates
    keep their type; where they may be null, a second column tells it. Keys
    that cannot be null, by their schema or by the caller's word, are used as
    stored, so tables bucketed by them join without a shuffle.
    """

    side1: DataFrame
    side2: DataFrame
    names: list[str]
    shown: list[str]

    def match(self, a: DataFrame, b: DataFrame) -> Column:
        return reduce(lambda x, y: x & y, [a[n] == b[n] for n in self.names])


def _key_columns(df: DataFrame, name: str, native: bool, stored: bool, i: int) -> list[Column]:
    col = _col(df, name)
    if stored:
        return [col.alias(f"_k{i}")]
    if not native:
        return [text_or_blank(col).alias(f"_k{i}")]
    kind = df.schema[name].dataType
    blank = F.lit("1970-01-01").cast(kind) if isinstance(kind, DateType) else F.lit(0).cast(kind)
    return [F.coalesce(col, blank).alias(f"_k{i}"), col.isNull().alias(f"_n{i}")]


def _keyed(df1: DataFrame, df2: DataFrame, keys: Keys, *, null_keys: bool = True) -> _Keys:
    resolved = resolve_keys(df1, df2, keys)
    if callable(resolved):
        cols1, cols2 = [[text_or_blank(c).alias(f"_k{i}") for i, c in enumerate(resolved(df))] for df in (df1, df2)]
        if len(cols1) != len(cols2):
            raise ValueError("the key function gives different numbers of columns")
        names = shown = [f"_k{i}" for i in range(len(cols1))]
    else:
        cols1, cols2 = [], []
        for i, key in enumerate(resolved):
            kinds = df1.schema[key].dataType, df2.schema[key].dataType
            native = _renders_uniquely(*kinds)
            never_null = not null_keys or not (df1.schema[key].nullable or df2.schema[key].nullable)
            stored = never_null and (native or kinds == (StringType(), StringType()))
            cols1 += _key_columns(df1, key, native, stored, i)
            cols2 += _key_columns(df2, key, native, stored, i)
        shown = [f"_k{i}" for i in range(len(resolved))]
        side1 = df1.select("*", *cols1)
        names = side1.columns[len(df1.columns) :]
    return _Keys(df1.select("*", *cols1), df2.select("*", *cols2), names, shown)


def _shown_key(keyed: _Keys, name: str) -> Column:
    """One key value as text, an absent one as nothing."""
    flag, text = name.replace("_k", "_n"), text_or_blank(F.col(name))
    return F.when(F.col(flag), "").otherwise(text) if flag in keyed.names else text


def _key_text(keyed: _Keys, sep: str) -> Column:
    return F.concat_ws(sep, *[_shown_key(keyed, name) for name in keyed.shown])


def _once(keyed: _Keys, side: DataFrame, tag: str, null_keys: bool) -> DataFrame:
    """The rows of a side, or an error for a key that has two of them (and for a null key, if there should be none).

    Counting needs the rows by key, which the join needs too, so it adds neither an exchange nor a sort. The check is a
    condition on rows, not a column, so it holds whatever is asked of the result, a count included.
    """
    again = F.count(F.lit(1)).over(Window.partitionBy(*keyed.names)) > 1
    fault = F.raise_error(F.concat(F.lit(f"duplicate key on {tag}: "), _key_text(keyed, ", "))).cast("boolean")
    verdict = F.when(again, fault)
    if not null_keys:
        null = reduce(lambda x, y: x | y, [F.col(n).isNull() for n in keyed.shown])
        verdict = verdict.when(null, F.raise_error(F.lit(f"null key on {tag}")).cast("boolean"))
    return side.withColumn("_once", verdict.otherwise(F.lit(True))).where("_once")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count.

    Counts are combined before the shuffle, so one key holding most rows costs
    no more than any other.
    """
    cols = [text_or_blank(_col(df, key)).alias(key) for key in keys]
    return df.select(*cols).groupBy(*[f"`{k}`" for k in keys]).agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def _present(keyed: _Keys, df: DataFrame, side: DataFrame, prefix: str, tag: str, names: list[str], null_keys: bool) -> DataFrame:
    cols = [_col(side, c).alias(f"{prefix}{i}") for i, c in enumerate(names) if c in df.columns]
    order = [_col(side, ROW_ORDER).alias(f"{prefix}order")] if ROW_ORDER in df.columns else []
    named = side.select(*keyed.names, F.lit(True).alias(f"{prefix}here"), *cols, *order)
    return _once(keyed, named, tag, null_keys).drop("_once")


def _both(df1: DataFrame, df2: DataFrame, keys: Keys, null_keys: bool) -> tuple[_Keys, list[str], DataFrame, DataFrame]:
    keyed, cols = _keyed(df1, df2, keys, null_keys=null_keys), unified_columns(df1, df2)
    left = _present(keyed, df1, keyed.side1, "_a", "FILE1", cols, null_keys)
    return keyed, cols, left, _present(keyed, df2, keyed.side2, "_b", "FILE2", cols, null_keys)


def _value(df: DataFrame, prefix: str, i: int, name: str) -> Column:
    return text_or_blank(F.col(f"{prefix}{i}")) if name in df.columns else F.lit("")


def _differs(df1: DataFrame, df2: DataFrame, i: int, name: str) -> Column:
    """Whether the trimmed values differ; equal raw values are settled without trimming."""
    if name in df1.columns and name in df2.columns and _renders_uniquely(df1.schema[name].dataType, df2.schema[name].dataType):
        return ~F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}"))
    a, b = _value(df1, "_a", i, name), _value(df2, "_b", i, name)
    return (a != b) & (trim_blanks(a) != trim_blanks(b))


def _difference(a: Column, b: Column, name: str) -> Column:
    return F.concat(F.lit(f"{name}: '"), a, F.lit("' -> '"), b, F.lit("'"))


def compare(df1: DataFrame, df2: DataFrame, keys: Keys = None, *, null_keys: bool = True) -> DataFrame:
    """Every key of either side with its values, ``RESULT`` and ``DIFF_DETAIL``.

    Keys are compared as they are, other values trimmed; null is the empty
    text; a column missing on one side is empty there. Values come from side 1
    where it has the key. ``keys`` are column names, a function from a table to
    key columns, or None for the first column of side 1.

    Nothing runs until the result is asked for; each side is read once and
    shuffled once. A repeated key then ends the query with
    :class:`DuplicateKeyError` before its rows reach the join, so no key is
    ever joined many to many, also where only a count or one column is asked
    for. A limit raises for the keys that it reads; :func:`duplicate_keys`
    lists all. With ``null_keys=False`` the keys are used as stored, without
    a shuffle for tables bucketed by them, and a null key is an error.

    If a side carries ``_row_order`` the result does too, side 1 first.
    """
    keyed, cols, left, right = _both(df1, df2, keys, null_keys)
    joined = left.join(right, keyed.match(left, right), "full_outer")

    here1, here2 = F.col("_ahere").isNotNull(), F.col("_bhere").isNotNull()
    details = [
        F.when(_differs(df1, df2, i, c), _difference(_value(df1, "_a", i, c), _value(df2, "_b", i, c), c))
        for i, c in enumerate(cols)
    ]
    values = [
        F.when(here1, _value(df1, "_a", i, c)).otherwise(_value(df2, "_b", i, c)).alias(c) for i, c in enumerate(cols)
    ]
    order = []
    if ROW_ORDER in df1.columns and ROW_ORDER in df2.columns:
        row = F.when(here1, F.col("_aorder")).otherwise(F.col("_border"))
        order = [F.struct(F.when(here1, 1).otherwise(2).alias("side"), row.alias("row")).alias(ROW_ORDER)]
    detail = F.when(here1 & here2, F.concat_ws("; ", *details)).otherwise(F.lit(""))
    verdict = (
        F.when(~here2, F.lit(ONLY_IN_FILE1))
        .when(~here1, F.lit(ONLY_IN_FILE2))
        .when(F.col(DIFF_DETAIL) == "", F.lit(MATCHED))
        .otherwise(F.lit(MISMATCHED))
    )
    flags = [F.col("_ahere"), F.col("_bhere")]
    detailed = joined.select(*values, detail.alias(DIFF_DETAIL), *flags, *order)
    return detailed.select(
        *[F.col(f"`{c}`") for c in cols], verdict.alias(RESULT), DIFF_DETAIL, *([ROW_ORDER] if order else [])
    )


def differing_cells(df1: DataFrame, df2: DataFrame, keys: Keys = None, *, null_keys: bool = True) -> DataFrame:
    """One row per key and differing column: the key, ``column``, ``value1``, ``value2``; repeated keys as in :func:`compare`."""
    keyed, cols, left, right = _both(df1, df2, keys, null_keys)
    joined = left.join(right.withColumnsRenamed({n: f"_r{n}" for n in keyed.names}), reduce(lambda x, y: x & y, [left[n] == F.col(f"_r{n}") for n in keyed.names]))
    joined = joined.where("_ahere and _bhere")
    cells = [
        F.when(
            _differs(df1, df2, i, c),
            F.struct(
                F.lit(c).alias("column"),
                _value(df1, "_a", i, c).alias("value1"),
                _value(df2, "_b", i, c).alias("value2"),
            ),
        )
        for i, c in enumerate(cols)
    ]
    key = _key_text(keyed, "\x1d").alias("key")
    return (
        joined.select(key, F.explode_outer(F.array_compact(F.array(*cells))).alias("_cell"))
        .where(F.col("_cell").isNotNull())
        .select("key", "_cell.*")
    )


def only_left(df1: DataFrame, df2: DataFrame, keys: Keys = None) -> DataFrame:
    """Rows of ``df1`` whose key ``df2`` lacks."""
    keyed = _keyed(df1, df2, keys)
    right = keyed.side2.select(*keyed.names).distinct()
    return keyed.side1.join(right, keyed.match(keyed.side1, right), "left_anti").drop(*keyed.names)


def only_right(df1: DataFrame, df2: DataFrame, keys: Keys = None) -> DataFrame:
    """Rows of ``df2`` whose key ``df1`` lacks."""
    keyed = _keyed(df1, df2, keys)
    left = keyed.side1.select(*keyed.names).distinct()
    return keyed.side2.join(left, keyed.match(keyed.side2, left), "left_anti").drop(*keyed.names)


def key_union(df1: DataFrame, df2: DataFrame, keys: Keys = None) -> DataFrame:
    """Every key of either side once, with the sides that hold it."""
    keyed, resolved = _keyed(df1, df2, keys), resolve_keys(df1, df2, keys)
    names = keyed.names
    named = list(keyed.shown) if callable(resolved) else list(resolved)
    tagged = keyed.side1.select(*names, F.lit(1).alias("_side")).unionAll(
        keyed.side2.select(*names, F.lit(2).alias("_side"))
    )
    return tagged.groupBy(*names).agg(
        F.max(F.col("_side") == 1).alias("in_file1"), F.max(F.col("_side") == 2).alias("in_file2")
    ).select(*[_shown_key(keyed, n).alias(s) for n, s in zip(keyed.shown, named)], "in_file1", "in_file2")


def summarize(compared: DataFrame) -> DataFrame:
    """Number of rows per ``RESULT``."""
    return compared.groupBy(RESULT).agg(F.count(F.lit(1)).alias("rows"))
