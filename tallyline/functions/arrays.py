"""Array helpers shared by the script operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = "array<string>"


def empty_strings() -> Column:
    return F.array().cast(EMPTY)


def sorted_set(items: Column) -> Column:
    return F.sort_array(F.array_distinct(items))


def explode_items(df: DataFrame, items: str, alias: str) -> DataFrame:
    """One row per array element, empty arrays dropped.

    A plain ``explode`` makes the optimizer add a ``size(items) > 0`` filter and
    push it below the projection, which evaluates the extraction twice.
    """
    keep = [c for c in df.columns if c != items]
    return df.select(*keep, F.explode_outer(items).alias(alias)).where(F.col(alias).isNotNull())


def posexplode_items(df: DataFrame, items: str, pos: str, alias: str) -> DataFrame:
    """Like :func:`explode_items`, with the position from 0."""
    keep = [c for c in df.columns if c != items]
    return df.select(*keep, F.posexplode_outer(items).alias(pos, alias)).where(F.col(alias).isNotNull())


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Arrays up to this size are searched once per name; longer ones are sorted.
SEARCHED_ITEMS = 64


def keep_last_values(df: DataFrame, pairs: str) -> DataFrame:
    """Reduce an array of (name, value) to one entry per name: last value, first position."""
    entries = F.col(pairs)
    return _keep_last(df, pairs, entries["name"], entries, lambda i: F.get(entries, i))


def zip_last_values(df: DataFrame, names: str, values: str, out: str) -> DataFrame:
    """Like :func:`keep_last_values` for two lists of one size, whose pairs are made where they are kept; ``out`` replaces the lists."""
    entry = lambda i: _pair(F.get(names, i), F.get(values, i))
    return _keep_last(df, out, F.col(names), F.zip_with(names, values, _pair), entry).drop(names, values)


def _keep_last(df: DataFrame, out: str, names: Column, pairs: Column, entry: Callable[[Column], Column]) -> DataFrame:
    """Names that all differ are left as they are. A short list is searched from its end for each name; one sort brings
    the equal names of a longer one together, so the work stays n log n however many entries a script has.
    """
    firsts, backward = f"__{out}_firsts", f"__{out}_backward"
    last = lambda name: entry((F.size(backward) - F.array_position(backward, name)).cast("int"))
    ready = df.withColumns({firsts: F.array_distinct(names), backward: F.reverse(names)})
    kept = (
        F.when(F.size(firsts) == F.size(backward), pairs)
        .when(F.size(backward) <= SEARCHED_ITEMS, F.transform(firsts, last))
        .otherwise(_last_by_sort(pairs))
    )
    return ready.withColumn(out, kept).drop(firsts, backward)


def _pair(name: Column, value: Column) -> Column:
    return F.struct(name.alias("name"), value.alias("value"))


def _last_by_sort(pairs: Column) -> Column:
    placed = F.transform(pairs, lambda x, i: F.struct(x["name"].alias("name"), i.alias("pos"), x["value"].alias("value")))

    def merged(by_name: Column) -> Column:
        firsts = F.transform(
            F.filter(by_name, lambda x, i: (i == 0) | (F.get(by_name, i - 1)["name"] != x["name"])),
            lambda x: x["pos"],
        )
        lasts = F.filter(by_name, lambda x, i: (i == F.size(by_name) - 1) | (F.get(by_name, i + 1)["name"] != x["name"]))
        return F.array_sort(
            F.zip_with(firsts, lasts, lambda p, x: F.struct(p.alias("pos"), x["name"].alias("name"), x["value"].alias("value")))
        )

    settled = let(F.array_sort(placed), merged)
    return F.transform(settled, lambda x: _pair(x["name"], x["value"]))
