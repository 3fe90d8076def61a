"""Reports over block facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.arrays import explode_items, let, posexplode_items
from tallyline.session import gather


def ragged_report(facts: DataFrame, *, errors: bool = True) -> DataFrame:
    """One row per block and index: the lists side by side, shorter ones padded with empty text.

    Only line numbers are exploded; a row takes its entries from the lists of its block.
    """
    ids = [c for c in ("path", "block_ord", "step") if c in facts.columns]
    lists = {"table": "tables", "column": "columns", "condition": "conditions", "alias": "aliases", **({"error": "errors"} if errors else {})}
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in lists.values()])
    longest = F.greatest(*[F.size(c) for c in lists.values()])
    lines = F.when(known & (longest > 0), F.sequence(F.lit(1), longest))
    rows = explode_items(facts.select(*ids, *lists.values(), lines.alias("_lines")), "_lines", "line")
    at = {name: F.get(items, F.col("line") - 1) for name, items in lists.items()}
    at["alias"] = F.concat(at["alias"]["name"], F.lit(" -> "), at["alias"]["value"])
    return rows.select(*ids, "line", *[F.coalesce(entry, F.lit("")).alias(name) for name, entry in at.items()])


def block_totals(facts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Blocks, and the summed numbers of tables, columns, conditions and errors."""
    return facts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("blocks"),
        *[
            F.coalesce(F.sum(F.size(c).cast("long")), F.lit(0)).alias(c)
            for c in ("tables", "columns", "conditions", "errors")
        ],
    )


def block_duplicates(facts: DataFrame, items: str, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """Values found in more than one block: ``value``, ``count`` and ``first_seen`` for the order of ties."""
    cols = list(dict.fromkeys([*by, "path", "block_ord"]))
    rows = posexplode_items(facts.select(*cols, items), items, "_pos", "value")
    seen = F.struct("path", "block_ord", "_pos")
    return (
        rows.groupBy(*by, "value")
        .agg(F.count(F.lit(1)).alias("count"), F.min(seen).alias("first_seen"))
        .where(F.col("count") > 1)
    )


def _duplicates_text(values: Column) -> Column:
    """``value(count)`` of the values found more than once, the most frequent first, of equal ones the first found.

    Sorted with their places, equal values are neighbours: n log n in the number of values of one script. Values that
    all differ are not sorted. ``values`` are read more than once, so they should be a column.
    """

    def told(ordered: Column) -> Column:
        first = lambda i: (i == 0) | (F.get(ordered, i)["v"] != F.get(ordered, i - 1)["v"])
        starts = F.filter(F.transform(ordered, lambda _, i: i), first)

        def groups(found: Column) -> Column:
            each = F.transform(
                found,
                lambda s, k: F.struct(
                    (s - F.coalesce(F.get(found, k + 1), F.size(ordered))).alias("rank"), F.get(ordered, s)["i"].alias("place"), F.get(ordered, s)["v"].alias("v")
                ),
            )
            return F.array_sort(F.filter(each, lambda g: g["rank"] < -1))

        text = lambda g: F.concat(g["v"], F.lit("("), (-g["rank"]).cast("string"), F.lit(")"))
        return F.array_join(F.transform(let(starts, groups), text), ", ")

    placed = F.sort_array(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(values)) == F.size(values), F.lit("")).otherwise(let(placed, told))


def _list_items(items: Column, attributes: str = "") -> Column:
    opened, closed = f"<li{attributes}>", "</li>\n"
    texts = F.concat(F.lit(opened), F.array_join(items, closed + opened), F.lit(closed))
    return F.when(F.size(items) > 0, texts).when(F.size(items) == 0, F.lit(""))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _section(block: Column) -> Column:
    aliases = let(F.transform(block["aliases"], lambda a: F.concat(a["name"], F.lit(" → "), a["value"])), lambda texts: _list_items(texts))
    return _text(
        "<hr><h3>", block["step"], "</h3>\n<b>테이블:</b><ul>\n", _list_items(block["tables"]),
        "</ul><b>컬럼:</b><ul>\n", _list_items(block["columns"]),
        "</ul><b>조건:</b><ul>\n", _list_items(block["conditions"]),
        "</ul><b>테이블 변경 추적:</b><ul>\n", aliases,
        "</ul><b>오류:</b><ul>\n", _list_items(block["errors"], " style='color:red;'"), "</ul>\n",
    )


def html_report(facts: DataFrame, version: int = 4, tasks: int | None = None) -> DataFrame:
    """(path, content): one page per script with totals and the lists of every block.

    The facts are read once and grouped once by script; the page, its duplicates included, is made of what has come
    together, so no text is shuffled. ``tasks`` write the pages where ``spark.sql.shuffle.partitions`` are too few.
    """
    counts = {"tables": "테이블", "columns": "컬럼", "conditions": "조건절"}
    block = F.struct("block_ord", "step", *counts, "aliases", "errors")
    pages = gather(facts, tasks, "path").groupBy("path").agg(*[F.sum(F.size(c)).alias(c) for c in (*counts, "errors")], F.array_sort(F.collect_list(block)).alias("_blocks"))
    duplicates: list[Column | str] = []
    if version >= 4:
        for items in ("tables", "columns"):
            pages = pages.withColumn(f"_{items}", F.flatten(F.col("_blocks")[items]))
            duplicates += [f"<li>중복 {counts[items]}: ", _duplicates_text(F.col(f"_{items}")), "</li>\n"]
    totals: list[Column | str] = []
    for items, label in counts.items():
        totals += [f"<li>총 {label} 수: ", F.col(items).cast("string"), "</li>\n"]
    content = _text(
        "<html><head><meta charset='UTF-8'><title>분석 결과</title></head><body>\n",
        "<h1>BigQuery 분석 리포트</h1>\n<h2>요약</h2><ul>\n",
        "<li>STEP 수: ", F.size("_blocks").cast("string"), "</li>\n", *totals,
        "<li>발견된 오류 수: ", F.col("errors").cast("string"), "</li>\n", *duplicates, "</ul>\n",
        F.array_join(F.transform("_blocks", _section), ""),
        "</body></html>\n",
    )
    return pages.select("path", content.alias("content"))
