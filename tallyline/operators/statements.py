"""Scripts of ``;``-separated statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.arrays import posexplode_items
from tallyline.functions.text import MARK, trim_blanks

_PIECE = r"""'[^']*+'?|"[^"]*+"?|;|[^;'"]++"""


def statements_in(sql: Column) -> Column:
    """Trimmed, non-empty statements; a semicolon inside quotes does not end one."""
    pieces = F.transform(
        F.regexp_extract_all(sql, F.lit(_PIECE), F.lit(0)), lambda p: F.when(p == ";", F.lit(MARK)).otherwise(p)
    )
    quoted = F.contains(sql, F.lit("'")) | F.contains(sql, F.lit('"'))
    parts = F.when(quoted, F.split(F.array_join(pieces, ""), MARK, -1)).otherwise(F.split(sql, ";", -1))
    return F.filter(F.transform(parts, trim_blanks), lambda s: s != "")


def split_statements(scripts: DataFrame, text: str = "raw") -> DataFrame:
    """One row per statement of every script, numbered from 1."""
    keep = [c for c in scripts.columns if c != text]
    rows = posexplode_items(scripts.select(*keep, statements_in(F.col(text)).alias("_all")), "_all", "_pos", "statement")
    return rows.select(*keep, (F.col("_pos") + 1).alias("statement_ord"), "statement")


def _aligned(result: DataFrame, first: DataFrame) -> DataFrame:
    """The leading columns of ``result`` under the names of ``first``."""
    if len(result.columns) < len(first.columns):
        raise ValueError(
            f"a statement returned {len(result.columns)} columns, the first result has {len(first.columns)}"
        )
    wanted = len(first.columns)
    return result.toDF(*[f"_c{i}" for i in range(len(result.columns))]).select(
        *[F.col(f"_c{i}") for i in range(wanted)]
    ).toDF(*first.columns)


def _unite(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both by position; columns of different types meet as text."""
    differ = [i for i, (x, y) in enumerate(zip(a.schema, b.schema)) if x.dataType != y.dataType]

    def as_text(df: DataFrame) -> DataFrame:
        named = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
        cols = [F.col(c).cast("string") if i in differ else F.col(c) for i, c in enumerate(named.columns)]
        return named.select(*cols).toDF(*df.columns)

    return as_text(a).unionAll(as_text(b)) if differ else a.unionAll(b)


def run_script(spark: SparkSession, script: str) -> DataFrame:
    """Run a script's statements in order and gather all result rows under the first header.

    Later results are matched by position; their extra columns are dropped and
    too few are an error, as is a script without any result. The statements of
    one script are split by the same expression as a corpus and come to the
    driver, which has to submit them; result rows stay distributed.
    """
    split = split_statements(spark.createDataFrame([(script,)], "raw string")).orderBy("statement_ord")
    results = [spark.sql(row["statement"]) for row in split.collect()]
    results = [r for r in results if r.columns]
    if not results:
        raise ValueError("no statement of the script returned a result")
    first = results[0]
    return reduce(_unite, [first, *[_aligned(r, first) for r in results[1:]]])
