"""Keyed comparison of two tables that are nearly equal.

Rows are dealt to buckets by their keys. Each bucket of each side has an order-free digest, the sums of two hashes over
its rows. Where the digests of both sides agree the bucket's rows are the same, so side 1's are given as matched, from a
scan alone; only the rows of the other buckets are shuffled and compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.text import text_or_blank, trim_blanks
from tallyline.operators.compare import DIFF_DETAIL, MATCHED, RESULT, Keys, _keyed, _renders_uniquely, compare, unified_columns
from tallyline.session import materialize
from tallyline.sources.csv_files import ROW_ORDER

#: Rows of a bucket, about, and the most buckets: their marks, a bit each, are sent to every task.
BUCKET_ROWS, MOST_BUCKETS = 64, 1 << 27
_SEEDS = (0, 1)


def _compared(own: DataFrame, other: DataFrame, name: str) -> Column:
    """A value as it is compared: its trimmed text, or itself where equal values are those of equal texts; absent is empty."""
    if name not in own.columns:
        return F.lit("")
    if name in other.columns and _renders_uniquely(own.schema[name].dataType, other.schema[name].dataType):
        return F.col(f"`{name}`")
    return trim_blanks(text_or_blank(F.col(f"`{name}`")))


def _digests(side: DataFrame, values: list[Column], prefix: str) -> DataFrame:
    sums = [F.sum(F.xxhash64(F.lit(seed), *values).cast("decimal(38,0)")).alias(f"{prefix}{seed}") for seed in _SEEDS]
    return side.groupBy("_bucket").agg(F.count(F.lit(1)).alias(f"{prefix}rows"), *sums)


def differing_buckets(side1: DataFrame, side2: DataFrame, values1: list[Column], values2: list[Column]) -> DataFrame:
    """(``_part``, ``_marks``): the buckets (column ``_bucket``) whose rows differ, as bitmaps of 32768 buckets each."""
    both = _digests(side1, values1, "a").join(_digests(side2, values2, "b"), "_bucket", "full_outer")
    equal = F.col("arows").eqNullSafe(F.col("brows"))
    for seed in _SEEDS:
        equal = equal & F.col(f"a{seed}").eqNullSafe(F.col(f"b{seed}"))
    place = F.col("_bucket") + 1
    marked = both.where(~equal).select(F.bitmap_bucket_number(place).alias("_part"), F.bitmap_bit_position(place).alias("bit"))
    return materialize(marked.groupBy("_part").agg(F.bitmap_construct_agg("bit").alias("_marks")), "bucket-marks")


def _is_marked(marks: Column, bucket: Column) -> Column:
    bit = F.bitmap_bit_position(bucket + 1)
    byte = F.conv(F.hex(F.substring(marks, F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("getbit", byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))


def compare_by_digest(df1: DataFrame, df2: DataFrame, keys: Keys = None, *, buckets: int | None = None) -> DataFrame:
    """What :func:`compare` gives, for tables that are equal in most rows.

    Both tables are read once for the digests, as this is called, and once more for the result, side 1 twice. Buckets
    have about ``BUCKET_ROWS`` rows unless ``buckets`` is given; a change makes its whole bucket move. Rows that differ
    are taken for equal only if both 64-bit sums of their buckets agree. A repeated key is an error in the buckets that
    differ; in the others each side has the very same rows, repeats included, and gives them as matched
    (:func:`duplicate_keys` lists them).
    """
    keyed, names = _keyed(df1, df2, keys), unified_columns(df1, df2)
    if buckets is None:
        buckets = df1.count() // BUCKET_ROWS
    buckets = max(1, min(buckets, MOST_BUCKETS))
    bucket = F.pmod(F.xxhash64(*keyed.names), F.lit(buckets)).cast("bigint").alias("_bucket")
    side1, side2 = (side.select("*", bucket) for side in (keyed.side1, keyed.side2))
    values1, values2 = ([*keyed.names, *[_compared(a, b, c) for c in names]] for a, b in ((df1, df2), (df2, df1)))
    marks = F.broadcast(differing_buckets(side1, side2, values1, values2))

    def told(side: DataFrame) -> DataFrame:
        part = F.bitmap_bucket_number(F.col("_bucket") + 1).alias("_part")
        found = side.select("*", part).join(marks, "_part", "left")
        return found.withColumn("_moves", _is_marked(F.col("_marks"), F.col("_bucket")))

    moved1, moved2 = (told(side).where("_moves").select(*[F.col(f"`{c}`") for c in df.columns]) for side, df in ((side1, df1), (side2, df2)))
    moved = compare(moved1, moved2, keys)
    text = [(text_or_blank(F.col(f"`{c}`")) if c in df1.columns else F.lit("")).alias(c) for c in names]
    order = [F.struct(F.lit(1).alias("side"), F.col(ROW_ORDER).alias("row")).alias(ROW_ORDER)] if ROW_ORDER in moved.columns else []
    stayed = told(side1).where("not _moves").select(*text, F.lit(MATCHED).alias(RESULT), F.lit("").alias(DIFF_DETAIL), *order)
    return stayed.unionByName(moved)
