"""Row numbers over a whole table, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.session import materialize, too_few_partitions


def number_rows(
    df: DataFrame, order: Sequence[str], out: str = "line", *, make: Callable[[DataFrame], DataFrame] | None = None,
    within: Sequence[str] = (), tasks: int | None = None,
) -> DataFrame:
    """``df`` with ``out``: 1 for the first row by the columns ``order``, and so on without a gap.

    Rows are dealt out by ranges of ``order`` and stored, so they are placed once whoever asks. Each range is counted;
    the counts, one row per range, are added up in order; a row's number is that sum and its place within the range.
    Rows of equal ``order`` are in one range and have their numbers in any order among them, so name columns that tell
    rows apart where a key may be very frequent. Nulls come first.

    Ranges are told from a first run over ``df``, so what is costly belongs into ``make``: it makes the rows that are
    numbered of the rows of a range, once, without moving them. ``within`` orders those of one row. ``tasks`` are the
    ranges where ``spark.sql.shuffle.partitions`` are too few for the rows.
    """
    by = [F.col(f"`{c}`") for c in order]
    dealt = df.repartitionByRange(tasks, *by) if too_few_partitions(df.sparkSession, tasks) else df.repartitionByRange(*by)
    made = make(dealt) if make else dealt
    stored = materialize(made.withColumn("_range", F.spark_partition_id()), "numbered")
    counts = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*by, *[F.col(f"`{c}`") for c in within]))
    # A row per range of one shuffle, so never many.
    joined = stored.withColumn("_place", place).join(F.broadcast(starts), "_range")
    return joined.select(*[F.col(f"`{c}`") for c in made.columns], (F.col("_before") + F.col("_place")).cast("bigint").alias(out))
