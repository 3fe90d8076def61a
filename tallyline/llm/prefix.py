"""Running totals over a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.session import materialize


def running_totals(df: DataFrame, order: list[str], totals: dict[str, Column], largest: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with a column per entry of ``totals`` and ``largest``: sum or maximum of its expression over all earlier rows.

    The first row has sums of 0 and maxima of null. ``order`` must be unique per row, so that ranges of any size can be
    cut. Rows are dealt out by range and stored; a window runs within each range, and only one row per range meets in the
    window over the ranges' results.
    """
    largest = largest or {}
    every = {**totals, **largest}
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    stored = materialize(ranged.select("*", *[e.alias(f"_of_{name}") for name, e in every.items()]), "ranges")

    def up_to(name: str, column: str, window) -> Column:
        return F.max(column).over(window) if name in largest else F.coalesce(F.sum(column).over(window), F.lit(0))

    whole = [(F.max if name in largest else F.sum)(f"_of_{name}").alias(f"_all_{name}") for name in every]
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.groupBy("_range").agg(*whole).select("_range", *[up_to(name, f"_all_{name}", ahead).alias(f"_from_{name}") for name in every])
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = stored.select("*", *[up_to(name, f"_of_{name}", own).alias(f"_in_{name}") for name in every])
    both = lambda name: F.greatest(f"_from_{name}", f"_in_{name}") if name in largest else F.col(f"_from_{name}") + F.col(f"_in_{name}")
    return local.join(starts, "_range").select(*df.columns, *[both(name).alias(name) for name in every])
