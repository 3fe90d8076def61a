"""Joining a large frame with a list whose size is not known in advance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 32 * 1024 * 1024
SALTS = 32


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Whether ``df`` is small enough to send to every executor; counts it in one job."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).cast("long")
    seen = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return seen["rows"] <= max_rows and seen["bytes"] <= max_bytes


def lookup(left: DataFrame, listed: DataFrame, key: str, *, broadcast: bool | None = None) -> DataFrame:
    """Left join with a list that has at most one row per ``key``.

    The list is broadcast only if its counted size allows it. Otherwise both
    sides are salted, so that a key held by a large share of the rows on the
    left is spread over several tasks.
    """
    if broadcast is None:
        broadcast = fits_broadcast(listed)
    if broadcast:
        return left.join(F.broadcast(listed), key, "left")
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(SALTS)))
    copies = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")


#: A key that more than one in so many rows have is heavy, so there are fewer heavy keys than this.
HEAVY_SHARE = 256
#: Counters of the sketch that finds them: its error is below a thousandth of the rows.
_COUNTERS = 8192


def heavy_keys(df: DataFrame, key: str) -> DataFrame:
    """(``key``, ``_heavy``) of the keys that more than one in ``HEAVY_SHARE`` rows with a key have.

    A frequent-items sketch per task, merged into one; the rows are read once and none moves. Nothing runs yet.
    """
    sketch = F.expr(f"approx_top_k(`{key}`, {HEAVY_SHARE}, {_COUNTERS})")
    seen = df.where(F.col(f"`{key}`").isNotNull()).agg(sketch.alias("top"), F.count(F.lit(1)).alias("rows"))
    listed = seen.select("rows", F.inline("top")).where(F.col("count") * HEAVY_SHARE > F.col("rows"))
    return listed.select(F.col("item").alias(key), F.lit(True).alias("_heavy"))


def broadcasts_itself(df: DataFrame) -> bool:
    """Whether Spark would send ``df`` to all tasks by the size it plans with; no job runs."""
    session = df.sparkSession._jsparkSession
    planned = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return planned <= session.sessionState().conf().autoBroadcastJoinThreshold()


def skewed_lookup(left: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Left join with a list that has at most one row per ``key``, of any size, where some keys may be very frequent.

    Nothing runs until the result is asked for. A list that Spark plans to broadcast is joined plainly. Else rows with a
    heavy key, found by a sketch of the left keys, are dealt to ``SALTS`` tasks, and only those keys' rows of the list are
    copied; all other rows meet in a plain shuffle join. Rows without a key are dealt out likewise and meet nothing.
    """
    if broadcasts_itself(listed):
        return left.join(listed, key, "left")
    # Fewer than HEAVY_SHARE rows of one key each.
    heavy = F.broadcast(heavy_keys(left, key))
    row = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(SALTS)).cast("int")
    spread = F.coalesce("_heavy", F.col(f"`{key}`").isNull())
    salted = left.join(heavy, key, "left").withColumn("_salt", F.when(spread, row).otherwise(0)).drop("_heavy")
    salts = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = listed.join(heavy, key, "left").withColumn("_salt", F.explode(salts)).drop("_heavy")
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")
