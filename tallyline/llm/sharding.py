"""Weighted shards for records by rendezvous hashing.

Every shard draws a score for every record from the record's key and the shard's number; the highest score has the
record. A shard's draws do not depend on the other shards, so a new shard takes records into itself only, and a shard
that goes gives away its own records only. With the score -weight / ln(u), u uniform in (0, 1), a shard's share of the
records is its share of the weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.prefix import running_totals
from tallyline.session import materialize

SHARDS = 40
#: Bytes that a record counts beside its text.
RECORD_BYTES = 16
#: Bytes of records in one file of a shard, to within a record.
PART_BYTES = 128 << 20


def key_hash(key: Column) -> Column:
    """The hash of a record key's text; null is a key of its own."""
    return F.xxhash64(key.cast("string"), key.isNull())


def _highest(hashed: Column, weights: Sequence[float], first: int = 0) -> Column:
    """(``score``, ``back``) of the shard with the highest score; ``back`` is its number below zero.

    A draw is the upper 53 bits of a hash of key and shard, as a number between 0 and 1. A weight of 0 draws nothing;
    of equal scores the least shard wins.
    """

    def scored(weight: Column, at: Column) -> Column:
        shard = at.cast("bigint") + first
        drawn = F.shiftrightunsigned(F.xxhash64(hashed, shard), 11).cast("double")
        return F.struct(F.when(weight > 0, -weight / F.ln((drawn + 0.5) * 2.0**-53)).alias("score"), (-shard).alias("back"))

    return F.array_max(F.transform(F.array(*[F.lit(float(w)) for w in weights]), scored))


def _check(weights: Sequence[float]) -> None:
    if not all(0 <= w < float("inf") for w in weights) or not any(weights):
        raise ValueError("weights are finite numbers from 0, one of them above it")


def rendezvous(key: Column, weights: Sequence[float], extra: Sequence[float] = ()) -> tuple[Column, Column]:
    """The shard of a key, and its shard once shards of the weights ``extra`` have joined, numbered after the others.

    Only key and weights decide. A record's second shard is its first or a new one; the old shards are not drawn again.
    """
    _check(weights)
    _check([*weights, *extra])
    hashed = key_hash(key)
    old = _highest(hashed, weights)
    shard = (-old["back"]).cast("int")
    if not extra:
        return shard, shard
    new = _highest(hashed, extra, len(weights))
    return shard, F.when(new["score"] > old["score"], -new["back"]).otherwise(-old["back"]).cast("int")


def assign(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * SHARDS,
    extra: Sequence[float] = (1.0,),
    id_column: str = "doc_id",
    text_column: str = "text",
    part_bytes: int = PART_BYTES,
    carry: bool = False,
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot``, ``part``, ``grown_shard`` for every row of ``docs``.

    ``size`` counts the text's UTF-8 bytes and ``RECORD_BYTES``. ``slot`` numbers the rows of a shard from 0, in the
    order of the hashed keys; ``part`` cuts the shard, in that order, into pieces of about ``part_bytes``. Rows with one
    id are in one shard, null ids too; they are dealt out by their place beside the id, so a frequent id is no large task,
    and numbered by checksum and size (rows that agree in all of it may swap their slots). A null text has no bytes and
    the checksum 0. Other columns are ignored; an empty table gives no rows; shards without rows are no rows either. With
    ``carry`` the input row comes along as ``doc``.
    """
    key, text = F.col(f"`{id_column}`"), F.col(f"`{text_column}`").cast("string")
    shard, grown = rendezvous(F.col("doc_id"), weights, extra)
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []
    rows = docs.select(
        key.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        *whole,
    )
    stored = materialize(rows.select("*", shard.alias("shard"), grown.alias("grown_shard"), F.monotonically_increasing_id().alias("row")), "sharded")
    keys = stored.select("row", "shard", "size", "text_crc32", key_hash(F.col("doc_id")).alias("hashed"))
    totals = running_totals(keys, ["shard", "hashed", "text_crc32", "size", "row"], {"place": F.lit(1).cast("bigint"), "bytes": F.col("size")})
    totals = materialize(totals.select("row", "shard", "place", "bytes"), "places")
    # One row per shard, so never more than the caller's list of weights.
    firsts = totals.groupBy("shard").agg(F.min("place").alias("from_place"), F.min("bytes").alias("from_bytes"))
    placed = totals.join(F.broadcast(firsts), "shard").select(
        "row", (F.col("place") - F.col("from_place")).alias("slot"), F.floor((F.col("bytes") - F.col("from_bytes")) / F.lit(part_bytes)).cast("bigint").alias("part")
    )
    found = stored.join(placed, "row")
    return found.select("doc_id", "size", "text_crc32", "shard", "slot", "part", "grown_shard", *(["doc"] if carry else []))


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * SHARDS, id_column: str = "doc_id", text_column: str = "text", part_bytes: int = PART_BYTES) -> None:
    """The rows of ``docs`` as one folder per shard, in pieces of about ``part_bytes`` with the rows in slot order.

    Each row has its own columns and ``_slot``. Pieces of a shard are written by different tasks, so a heavy shard is
    many files, not one long task. ``path`` must not exist.
    """
    found = assign(docs, weights, (), id_column, text_column, part_bytes, carry=True)
    pieces = found.repartition("shard", "part").sortWithinPartitions("shard", "slot")
    pieces.select("doc.*", F.col("slot").alias("_slot"), F.col("shard").alias("_shard")).write.partitionBy("_shard").parquet(path)
