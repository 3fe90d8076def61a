"""Near-duplicate texts by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.components import connected_components
from tallyline.session import materialize

SEED = 42
#: Distinct fingerprints under one table key beyond which links are found through shared balls, not pairs.
CROWD = 1000
SALTS = 32
_BLOCK = 255 * 64


def _fingerprint(text: str | None, words_in_shingle: int) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_in_shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1]))
        last = (ends[words_in_shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), last)]
    values = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), _BLOCK):
        part = values[at : at + _BLOCK].astype(">u8").view(np.uint8)
        bits = np.unpackbits(part).reshape(-1, 64)
        whole = len(bits) // 255 * 255
        if whole:
            ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(values)).tobytes(), "big")


def fingerprint(text: Column, words_in_shingle: int = 3) -> Column:
    """A 64-bit SimHash of the shingles of a text, as a signed long.

    A-Z count as a-z; words are the runs without spaces and control blanks; a shingle is that many words joined by one
    space, repeats included; a shorter text is one shingle. A bit is set if more than half of the shingles' XXH64
    values have it. Null and empty texts, and texts of blanks, have fingerprint zero. Whole texts are read.
    """

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        found = np.fromiter((_fingerprint(t.as_py(), words_in_shingle) for t in texts), dtype=np.uint64, count=len(texts))
        return pa.array(found.view(np.int64), pa.int64())

    return simhash(text.cast("string"))


def as_hex(value: Column) -> Column:
    """16 lower-case hexadecimal digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _masks(bits: list[int], radius: int) -> list[int]:
    """Signed 64-bit masks of all sets of at most ``radius`` of the given bits."""
    found = [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(bits, r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in found]


def _long(value: int) -> str:
    """A long literal; the smallest one cannot be written plainly."""
    return "(-9223372036854775807L - 1L)" if value == -(1 << 63) else f"{value}L"


def _lowest(mask: int) -> int:
    """The lowest set bit of a signed mask, as a signed long."""
    low = mask & -mask
    return low - (1 << 64) if low >= 1 << 63 else low


def _long_array(values: list[int]) -> Column:
    return F.expr(f"array({','.join(map(_long, values))})")


def _segments(segments: int) -> list[list[int]]:
    edges = [round(64 * k / segments) for k in range(segments + 1)]
    return [list(range(a, b)) for a, b in zip(edges, edges[1:])]


def close_pairs(fingerprints: DataFrame, distance: int = 3, segments: int = 2, crowd: int = CROWD) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (first column, long) at most ``distance`` bits apart.

    The 64 bits are cut into ``segments``; two values that close agree in some segment up to ``distance // segments``
    bits. Every value is filed once per segment and looks up the small Hamming ball around each of its segments, of
    which only the half that sets the lowest changed bit is needed, as the other value looks up the rest. Matches are
    verified on all bits. The default asks about 34 keys of 32 bits for each value.

    A key with more than ``crowd`` values would give a quadratic number of pairs. All values that meet there are linked
    through shared points instead: values a and b are at most 3 apart exactly if some point lies within 1 of one and 2
    of the other, so each point's smallest value within radius 1 is linked to all values within radius 2. That is
    linear in the values and loses no connection, though not every single pair is listed there.
    Null values are dropped; no rows give no rows.
    """
    values = fingerprints.select(F.col(fingerprints.columns[0]).alias("fp")).where("fp is not null").distinct()
    parts = _segments(segments)
    radius = distance // segments
    whole = [sum(1 << b for b in bits) for bits in parts]
    whole = [m - (1 << 64) if m >= 1 << 63 else m for m in whole]

    def keyed(masks: list[list[int]]) -> DataFrame:
        looked_up = ",".join(f"struct({at} as seg, {_long(cut)} as cut, {_long(m)} as m, {_long(_lowest(m))} as low)" for at, (own, cut) in enumerate(zip(masks, whole)) for m in own)
        return values.select("fp", F.inline(F.expr(f"array({looked_up})"))).selectExpr("fp", "seg", "(fp & cut) ^ m as key", "fp & cut & low as lowest", "m")

    table = keyed([[0]] * segments).select("seg", "key", F.col("fp").alias("other"))
    probes = keyed([_masks(bits, radius) for bits in parts])
    # The lowest changed bit is unset in the asking value: one of the two values of a pair asks.
    probes = probes.where("m = 0 or lowest = 0").select("fp", "seg", "key", "m")
    full = materialize(table.groupBy("seg", "key").count().where(F.col("count") > crowd).select("seg", "key"), "crowds")
    crowded = bool(full.take(1))
    sparse = table.join(full, ["seg", "key"], "left_anti") if crowded else table
    met = probes.join(sparse, ["seg", "key"]).where(
        (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance) & ((F.col("m") != 0) | (F.col("fp") < F.col("other")))
    )
    pairs = met.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()
    if not crowded:
        return pairs
    if distance != 3:
        raise ValueError("crowded keys are handled for a distance of 3")
    dense = probes.join(full, ["seg", "key"], "left_semi").select("fp").distinct()
    dense = materialize(dense, "dense")
    every = list(range(64))
    near = dense.select("fp", F.explode(_long_array(_masks(every, 1))).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("point"))
    heads = near.groupBy("point").agg(F.min("fp").alias("head"))
    wide = dense.select("fp", F.explode(_long_array(_masks(every, 2))).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("point"))
    linked = wide.join(heads, "point").where("fp <> head").select(F.least("fp", "head").alias("a"), F.greatest("fp", "head").alias("b")).distinct()
    return pairs.unionByName(linked).distinct()


def components_of(prints: DataFrame, distance: int = 3) -> DataFrame:
    """``fp``, ``root``, ``component_id`` for every distinct ``fp`` of ``prints`` (columns ``doc_id``, ``fp``).

    ``component_id`` is the smallest ``doc_id`` of the component, null if it has none.
    """
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    components = connected_components(close_pairs(firsts.select("fp"), distance))
    placed = firsts.join(components.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return placed.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", distance: int = 3, words_in_shingle: int = 3) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` for every row: the smallest id reachable through close fingerprints.

    Texts with one fingerprint are one node, so copies never become pairs; the fingerprint of a large group of copies
    is salted when its rows pick up their component. Repeated rows and ids each keep a row; null ids count as no id
    (a component of null ids only has a null id); other columns are ignored; an empty table gives no rows.
    """
    prints = materialize(docs.select(F.col(id_column).alias("doc_id"), fingerprint(F.col(text_column), words_in_shingle).alias("fp")), "prints")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return (
        prints.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        .join(components_of(prints, distance).select("fp", "component_id", salt), ["fp", "salt"])
        .select("doc_id", "fp", "component_id")
    )


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", distance: int = 3, words_in_shingle: int = 3) -> DataFrame:
    """One row of every component of near duplicates, with the columns of ``docs``.

    The row with the smallest id stays (a null id only if there is no other), one of them if rows repeat it. Columns
    named like the helper columns are safe, as those are put beside the whole row; whole rows move once.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, F.col(f"`{id_column}`").alias("doc_id"), fingerprint(F.col(f"`{text_column}`"), words_in_shingle).alias("fp"))
    rows = materialize(rows.withColumn("place", F.monotonically_increasing_id()), "prints")
    prints = rows.select("doc_id", "fp", "place")
    firsts = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("first"))
    roots = components_of(prints, distance).select("fp", "root")
    kept = firsts.join(roots, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.place")
    return rows.join(kept, "place", "left_semi").select("row.*")
