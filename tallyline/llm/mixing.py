"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Everything here is DataFrame and SQL work. The 2^m points of a van der Corput sequence are the fractions j / 2^m, and
the slot of a point is j with its m bits reversed. Cumulative weights cut [0, 1) into one interval per source; a source
owns the slots of the points in its interval, so at any length of the schedule its share is off by a few slots at most.
A source's shuffled documents form a line of words that may be walked up to ``max_epochs`` times, cut into blocks of
total words / 2^m (to within one word); the r-th slot of the source takes the r-th block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.prefix import running_totals
from tallyline.operators.joins import lookup
from tallyline.session import materialize

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 1024
LEAST_SLOT_BITS = 16
_CHUNK = 4096
_BLANKS = " \\t\\n\\u000B\\f\\r"


def word_count(text: Column) -> Column:
    """Words, the runs without blanks U+0009-U+000D and U+0020; null counts 0."""
    trimmed = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.expr(f"'{_BLANKS}'"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x09-\x0D\x20]+"))).cast("bigint")


def _source_key(source: Column) -> Column:
    """Never null; sorts by code point with null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def _ceil_share(part: Column, parts: int, total: int) -> Column:
    """ceil(part * parts / total) in exact integers."""
    wide = part.cast("decimal(38,0)") * F.lit(parts).cast("decimal(20,0)")
    return _div(wide + F.lit(total - 1).cast("decimal(20,0)"), total)


def _div(dividend: Column, divisor: int) -> Column:
    return F.call_function("div", dividend, F.lit(divisor).cast("decimal(20,0)")).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``key``, ``source_size``, ``target`` per source of ``sizes`` (columns ``key``, ``size``).

    Sources in key order weigh ``weights`` in turn and share the sum of all sizes. A target stops at ``max_epochs`` times
    its source's size and the excess goes to the others by weight: with l as the level at which all shares add up,
    target = min(cap, l * weight), found by running totals over the sources in order of cap / weight.
    """
    sources = sizes.groupBy("key").agg(F.sum("size").cast("bigint").alias("source_size"))
    ranked = running_totals(sources, ["key"], {"rank": F.lit(1).cast("bigint")})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("bigint")
    capped = ranked.select("key", "source_size", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("cap"))
    capped = capped.withColumn("level", F.col("cap") / F.col("weight"))
    steps = materialize(running_totals(capped, ["level", "key"], {"cap_before": F.col("cap"), "weight_before": F.col("weight")}), "targets")
    sums = steps.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weights")).first()
    share = (F.lit(sums["all"]) - F.col("cap_before")).cast("double") / (F.lit(sums["weights"]) - F.col("weight_before")).cast("double")
    first = steps.where(share <= F.col("level")).agg(F.min(F.struct("level", "key", share.alias("share"))).alias("first")).first()["first"]
    level = 0.0 if first is None else first["share"]
    return steps.select("key", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def _slot_bits(words: int, block_words: int) -> int:
    """Enough slots for blocks of about ``block_words``, 2^16 at least, but no more slots than words."""
    return min(int(math.log2(words)), max(LEAST_SLOT_BITS, math.ceil(math.log2(max(1.0, words / block_words)))))


def slot_ranks(sources: DataFrame, bits: int) -> DataFrame:
    """``key``, ``slot``, ``rank``: the slots of every source (``key``, ``first`` and ``stop`` of its points), ranked in slot order."""
    chunks = sources.where("stop > first").select("key", "first", "stop", F.explode(F.sequence("first", F.col("stop") - 1, F.lit(_CHUNK).cast("bigint"))).alias("at"))
    points = chunks.repartition("key", "at").select(
        "key", "first", F.explode(F.sequence("at", F.least(F.col("at") + (_CHUNK - 1), F.col("stop") - 1))).alias("point")
    )
    slot = F.conv(F.reverse(F.lpad(F.bin("point"), bits, "0")), 2, 10).cast("bigint")
    numbered = running_totals(points.select("key", "first", slot.alias("slot")), ["key", "slot"], {"place": F.lit(1).cast("bigint")})
    return numbered.select("key", "slot", (F.col("place") - F.col("first")).alias("rank"))


def sized_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", carry: bool = False) -> DataFrame:
    """Stored rows ``row`` (a key), ``doc_id``, ``key``, ``size``, ``shuffle``; with ``carry`` also the whole row as ``doc``."""
    doc_id = F.col(f"`{id_column}`")
    rows = docs.select(
        doc_id.alias("doc_id"),
        _source_key(F.col(f"`{source_column}`")).alias("key"),
        word_count(F.col(f"`{text_column}`")).alias("size"),
        F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")).alias("shuffle"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []),
    )
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "sized")


def schedule(rows: DataFrame, targets: DataFrame, max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix: ``slot``, ``row``, ``epoch``, ``word_from``, ``word_to`` (word numbers in the document, end exclusive).

    Read in slot order, any prefix has the sources near their shares; within a slot, documents follow each other by
    epoch and shuffle order. ``rows`` comes from ``sized_rows``, ``targets`` from ``source_targets``.
    """
    whole = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    spark = rows.sparkSession
    if not whole:
        return spark.createDataFrame([], "slot bigint, row bigint, epoch int, word_from bigint, word_to bigint")
    bits = _slot_bits(whole, block_words)
    slots = 1 << bits
    rounded = running_totals(targets.withColumn("share", F.round("target").cast("bigint")), ["key"], {"before": F.col("share"), "size_before": F.col("source_size")})
    rounded = materialize(rounded, "shares")
    shared = rounded.agg(F.sum("share").alias("n")).first()["n"]
    sources = rounded.select(
        "key",
        "source_size",
        "size_before",
        _ceil_share(F.col("before"), slots, shared).alias("first"),
        _ceil_share(F.col("before") + F.col("share"), slots, shared).alias("stop"),
    )
    placed = running_totals(rows.where("size > 0").select("row", "key", "size", "shuffle"), ["key", "shuffle", "size", "row"], {"place": F.col("size")})
    line = lookup(placed, sources.select("key", "source_size", "size_before", (F.col("stop") - F.col("first")).alias("owned")), "key")
    walked = line.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(max_epochs)])))
    walked = walked.withColumn("begin", F.col("epoch") * F.col("source_size") + F.col("place") - F.col("size_before"))
    blocks = walked.withColumn("head", _ceil_share(F.col("begin") + 1, slots, whole) - 1).withColumn(
        "tail", F.least(_ceil_share(F.col("begin") + F.col("size"), slots, whole), F.col("owned")) - 1
    )
    pieces = blocks.where("head <= tail").withColumn("rank", F.explode(F.sequence("head", "tail")))
    taken = pieces.join(slot_ranks(sources, bits), ["key", "rank"])
    wide = F.col("rank").cast("decimal(38,0)")
    from_word, to_word = _div(wide * F.lit(whole).cast("decimal(20,0)"), slots), _div((wide + 1).cast("decimal(38,0)") * F.lit(whole).cast("decimal(20,0)"), slots)
    spans = taken.select(
        "slot",
        "row",
        "epoch",
        F.greatest(from_word - F.col("begin"), F.lit(0)).alias("word_from"),
        F.least(to_word - F.col("begin"), F.col("size")).alias("word_to"),
    )
    return spans.where("word_to > word_from")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", carry: bool = False) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` (of the source), ``taken`` for every row of ``docs``.

    ``taken`` counts the words that the schedule takes, repeats included. Null and empty texts have size 0 and take
    part in nothing else; a null source is a source of its own, last in order; repeated rows are rows of their own (rows
    that share id, source and size may swap their values); other columns are ignored; an empty table gives no rows. With
    ``carry`` the input row comes along as ``doc``.
    """
    rows = sized_rows(docs, id_column, text_column, source_column, carry)
    targets = materialize(source_targets(rows), "targets")
    used = schedule(rows, targets).groupBy("row").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
    counted = rows.join(used, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("bigint"))
    named = lookup(counted, targets, "key")
    return named.select("doc_id", "size", "source_size", "target", "taken", *(["doc"] if carry else []))
