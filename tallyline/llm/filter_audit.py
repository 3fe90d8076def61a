"""How filters interact: what each removes in every order, and its fair share by the potential of Hart and Mas-Colell.

The removal game of a set of rows gives every coalition of filters the number of rows that at least one of its filters
removes. All that is asked of an order of filters is a difference of two coalitions. The potential of a coalition S of s
filters is P(S) = (removed(S) + sum of P(S without i)) / s; the Shapley value of a filter, its mean removal over all
orders, is P(all) - P(all without the filter). Times the number of orders all of it is whole numbers.

Rows are counted by the combination of filters they fail before anything else, so 2^n rows per part are all that the
game, the potentials and the orders ever see.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.session import materialize

FILTERS = "ABCDE"
#: Limits of the filters on texts.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
MARKS = r"[#$%&*|]"
_BLANKS = r"[\x20\x09-\x0D]+"


def text_measures(text: Column) -> Column:
    """``words``, ``distinct`` (words), ``chars``, ``capitals`` and ``marked`` of a text; null is an empty one."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(whole, _BLANKS), lambda w: w != "")
    chars = F.char_length(whole).cast("bigint")
    return F.transform(
        F.array(words),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("words"),
            F.size(F.array_distinct(w)).cast("bigint").alias("distinct"),
            chars.alias("chars"),
            (chars - F.char_length(F.regexp_replace(whole, "[A-Z]+", ""))).alias("capitals"),
            whole.rlike(MARKS).alias("marked"),
        ),
    )[0]


def text_failures(measures: Column) -> list[Column]:
    """Whether a text fails the filters A to D: too short, too repetitive, too many capitals, any of the marks."""
    m = measures
    return [
        m["words"] < LEAST_WORDS,
        100 * m["distinct"] < LEAST_DISTINCT * m["words"],
        100 * m["capitals"] > MOST_CAPITALS * m["chars"],
        m["marked"],
    ]


def failure_counts(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """``part``, ``failed`` (bits, A is 1), ``rows``, ``good``, ``toxic``: documents by the filters that they fail.

    Filter E is failed by a text that a row with a smaller id has, wherever in the table. Nulls are empty texts and parts;
    a row without id fails E never and makes none fail it; rows that share an id and a text are all first or all not. Labels are looked up by id
    (``quality`` = 1 is good, ``toxic`` = 1 toxic); an id with several label rows is good or toxic if any of them says so.

    Copies are counted by text, part and label before they meet, with their smallest id and the number of rows that have
    it: a text in a third of all rows is a handful of rows then. Rows with one id are counted before the join likewise.
    """
    text = F.col(f"`{text_column}`")
    bits = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(text_failures(F.col("measures")))), F.lit(0))
    measured = docs.select(
        F.col(f"`{id_column}`").alias("doc_id"),
        F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256).alias("digest"),
        F.coalesce(F.col(f"`{part_column}`").cast("string"), F.lit("")).alias("part"),
        text_measures(text).alias("measures"),
    )
    rows = measured.select("doc_id", "digest", "part", bits.alias("failed"))
    counted = rows.groupBy("doc_id", "digest", "part", "failed").agg(F.count(F.lit(1)).alias("n"))
    known = labels.groupBy(F.col("doc_id").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    facts = counted.join(known, "doc_id", "left").select(
        "doc_id", "digest", "part", "failed", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    )
    groups = facts.groupBy("digest", "failed", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("n_none")
    )
    groups = materialize(groups, "copies")
    least = groups.groupBy("digest").agg(F.min("first").alias("least"))
    held = F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0) + F.coalesce("n_none", F.lit(0))
    split = groups.join(least, "digest").select(
        "part", "good", "toxic", F.inline(F.array(F.struct(F.col("failed"), held.alias("n")), F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - held).alias("n"))))
    )
    return split.groupBy("part", "failed").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )


def coalitions(counts: DataFrame, filters: int) -> DataFrame:
    """``part``, ``total`` and ``removed``, ``good``, ``toxic``: an array each, by coalition (bits), of what it removes."""
    every = range(1 << filters)
    cells = counts.select("part", "rows", "good", "toxic", "failed", F.explode(F.array(*[F.lit(s) for s in every])).alias("coalition"))
    hit = F.col("failed").bitwiseAND(F.col("coalition")) != 0
    sums = [F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(name) for c, name in (("rows", "removed"), ("good", "good"), ("toxic", "toxic"))]
    removed = cells.groupBy("part", "coalition").agg(F.sum("rows").alias("total"), *sums)
    gathered = removed.groupBy("part").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("coalition", "removed", "good", "toxic"))).alias("all"))
    return gathered.select("part", "total", "all.removed", "all.good", "all.toxic")


def potentials(removed: Column, filters: int) -> Column:
    """The potential of every coalition, times the number of orders, from the array of what each removes.

    In order of their bits every coalition comes after its parts, so one pass fills the array.
    """
    orders = factorial(filters)

    def next_potential(known: Column, s: Column) -> Column:
        parts = sum((F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(known, s - (1 << i))).otherwise(0) for i in range(filters)), F.lit(0).cast("bigint"))
        value = F.call_function("div", F.get(removed, s) * orders + parts, F.bit_count(s).cast("bigint"))
        return F.concat(known, F.array(value))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << filters) - 1)), F.array(F.lit(0).cast("bigint")), next_potential)


def order_steps(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from ``failure_counts``-like ``counts``.

    ``kept`` rows are left after the step, ``removed`` go at it, ``redundant`` fail its filter but went before,
    ``unique_fails`` fail no other filter, ``good_lost`` and ``toxic_lost`` are those of ``removed``; ``shapley`` is
    what the filter removes in all orders together. Every part of ``counts`` has all orders and steps; no parts, no rows.
    """
    n, full = len(filters), (1 << len(filters)) - 1
    plans = [
        (("".join(filters[i] for i in order)), k + 1, 1 << order[k], sum(1 << i for i in order[:k])) for order in permutations(range(n)) for k in range(n)
    ]
    listed = ",".join(f"struct('{name}' as filter_order, {step} as step, {own} as own, {before} as before)" for name, step, own, before in plans)
    parts = coalitions(counts, n).withColumn("potential", potentials(F.col("removed"), n))
    rows = parts.select("*", F.inline(F.expr(f"array({listed})")))
    at = lambda column, s: F.get(F.col(column), s)
    own, before, after = F.col("own"), F.col("before"), F.col("own") + F.col("before")
    gain = lambda column: at(column, after) - at(column, before)
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - at("removed", after)).alias("kept"),
        gain("removed").alias("removed"),
        (at("removed", own) - gain("removed")).alias("redundant"),
        (at("removed", F.lit(full)) - at("removed", F.lit(full) - own)).alias("unique_fails"),
        gain("good").alias("good_lost"),
        gain("toxic").alias("toxic_lost"),
        (at("potential", F.lit(full)) - at("potential", F.lit(full) - own)).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """The five filters on texts in all 120 orders, per value of ``part_column``: ``order_steps`` of ``failure_counts``.

    Repeated rows count each; other columns are ignored; an empty table gives no rows; very long texts are measured whole.
    """
    return order_steps(failure_counts(docs, labels, id_column, text_column, part_column))
