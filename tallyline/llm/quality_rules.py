"""Quality rules with thresholds learned from quantile sketches per language and source.

Everything here is DataFrame and SQL work. A sketch is a histogram over buckets that grow with the value (32 per power
of two), so two sketches merge by adding counts, in partial aggregates, in any order and with the same result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.operators.joins import fits_broadcast, lookup
from tallyline.session import materialize

#: Fixed values of the rules: characters that count as symbols, and the blanks between words.
SYMBOLS = "[#*$%&|<>]"
BLANKS = r"[\x09-\x0D\x20]+"
REPEAT_WINDOW = 5

#: Rows that a language's sketch counts for in those of its sources, and that of all rows in those of the languages.
PRIOR_ROWS = 100
#: Distance of a threshold from the outer quartile, in times the spread between the quartiles.
REACH = 4


class Measure(NamedTuple):
    """A whole number per document that a threshold is learned for.

    ``spread`` is the least spread, the resolution of the measure: where most documents share one value, the quartiles
    coincide and tell nothing about how far apart ordinary documents may be.
    """

    name: str
    low: bool
    high: bool
    spread: int


#: Per thousand of characters, lines or words; the word length in hundredths of a character.
MEASURES = (
    Measure("symbol_share", False, True, 10),
    Measure("line_repeat_share", False, True, 100),
    Measure("word_repeat_share", False, True, 50),
    Measure("shout_share", False, True, 25),
    Measure("word_length", True, True, 60),
)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` needs it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """The runs without blanks of a text, as an array; none for null."""
    trimmed = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.expr("' \\t\\n\\u000B\\f\\r'"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))


def repeated_words(words: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur at least twice in the text, the first occurrence included.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes, sorted with their places: n log n in the length
    of the text, and nothing beyond one pass where no window occurs twice.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(by_hash: Column) -> Column:
            same = lambda p, k: (p["h"] == F.get(by_hash, k - 1)["h"]) | (p["h"] == F.get(by_hash, k + 1)["h"])
            return F.sort_array(F.transform(F.filter(by_hash, lambda p, k: F.coalesce(same(p, k), F.lit(False))), lambda p: p["i"]))

        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
        step = lambda s, i: F.struct((s["n"] + (i + window - F.greatest(i, s["end"]))).alias("n"), (i + window).alias("end"))
        return F.aggregate(_let(pairs, places), start, step)["n"]

    def windows(hashes: Column) -> Column:
        last = F.size(hashes) - window
        return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]))
        )

    found = _let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return _let(found, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))


def _repeated_lines(text: Column) -> Column:
    """(lines with a word, those that equal an earlier one)"""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x09-\x0D\x20]"))
    return _let(lines, lambda own: F.struct(F.size(own).alias("n"), (F.size(own) - F.size(F.array_distinct(own))).alias("repeats")))


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """Counts and measures of every row, stored without the texts: one pass over whole texts.

    Null and empty texts count zero throughout; null languages and sources are values of their own.
    """
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    facts = _let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.char_length(F.concat_ws("", w)).cast("bigint").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    counted = docs.select(
        F.col(f"`{id_column}`").alias("doc_id"),
        F.col(f"`{lang_column}`").cast("string").alias("lang"),
        F.col(f"`{source_column}`").cast("string").alias("source"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.regexp_count(text, F.lit("!")).cast("bigint").alias("n_shouts"),
        _repeated_lines(text).alias("l"),
        facts.alias("f"),
    ).select("doc_id", "lang", "source", "n_symbols", "n_shouts", F.col("l.n").cast("bigint").alias("n_lines"), F.col("l.repeats").cast("bigint").alias("n_dup_lines"), "f.*")
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    share = lambda part, whole, scale=1000: F.expr(f"{scale} * {part} div greatest({whole}, 1)")
    return materialize(
        counted.select(
            "*",
            failed.alias("base_failed"),
            share("n_symbols", "word_chars").alias("symbol_share"),
            share("n_dup_lines", "n_lines").alias("line_repeat_share"),
            share("n_repeat_words", "n_words").alias("word_repeat_share"),
            share("n_shouts", "n_words").alias("shout_share"),
            share("word_chars", "n_words", 100).alias("word_length"),
        ),
        "measures",
    )


def bucket(value: Column) -> Column:
    """Least value of the sketch bucket of a whole number from 0: exact below 64, then within 1/32."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    power = F.call_function("shiftleft", F.lit(1).cast("bigint"), shift)
    return value - value % power


def sketches(rows: DataFrame, measures: tuple[Measure, ...] = MEASURES) -> DataFrame:
    """``lang``, ``source``, ``measure``, ``bucket``, ``n`` over the rows that pass the base rules."""
    stacked = ", ".join(f"'{m.name}', {m.name}" for m in measures)
    values = rows.where(~F.col("base_failed")).select("lang", "source", F.expr(f"stack({len(measures)}, {stacked}) as (measure, value)"))
    return values.groupBy("lang", "source", "measure", bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _group_key(lang: Column, source: Column) -> Column:
    """Never null and different for every pair, nulls included."""
    return F.concat_ws("\u0001", F.coalesce(F.concat(F.lit("0"), lang), F.lit("1")), F.coalesce(F.concat(F.lit("0"), source), F.lit("1")))


_WEIGHT = "decimal(38,0)"


def _pooled(own: DataFrame, parent: DataFrame, prior_rows: int) -> DataFrame:
    """``key``, ``measure``, ``bucket``, ``w``: the sketches of ``own`` (``key``, ``up``, ``measure``, ``bucket``, ``n``), each with its parent's.

    The parent, found by ``up``, counts like ``prior_rows`` rows that are spread as it is. Weights are whole numbers: own rows
    times the parent's total, and the parent's weights times ``prior_rows``.
    """
    above = F.broadcast(parent) if fits_broadcast(parent) else parent
    above = above.select(F.col("key").alias("up"), "measure", F.col("bucket").alias("b"), "w")
    totals = above.groupBy("up", "measure").agg(F.sum("w").alias("t"))
    leaned = own.select("key", "up", "measure").distinct().join(above, ["up", "measure"]).select("key", "measure", F.col("b").alias("bucket"), (F.col("w") * prior_rows).cast(_WEIGHT).alias("w"))
    scaled = own.join(totals, ["up", "measure"]).select("key", "measure", "bucket", (F.col("n") * F.col("t")).cast(_WEIGHT).alias("w"))
    return leaned.unionByName(scaled).groupBy("key", "measure", "bucket").agg(F.sum("w").cast(_WEIGHT).alias("w"))


def _quartiles(pooled: DataFrame, reach: int, measures: tuple[Measure, ...]) -> DataFrame:
    """``key``, ``measure``, ``low``, ``high`` of every sketch."""
    spread = F.element_at(F.create_map(*[x for m in measures for x in (F.lit(m.name), F.lit(m.spread))]), F.col("measure"))
    group = Window.partitionBy("key", "measure")
    ranked = pooled.withColumn("total", F.sum("w").over(group)).withColumn("upto", F.sum("w").over(group.orderBy("bucket")))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket")))
    cut = ranked.groupBy("key", "measure").agg(at(1).alias("q1"), at(3).alias("q3"))
    wide = cut.withColumn("spread", F.greatest(F.col("q3") - F.col("q1"), spread))
    return wide.select("key", "measure", (F.col("q1") - F.col("spread") * reach).alias("low"), (F.col("q3") + F.col("spread") * reach).alias("high"))


def thresholds(parts: DataFrame, measures: tuple[Measure, ...] = MEASURES, prior_rows: int = PRIOR_ROWS, reach: int = REACH) -> DataFrame:
    """``group`` and, per measure, ``<name>_low`` and ``<name>_high`` for every language and source in ``parts``.

    Sketches of sources are merged into sketches of languages and of everything. Then every language's has that of
    everything added with the weight of ``prior_rows`` rows, and every source's that of its language: each group has
    thresholds of its own, and the fewer rows it has, the more it leans on the larger ones. high = upper quartile + reach
    * spread, low = lower quartile - reach * spread, where spread is the distance of the quartiles but at least the
    measure's own.
    """
    lang, pair = _group_key(F.col("lang"), F.lit(None).cast("string")), _group_key(F.col("lang"), F.col("source"))
    counted = materialize(parts.select(pair.alias("key"), lang.alias("up"), F.lit("all").alias("top"), "measure", "bucket", "n"), "sketches")
    every = counted.groupBy(F.col("top").alias("key"), "measure", "bucket").agg(F.sum("n").cast(_WEIGHT).alias("w"))
    langs = counted.groupBy(F.col("up").alias("key"), F.col("top").alias("up"), "measure", "bucket").agg(F.sum("n").alias("n"))
    of_langs = materialize(_pooled(langs, every, prior_rows), "language-sketches")
    cut = _quartiles(_pooled(counted.drop("top"), of_langs, prior_rows), reach, measures)
    ends = [F.max(F.when(F.col("measure") == m.name, F.col(end))).alias(f"{m.name}_{end}") for m in measures for end, used in (("low", m.low), ("high", m.high)) if used]
    return cut.groupBy(F.col("key").alias("group")).agg(*ends)


def quality_verdicts(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    source_column: str = "source",
    measures: tuple[Measure, ...] = MEASURES,
    prior_rows: int = PRIOR_ROWS,
    reach: int = REACH,
) -> DataFrame:
    """The counts of every row, ``base_failed``, and ``kept``: base rules passed and every measure within its thresholds.

    Thresholds come from all rows that pass the base rules. They reach the rows by a join on language and source that is
    a broadcast if the counted table is small and salted otherwise, so a source with a third of all rows is spread out.
    Null and empty texts fail the base rules; repeated rows are rows of their own; other columns are ignored.
    """
    rows = measured(docs, id_column, text_column, lang_column, source_column)
    cuts = materialize(thresholds(sketches(rows, measures), measures, prior_rows, reach), "thresholds")
    joined = lookup(rows.withColumn("group", _group_key(F.col("lang"), F.col("source"))), cuts, "group")
    inside = F.lit(True)
    for m in measures:
        if m.low:
            inside &= F.col(m.name) >= F.col(f"{m.name}_low")
        if m.high:
            inside &= F.col(m.name) <= F.col(f"{m.name}_high")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
