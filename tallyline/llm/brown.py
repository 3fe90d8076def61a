"""Class-based bigram language model: Brown clustering by exchange, and smoothed scores of whole texts.

Every training word is a unit of its own. The most frequent ones, the core, are moved between classes one by one, each to
where the class bigrams become likeliest, until that no longer raises the likelihood; all other words are one more unit
meanwhile. Then every other word, however rare, takes the class that makes its own occurrences likeliest, given
the classes of the core words beside it. Counts and classes of all words are a stored table, joined to texts by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.quality_rules import bucket
from tallyline.llm.words import batch_words, row_slices
from tallyline.session import materialize

CLASSES = 64
#: Words whose classes are exchanged, with one unit for all others; the classes of these follow from the core's.
CORE_WORDS = 1023
#: The most frequent words whose counts and classes are sent to the tasks (18 bytes each); all others are joined.
HOT_WORDS = 262_144
#: Least rise of the likelihood in a sweep of exchange, in nats a token, for which another follows.
LEAST_RISE = 1e-4
#: Weight of the class frequencies in a transition probability, in tokens.
BACKOFF = 20.0
#: Bytes of text that a training task takes apart at once: its arrays of tokens are some tens of times that.
SLICE_BYTES = 2 << 20
END = np.uint64(0x0E0D)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of all tokens in order: a text's words, then one end."""
    row, words = batch_words(texts)
    count = np.bincount(row, minlength=len(texts))
    ends = np.cumsum(count + 1) - 1
    tokens = np.full(len(row) + len(texts), END, dtype=np.uint64)
    place = np.ones(len(tokens), dtype=bool)
    place[ends] = False
    tokens[place] = words
    return np.repeat(np.arange(len(texts)), count + 1), tokens


def word_counts(texts: DataFrame) -> DataFrame:
    """``hash``, ``n`` of every distinct token of ``texts`` (column ``text``), ends included."""
    slice_bytes = SLICE_BYTES

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in row_slices(batch.column(0), slice_bytes):
                hashes, n = np.unique(_tokens(part)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], names=["hash", "n"])

    return materialize(texts.select("text").mapInArrow(counted, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n")), "vocabulary")


def frequent_words(vocabulary: DataFrame, most: int = HOT_WORDS) -> pd.DataFrame:
    """Up to ``most`` of the most frequent words, by falling count: all words from some count on.

    The count is read off a histogram of a few hundred buckets, so neither step sends more than the result to the driver.
    """
    level = vocabulary.groupBy(bucket(F.col("n")).alias("least")).count().toPandas().sort_values("least", ascending=False)
    fitting = level[level["count"].cumsum() <= most]
    if not len(fitting):
        return pd.DataFrame({"hash": np.empty(0, np.int64), "n": np.empty(0, np.int64)})
    return vocabulary.where(F.col("n") >= int(fitting["least"].min())).select("hash", "n").toPandas().sort_values(["n", "hash"], ascending=[False, True])


class Units(NamedTuple):
    """The core words as sorted hashes, and the unit of each; any other word is ``rest``, the unit after the last."""

    hashes: np.ndarray
    numbers: np.ndarray

    @property
    def rest(self) -> int:
        return len(self.hashes)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
        return np.where(self.hashes[at] == tokens, self.numbers[at], self.rest)


def core_units(vocabulary: DataFrame, most: int = CORE_WORDS) -> Units:
    """The end and the most frequent words, as units by falling count."""
    words = frequent_words(vocabulary, most)["hash"].to_numpy(np.int64).view(np.uint64)
    words = np.concatenate(([END], words[words != END]))[:most]
    order = np.argsort(words)
    return Units(words[order], order.astype(np.int64))


def _with_before(values: np.ndarray, end: int) -> np.ndarray:
    """What stands before each token: the token before a text's first is an end, as is the last token of the text before it."""
    return np.concatenate(([end], values[:-1]))


def unit_pairs(texts: DataFrame, units: Units) -> DataFrame:
    """``u``, ``v``, ``n``: how often unit v follows unit u; a text begins after an end."""
    size, slice_bytes = units.rest + 1, SLICE_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = int(units.of(np.array([END]))[0])
        for batch in batches:
            for _, part in row_slices(batch.column(0), slice_bytes):
                unit = units.of(_tokens(part)[1])
                pair, n = np.unique(_with_before(unit, end) * size + unit, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    summed = texts.select("text").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return materialize(summed.select(F.expr(f"cast(pair div {size} as int)").alias("u"), F.expr(f"cast(pair % {size} as int)").alias("v"), "n"), "pairs")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange_gains(left: np.ndarray, right: np.ndarray, self_pairs: float, own: int, counts: np.ndarray) -> np.ndarray:
    """Change of the class bigram log-likelihood if one unit moves to each class, up to a constant of the unit.

    ``left[c]`` (``right[c]``) is how often class c comes before (after) the unit; ``counts`` are the class bigrams.
    """
    left, right = left.astype(float), right.astype(float)
    left[own] -= self_pairs
    right[own] -= self_pairs
    rest = counts.astype(float).copy()
    rest[own, :] -= right
    rest[:, own] -= left
    rest[own, own] -= self_pairs
    after = _xlogx(rest + right[None, :]) - _xlogx(rest)
    before = _xlogx(rest + left[:, None]) - _xlogx(rest)
    both = _xlogx(np.diag(rest) + left + right + self_pairs) - _xlogx(np.diag(rest))
    gain = after.sum(axis=1) - np.diag(after) + before.sum(axis=0) - np.diag(before) + both
    # Pairs of the unit with other classes stay in those classes' totals wherever the unit goes.
    out, into = rest.sum(axis=1) + left, rest.sum(axis=0) + right
    gain -= _xlogx(out + right.sum() + self_pairs) - _xlogx(out)
    gain -= _xlogx(into + left.sum() + self_pairs) - _xlogx(into)
    return gain


def likelihood(counts: np.ndarray) -> float:
    """Class bigram log-likelihood without the part that no clustering changes."""
    counts = counts.astype(float)
    return float(_xlogx(counts).sum() - _xlogx(counts.sum(axis=0)).sum() - _xlogx(counts.sum(axis=1)).sum())


def moved(counts: np.ndarray, left: np.ndarray, right: np.ndarray, self_pairs: float, own: int, to: int) -> None:
    """Bring the class bigrams up to date with the move of a unit, whose neighbours by class are ``left`` and ``right``."""
    left, right = left.copy(), right.copy()
    left[own] -= self_pairs
    right[own] -= self_pairs
    for at, sign in ((own, -1), (to, 1)):
        counts[at, :] += sign * right
        counts[:, at] += sign * left
        counts[at, at] += sign * self_pairs


def exchange(table: np.ndarray, classes: int, least_rise: float = LEAST_RISE) -> tuple[np.ndarray, np.ndarray]:
    """Class of every unit, and the class bigram counts, from the table of unit bigrams.

    Unit by unit, each goes to the class that raises the likelihood most; sweeps over all units go on until one raises it by
    less than ``least_rise`` a token. Units start in the classes in turn, so the most frequent ones start apart.
    """
    member = np.arange(len(table)) % classes
    counts = np.zeros((classes, classes))
    np.add.at(counts, (member[:, None], member[None, :]), table)
    reached = likelihood(counts)
    while True:
        for unit in range(len(table)):
            right = np.bincount(member, weights=table[unit], minlength=classes)
            left = np.bincount(member, weights=table[:, unit], minlength=classes)
            own, same = int(member[unit]), float(table[unit, unit])
            gain = exchange_gains(left, right, same, own, counts)
            to = int(gain.argmax())
            if gain[to] > gain[own] + 1e-9:
                moved(counts, left, right, same, own, to)
                member[unit] = to
        before, reached = reached, likelihood(counts)
        if reached - before < least_rise * max(table.sum(), 1.0):
            return member, np.round(counts).astype(np.int64)


def cluster(pairs: DataFrame, units: int, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Class of every unit (``units`` of them), and the class bigram counts.

    The counts of unit pairs are added up by Spark. What reaches the driver is a table of a fixed size, ``units`` squared
    numbers at most whatever the corpus holds, and the exchange of a few seconds runs there: units that depend on each
    other must move one after the other.
    """
    found = pairs.select((F.col("u") * units + F.col("v")).alias("pair"), "n").toPandas()
    table = np.zeros(units * units)
    table[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return exchange(table.reshape(units, units), classes)


def context_cells(texts: DataFrame, units: Units, member: np.ndarray, classes: int) -> DataFrame:
    """``hash``, ``slot``, ``n`` of every word outside the core: how often it stands after (slot < classes) or before a core word of each class."""
    slice_bytes = SLICE_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.append(member[: units.rest], -1)
        end = known[units.of(np.array([END]))[0]]
        for batch in batches:
            for _, part in row_slices(batch.column(0), slice_bytes):
                _, tokens = _tokens(part)
                of = known[units.of(tokens)]
                rare = np.flatnonzero(of < 0)
                # A text's last token is an end, which is in the core, so a word has a token after it.
                left, right = _with_before(of, end)[rare], of[np.minimum(rare + 1, len(of) - 1)]
                hashes = np.concatenate((tokens[rare][left >= 0], tokens[rare][right >= 0]))
                slots = np.concatenate((left[left >= 0], right[right >= 0] + classes))
                order = np.lexsort((slots, hashes))
                hashes, slots = hashes[order], slots[order]
                new = np.ones(len(hashes), dtype=bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (slots[1:] != slots[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(hashes)))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(slots[first].astype(np.int32)), pa.array(n)], names=["hash", "slot", "n"])

    return texts.select("text").mapInArrow(count, "hash bigint, slot int, n bigint").groupBy("hash", "slot").agg(F.sum("n").alias("n"))


def context_scores(bigrams: np.ndarray) -> np.ndarray:
    """(slots, classes): what one occurrence in a slot of ``context_cells`` adds to the log-likelihood of a word in each class."""
    held = bigrams + 1.0
    into, out = held.sum(axis=0), held.sum(axis=1)
    return np.concatenate((np.log(held) - np.log(into)[None, :], (np.log(held) - np.log(out)[:, None]).T))


def word_classes(texts: DataFrame, vocabulary: DataFrame, units: Units, member: np.ndarray, bigrams: np.ndarray) -> DataFrame:
    """``hash``, ``n``, ``class`` of every training word, stored.

    A word outside the core takes the class in which its occurrences beside core words are likeliest under the class
    bigrams (of equal ones the first); one that never stands beside a core word has the class of the core's rest. The
    counts of a word's slots are added up before they meet, so a row per word has two counts per class at most.
    """
    spark, classes, scores = texts.sparkSession, len(bigrams), context_scores(bigrams)
    cells = context_cells(texts, units, member, classes).groupBy("hash").agg(F.collect_list(F.struct("slot", "n")).alias("cells"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("cells")
            size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            slot, n = flat.field("slot").to_numpy(), flat.field("n").to_numpy()
            if not len(size):
                continue
            # Slots in order, so that sums of equal counts are equal to the last bit wherever they are made.
            order = np.lexsort((slot, np.repeat(np.arange(len(size)), size)))
            total = np.add.reduceat(scores[slot[order]] * n[order, None], np.concatenate(([0], np.cumsum(size)[:-1])))
            yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(np.round(total, 9).argmax(axis=1).astype(np.int32))], names=["hash", "class"])

    chosen = cells.mapInArrow(choose, "hash bigint, class int")
    core = spark.createDataFrame([(int(h), int(member[u])) for h, u in zip(units.hashes.view(np.int64), units.numbers)], "hash bigint, class int")
    found = vocabulary.join(chosen.unionByName(core), "hash", "left")
    return materialize(found.select("hash", "n", F.coalesce("class", F.lit(int(member[units.rest]))).alias("class")), "classes")


class Hot(NamedTuple):
    """The most frequent words: sorted hashes, and count and class of each."""

    hashes: np.ndarray
    counts: np.ndarray
    member: np.ndarray

    def of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and class of each token; 0 and -1 for words that are not among them."""
        at = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
        hot = self.hashes[at] == tokens
        return np.where(hot, self.counts[at], 0), np.where(hot, self.member[at], -1)


def hot_words(classed: DataFrame, most: int = HOT_WORDS) -> Hot:
    """Up to ``most`` of the most frequent words, and the end."""
    end = int(np.array([END]).view(np.int64)[0])
    least = frequent_words(classed, most)["n"].min()
    wanted = (F.col("n") >= int(least)) if least == least else F.lit(False)
    found = classed.where(wanted | (F.col("hash") == end)).toPandas()
    hashes = found["hash"].to_numpy(np.int64).view(np.uint64)
    if not len(hashes):
        return Hot(np.array([END]), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))
    order = np.argsort(hashes)
    return Hot(hashes[order], found["n"].to_numpy(np.int64)[order], found["class"].to_numpy(np.int64)[order])


def _rare(tokens: np.ndarray, of: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the tokens without a known class, and the classes before and after each (-1: not known either)."""
    place = np.flatnonzero(of < 0)
    return place, _with_before(of, end)[place], of[np.minimum(place + 1, len(of) - 1)]


def class_bigrams(texts: DataFrame, classed: DataFrame, hot: Hot, classes: int) -> np.ndarray:
    """How often each class follows each, over all training tokens.

    Pairs of frequent words are counted where the text is; every other word leaves with the classes beside it and meets
    its own in a join on the word, which has no heavy keys. Two such words in a row meet by their running numbers.
    """
    slice_bytes = SLICE_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        end = int(hot.of(np.array([END]))[1][0])
        for batch in batches:
            for _, part in row_slices(batch.column(0), slice_bytes):
                _, tokens = _tokens(part)
                _, of = hot.of(tokens)
                before = _with_before(of, end)
                both = (of >= 0) & (before >= 0)
                pair, n = np.unique(before[both] * classes + of[both], return_counts=True)
                place, left, right = _rare(tokens, of, end)
                none, ones = np.zeros(len(pair), dtype=bool), np.ones(len(place), dtype=bool)
                columns = [
                    pa.array(np.concatenate((pair, tokens[place].view(np.int64)))),
                    pa.array(np.concatenate((pair // classes, left)).astype(np.int32)),
                    pa.array(np.concatenate((pair % classes, right)).astype(np.int32)),
                    pa.array(np.concatenate((n, number + place))),
                    pa.array(np.concatenate((none, ones))),
                ]
                number += len(tokens)
                yield pa.RecordBatch.from_arrays(columns, names=["hash", "left", "right", "n", "rare"])

    found = materialize(texts.select("text").mapInArrow(count, "hash bigint, left int, right int, n bigint, rare boolean"), "class-pairs")
    rare = found.where("rare").select("hash", "left", "right", F.col("n").alias("number")).join(classed.select("hash", "class"), "hash")
    rare = materialize(rare, "rare")
    later = rare.where("left < 0").select((F.col("number") - 1).alias("number"), F.col("class").alias("b"))
    one = F.lit(1).cast("bigint")
    parts = [
        found.where("not rare").select(F.col("left").alias("a"), F.col("right").alias("b"), "n"),
        rare.where("left >= 0").select(F.col("left").alias("a"), F.col("class").alias("b"), one.alias("n")),
        rare.where("right >= 0").select(F.col("class").alias("a"), F.col("right").alias("b"), one.alias("n")),
        rare.select("number", F.col("class").alias("a")).join(later, "number").select("a", "b", one.alias("n")),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    cells = every.groupBy("a", "b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((classes, classes), dtype=np.int64)
    counts[cells["a"].to_numpy(np.int64), cells["b"].to_numpy(np.int64)] = cells["n"].to_numpy(np.int64)
    return counts


class Model(NamedTuple):
    """What the tasks need: the most frequent words, and log probabilities."""

    hot: Hot
    unseen: int  # class of words that the training texts do not have
    transition: np.ndarray  # log10 P(class | class before)
    known_mass: np.ndarray  # log10 of (1 - escape) / tokens, per class: added to log10 of a word's count
    escape: np.ndarray  # log10 P(unseen word | class)
    tokens: int
    distinct: int

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + self.distinct + 1))


def train(texts: DataFrame, classes: int = CLASSES, core: int = CORE_WORDS, hot: int = HOT_WORDS) -> tuple[Model, DataFrame]:
    """The model, and the stored counts and classes of every word (``hash``, ``n``, ``class``), from ``texts`` (column ``text``).

    P(class | before) mixes the class bigram with the class frequency; P(word | class) is the word's share of the class's
    tokens, less an escape for unseen words that is the share of words seen once (Good-Turing). Unseen words have the
    class of the core's rest. No texts give a model that knows nothing and still scores.
    """
    vocabulary = word_counts(texts)
    units = core_units(vocabulary, core)
    member, core_bigrams = cluster(unit_pairs(texts, units), units.rest + 1, classes)
    classed = word_classes(texts, vocabulary, units, member, core_bigrams)
    frequent = hot_words(classed, hot)
    bigrams = class_bigrams(texts, classed, frequent, classes)
    sums = classed.groupBy("class").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("distinct"), F.count(F.when(F.col("n") == 1, 1)).alias("once")).toPandas()
    into, singles = np.zeros(classes), np.zeros(classes)
    into[sums["class"]], singles[sums["class"]] = sums["tokens"], sums["once"]
    share = (into + 1) / (into.sum() + classes)
    escape = np.minimum((singles + 0.5) / (into + 1), 0.5)
    model = Model(
        frequent,
        int(member[units.rest]),
        np.log10((bigrams + BACKOFF * share[None, :]) / (bigrams.sum(axis=1)[:, None] + BACKOFF)),
        np.log10(1 - escape) - np.log10(np.maximum(into, 1e-300)),
        np.log10(escape),
        int(sums["tokens"].sum()),
        int(sums["distinct"].sum()),
    )
    return model, classed


def score_rows(docs: DataFrame, model: Model, classed: DataFrame) -> DataFrame:
    """Rows of ``docs`` (``text`` and any others) with ``n_tokens``, ``n_known``, ``base_score``, ``score``.

    Frequent words, and transitions between two of them, are summed where the text is. Other words leave as (row, place,
    word, classes beside) and meet their counts and classes in a join on the word, which has no heavy keys, as the heavy
    words never reach it; two in a row meet by row and place.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rare_kind = "array<struct<hash:bigint,place:bigint,left:int,right:int>>"

    @F.arrow_udf(f"struct<n_tokens:bigint,n_known:bigint,base_score:double,score:double,rare:{rare_kind}>")
    def measure(texts: pa.Array) -> pa.Array:
        m: Model = shared.value
        end = int(m.hot.of(np.array([END]))[1][0])
        found = []
        for _, part in row_slices(texts, 1 << 20):
            rows = len(part)
            row, tokens = _tokens(part)
            count, of = m.hot.of(tokens)
            hot, before = of >= 0, _with_before(of, end)
            known = hot & (count > 0)
            score = np.where(hot & (before >= 0), m.transition[before, of], 0.0)
            score += np.where(known, m.known_mass[of] + np.log10(np.maximum(count, 1)), np.where(hot, m.escape[of], 0.0))
            place, left, right = _rare(tokens, of, end)
            lists = [pa.array(v) for v in (tokens[place].view(np.int64), place.astype(np.int64), left.astype(np.int32), right.astype(np.int32))]
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[place], minlength=rows)))), pa.int32())
            rare = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(lists, names=["hash", "place", "left", "right"]))
            sums = [np.bincount(row, weights=w, minlength=rows) for w in (np.ones(len(row)), known, np.where(hot, m.base(count), 0.0), score)]
            arrays = [pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3]), rare]
            found.append(pa.StructArray.from_arrays(arrays, names=["n_tokens", "n_known", "base_score", "score", "rare"]))
        return pa.concat_arrays(found) if found else pa.array([], pa.struct([]))

    names = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(*names, measure("text").alias("m")).select(*names, "m.*")
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "scored")
    lists = {
        name: F.array(*[F.lit(float(x)) for x in values]) for name, values in (("known", model.known_mass), ("unseen", model.escape), ("next", model.transition.reshape(-1)))
    }
    classes = len(model.escape)
    step = lambda a, b: F.get(lists["next"], a * classes + b)
    met = rows.select("_row", F.inline("rare")).join(classed, "hash", "left")
    n, own = F.coalesce("n", F.lit(0)), F.coalesce("class", F.lit(model.unseen))
    met = materialize(met.select("_row", "place", "left", "right", n.alias("n"), own.alias("class")), "rare-words")
    emission = F.when(F.col("n") > 0, F.get(lists["known"], F.col("class")) + F.log10(F.col("n").cast("double"))).otherwise(F.get(lists["unseen"], F.col("class")))
    beside = F.when(F.col("left") >= 0, step(F.col("left"), F.col("class"))).otherwise(0.0) + F.when(F.col("right") >= 0, step(F.col("class"), F.col("right"))).otherwise(0.0)
    base = F.log10((F.col("n") + 1).cast("double") / F.lit(float(model.tokens + model.distinct + 1)))
    single = met.select("_row", F.when(F.col("n") > 0, 1).otherwise(0).alias("known"), base.alias("base"), (emission + beside).alias("more"))
    later = met.where("left < 0").select("_row", (F.col("place") - 1).alias("place"), F.col("class").alias("after"))
    double = met.where("right < 0").select("_row", "place", "class").join(later, ["_row", "place"])
    double = double.select("_row", F.lit(0).alias("known"), F.lit(0.0).alias("base"), step(F.col("class"), F.col("after")).alias("more"))
    sums = single.unionByName(double).groupBy("_row").agg(F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("more").alias("more_score"))
    add = lambda name, more: (F.col(name) + F.coalesce(more, F.lit(0))).alias(name)
    return rows.join(sums, "_row", "left").select(*names, "n_tokens", add("n_known", "more_known"), add("base_score", "more_base"), add("score", "more_score"))


def held_out(id_value: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32 of an id as text falls in the held-out fold; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_value.cast("string"), F.lit("")).cast("binary")) % folds == fold


def class_model_scores(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", classes: int = CLASSES, core: int = CORE_WORDS, hot: int = HOT_WORDS) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` for every row.

    Learns from all rows that are not held out. Null and empty texts are one end token. Perplexity of a text is
    10 ** (-score / n_tokens). Repeated rows are rows of their own; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    model, classed = train(rows.where(~F.col("held_out")), classes, core, hot)
    scored = score_rows(rows, model, classed)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
