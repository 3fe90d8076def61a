"""A quality classifier from weak labels: expectation-maximisation over heuristic votes, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.words import SPACE_BREAKS, Block, hash_words, row_slices, word_blocks
from tallyline.session import materialize

FEATURE_BITS = 16
#: Bound on the rows that train the scorer, in expectation; votes and accuracies are taken over all rows.
TRAINING_ROWS = 20_000
ROUNDS = 40
_STEP, _DECAY = 0.5, 1e-5
#: Bytes of text whose features are in memory at once; a longer text counts alone.
_SLICE = 1 << 20

# Classes of bytes for word shapes: a run of one class counts once.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58] = ord("0")
_SHAPE[65:91] = ord("A")
_SHAPE[97:123] = ord("a")
_SHAPE[128:] = ord("a")
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(c) for c in "#*$%&|<>@^~_=+\\{}[]"]] = True


class Labeller(NamedTuple):
    """Votes ``vote`` (b for bad, g for good) where ``condition`` holds, else abstains."""

    name: str
    vote: str
    condition: str


#: Heuristics over the counts of ``profiles``, in SQL. Each speaks only where it knows something: bad texts come in kinds
#: that have little in common, so the absence of one fault is no vote. They overlap on purpose.
LABELLERS = (
    Labeller("sign_words", "b", "n_sign_words * 100 > n_words * 20"),
    Labeller("signs", "b", "n_signs * 100 > n_chars * 6"),
    Labeller("upper", "b", "n_upper_words * 100 > n_words * 50"),
    Labeller("shouts", "b", "n_shout_words * 100 > n_words * 20"),
    Labeller("stutter", "b", "n_stutters * 100 > n_words * 20"),
    Labeller("repetition", "b", "n_words >= 10 and n_distinct * 100 < n_words * 25"),
    Labeller("nothing", "b", "n_words = 0"),
    Labeller("word_length", "b", "n_chars < n_words * 2 or n_chars > n_words * 14"),
    Labeller("sentences", "g", "n_stops * 100 between n_words * 3 and n_words * 40 and n_upper_words * 100 <= n_words * 20"),
    Labeller("letters", "g", "n_words > 0 and n_signs * 100 <= n_chars and n_shout_words * 100 <= n_words * 5"),
    Labeller("variety", "g", "n_words > 0 and n_stutters * 100 <= n_words * 10 and n_distinct * 100 >= n_words * 30"),
)

_COUNTS = ("n_words", "n_chars", "n_signs", "n_sign_words", "n_upper_words", "n_shout_words", "n_stops", "n_stutters", "n_distinct")


class _Part(NamedTuple):
    """Words of some rows, and what the row of the first one has had in earlier parts: its last word, or None, and all its words."""

    block: Block
    last: np.uint64 | None
    seen: np.ndarray


def _parts(texts: pa.Array) -> Iterator[_Part]:
    """The words of a string array in parts; a text longer than a part comes in several, the last of which may go on with other rows."""
    row, last, seen = -1, None, np.empty(0, dtype=np.uint64)
    for block in word_blocks(texts, SPACE_BREAKS, lower=False):
        if not len(block.row):
            continue
        if block.row[0] != row:
            last, seen = None, np.empty(0, dtype=np.uint64)
        yield _Part(block, last, seen)
        one_row = block.row[0] == block.row[-1]
        seen = np.union1d(seen, block.hash) if one_row else np.empty(0, dtype=np.uint64)
        row, last = int(block.row[-1]), block.hash[-1]


def _repeats(part: _Part) -> np.ndarray:
    """Places of the words that equal the one before in their text."""
    block = part.block
    same = np.flatnonzero((block.hash[1:] == block.hash[:-1]) & (block.row[1:] == block.row[:-1])) + 1
    return np.concatenate(([0], same)) if part.last is not None and part.last == block.hash[0] else same


def _part_counts(part: _Part, rows: int) -> np.ndarray:
    """The counts of a part, (rows, counts); added up over the parts of a text they are those of the whole."""
    block = part.block
    raw, row, start, end = block.raw, block.row, block.start, block.end

    def per_word(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[end] - total[start]

    signs = per_word(_SIGN[raw])
    upper = per_word((raw >= 65) & (raw <= 90))
    small = per_word((raw >= 97) & (raw <= 122))
    chars = per_word((raw & 0xC0) != 0x80)
    same = np.zeros(len(row), dtype=bool)
    same[_repeats(part)] = True
    order = np.lexsort((block.hash, row))
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (block.hash[order][1:] != block.hash[order][:-1]) | (row[order][1:] != row[order][:-1])
    if len(part.seen):
        fresh &= (row[order] != row[0]) | ~np.isin(block.hash[order], part.seen)
    columns = (
        np.ones(len(row)),
        chars,
        signs,
        signs > 0,
        (upper > small) & (chars > 1),
        raw[end - 1] == ord("!"),
        (raw[end - 1] == ord(".")) | (raw[end - 1] == ord(",")),
        same,
    )
    counted = [np.bincount(row, weights=c, minlength=rows) for c in columns]
    counted.append(np.bincount(row[order][fresh], minlength=rows))
    return np.stack(counted, axis=1).astype(np.int64)


def _shapes(block: Block) -> np.ndarray:
    """A hash per word of its shape, such as A a . for a capitalised word with a full stop."""
    shape = _SHAPE[block.raw]
    new = np.ones(len(shape), dtype=bool)
    new[1:] = shape[1:] != shape[:-1]
    new[block.start] = True
    place = np.concatenate(([0], np.cumsum(new)))
    return hash_words(shape[new], place[block.start], place[block.end])


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and weight (unit length per row) of the features: words, shapes, and a mark for a word that repeats the one before."""
    keys, counts = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for part in _parts(texts):
        block, same = part.block, _repeats(part)
        slots = np.concatenate([block.hash, _shapes(block) + np.uint64(0x9E3779B97F4A7C15)]) >> np.uint64(64 - FEATURE_BITS)
        row = np.concatenate([block.row, block.row, block.row[same]])
        slot = np.concatenate([slots.astype(np.int64), np.full(len(same), 1, dtype=np.int64)])
        key, n = np.unique(row * (1 << FEATURE_BITS) + slot, return_counts=True)
        keys.append(key)
        counts.append(n)
    # Counts of a slot join before they are squared, so the parts of a text are put together first.
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(place, weights=np.concatenate(counts), minlength=len(key))
    row, slot = key >> FEATURE_BITS, key & ((1 << FEATURE_BITS) - 1)
    norm = np.sqrt(np.bincount(row, weights=n * n, minlength=len(texts)))
    return row, slot, n / norm[row]


def profiles(docs: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """``keep`` columns and the counts the labellers read, for every row; null and empty texts count zero.

    Texts of any length count as a whole: of one longer than a part (``words.BLOCK_BYTES``) the different words and the last one are kept.
    """

    @F.arrow_udf("struct<" + ",".join(f"{c}:bigint" for c in _COUNTS) + ">")
    def count(texts: pa.Array) -> pa.Array:
        total = np.zeros((len(texts), len(_COUNTS)), dtype=np.int64)
        for first, part in row_slices(texts, _SLICE):
            for piece in _parts(part):
                total[first : first + len(part)] += _part_counts(piece, len(part))
        return pa.StructArray.from_arrays([pa.array(total[:, k]) for k in range(len(_COUNTS))], names=list(_COUNTS))

    return docs.select(*keep, count(text.cast("string")).alias("counts")).select("*", "counts.*").drop("counts")


def votes(labellers: tuple[Labeller, ...] = LABELLERS) -> Column:
    """One letter per labeller: b, g or - for none."""
    return F.concat(*[F.when(F.expr(x.condition), x.vote).otherwise("-") for x in labellers])


class LabelModel(NamedTuple):
    """``prior`` of a good document; per labeller, P(vote g) and P(vote b) in each class (bad, good); ``posterior`` by pattern."""

    prior: float
    p_good: np.ndarray
    p_bad: np.ndarray
    posterior: dict[str, float]

    @property
    def accuracy(self) -> np.ndarray:
        """Probability that a labeller's vote is right, given that it votes."""
        share = np.array([1 - self.prior, self.prior])
        right = share[0] * self.p_bad[0] + share[1] * self.p_good[1]
        return right / (share @ (self.p_good + self.p_bad))


def fit_label_model(patterns: dict[str, int], rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over the counts of vote patterns (labellers independent given the class).

    Starts from the majority of votes. With counts of all rows as input the result does not depend on their order or
    partitioning. No patterns give an empty model.
    """
    names = sorted(patterns)
    weight = np.array([patterns[n] for n in names], dtype=float)
    if not names:
        return LabelModel(0.5, np.zeros((2, 0)), np.zeros((2, 0)), {})
    good = np.array([[c == "g" for c in n] for n in names], dtype=float)
    bad = np.array([[c == "b" for c in n] for n in names], dtype=float)
    belief = 1 / (1 + np.exp(-(good.sum(1) - 2 * bad.sum(1))))
    for _ in range(rounds):
        members = np.stack([weight * (1 - belief), weight * belief])
        total = members.sum(axis=1, keepdims=True)
        # One imagined document per class and outcome keeps probabilities away from 0 and 1.
        p_good, p_bad = (members @ good + 1) / (total + 3), (members @ bad + 1) / (total + 3)
        prior = (total[1, 0] + 1) / (total.sum() + 2)
        rest = np.clip(1 - p_good - p_bad, 1e-9, 1)
        logs = good @ np.log(p_good).T + bad @ np.log(p_bad).T + (1 - good - bad) @ np.log(rest).T
        odds = logs[:, 1] - logs[:, 0] + np.log(prior) - np.log(1 - prior)
        fresh = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(fresh - belief).max() < 1e-9:
            belief = fresh
            break
        belief = fresh
    return LabelModel(float(prior), p_good, p_bad, dict(zip(names, belief.tolist())))


def _pattern_counts(rows: DataFrame) -> dict[str, int]:
    """At most 3 ** labellers rows reach the driver."""
    return {r["votes"]: r["count"] for r in rows.groupBy("votes").count().collect()}


def _posteriors(spark: SparkSession, model: LabelModel) -> DataFrame:
    return spark.createDataFrame(list(model.posterior.items()) or [("", 0.5)], "votes string, posterior double")


def training_rows(docs: DataFrame, id_column: str, text: Column, model: LabelModel, whole: int, bound: int = TRAINING_ROWS) -> DataFrame:
    """``target`` (posterior) and ``slots``, ``values`` (unit length) of a sample of about ``bound`` rows, by a hash of id and text.

    The sample depends on the rows alone. Of rows equal in both, all or none are taken.
    """
    share = min(1.0, bound / max(whole, 1))
    drawn = F.pmod(F.xxhash64(F.col(f"`{id_column}`"), text), F.lit(1 << 20)) < int(share * (1 << 20))

    @F.arrow_udf("struct<slots:array<int>,values:array<float>>")
    def hashed(texts: pa.Array) -> pa.Array:
        lists = []
        for _, part in row_slices(texts, _SLICE):
            row, slot, value = _features(part)
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(part))))), pa.int32())
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (slot.astype(np.int32), value.astype(np.float32))]
            lists.append(pa.StructArray.from_arrays(arrays, names=["slots", "values"]))
        kind = pa.struct([("slots", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))])
        return pa.concat_arrays(lists) if lists else pa.array([], kind)

    sample = docs.where(drawn).select(text.alias("text"))
    voted = profiles(sample, F.col("text"), F.col("text")).select("text", votes().alias("votes"))
    named = voted.join(F.broadcast(_posteriors(docs.sparkSession, model)), "votes")
    return materialize(named.select(F.col("posterior").alias("target"), hashed("text").alias("x")).select("target", "x.*"), "sample")


def train_scorer(sample: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Weights per slot and, last, a bias: logistic regression on the posteriors by adaptive full-batch gradient steps.

    Each step is one pass of the sample. A task sends a gradient per slot it has seen; Spark adds them up, so the driver
    receives ``2 ** FEATURE_BITS`` numbers at most.
    """
    size = (1 << FEATURE_BITS) + 1
    weights, seen = np.zeros(size), np.full(size, 1e-8)
    rows = max(sample.count(), 1)
    context = sample.sparkSession.sparkContext
    for _ in range(rounds):
        current = context.broadcast(weights)

        def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                target = batch.column("target").to_numpy(zero_copy_only=False)
                slots, values = batch.column("slots"), batch.column("values")
                row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(slots).to_numpy(zero_copy_only=False))
                slot, value = slots.flatten().to_numpy(), values.flatten().to_numpy()
                score = np.bincount(row, weights=current.value[slot] * value, minlength=batch.num_rows) + current.value[-1]
                error = 1 / (1 + np.exp(-score)) - target
                total += np.bincount(slot, weights=error[row] * value, minlength=size)
                total[-1] += error.sum()
            index = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(index.astype(np.int32)), pa.array(total[index])], names=["slot", "g"])

        found = sample.mapInArrow(gradient, "slot int, g double").groupBy("slot").agg(F.sum("g").alias("g")).toPandas()
        slope = np.zeros(size)
        slope[found["slot"].to_numpy(np.int64)] = found["g"].to_numpy() / rows
        slope += _DECAY * weights
        seen += slope**2
        weights = weights - _STEP * slope / np.sqrt(seen)
        current.unpersist()
    return weights


def score(text: Column, weights: np.ndarray) -> Column:
    """Probability of a good text; null and empty texts get that of the bias alone."""

    def of(texts: pa.Array) -> np.ndarray:
        row, slot, value = _features(texts)
        total = np.bincount(row, weights=weights[slot] * value, minlength=len(texts)) + weights[-1]
        return 1 / (1 + np.exp(-total))

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        parts = [of(part) for _, part in row_slices(texts, _SLICE)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())

    return scored(text.cast("string"))


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[LabelModel, np.ndarray]:
    """The label model, from the votes of all rows, and the scorer's weights."""
    text = F.col(f"`{text_column}`").cast("string")
    voted = profiles(docs, text).select(votes().alias("votes"))
    counts = _pattern_counts(voted)
    model = fit_label_model(counts)
    return model, train_scorer(training_rows(docs, id_column, text, model, sum(counts.values())))


def accepted(text: Column, weights: np.ndarray, threshold: float = 0.5) -> Column:
    """Whether a text has a word and scores at least ``threshold``."""
    return F.coalesce(text, F.lit("")).rlike(r"[^\x09-\x0D\x20]") & (score(text, weights) >= threshold)


def classify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc_id``, ``quality_score`` (the scorer's probability) and ``accepted`` (at least ``threshold``) for every row.

    Fitted on ``docs`` itself. Null, empty and blank texts are not accepted. Repeated rows are rows of their own with equal
    scores; other columns are ignored; an empty table gives no rows.
    """
    _, weights = fit(docs, id_column, text_column)
    text = F.col(f"`{text_column}`").cast("string")
    scored = docs.select(F.col(f"`{id_column}`").alias("doc_id"), score(text, weights).alias("quality_score"), F.coalesce(text, F.lit("")).rlike(r"[^\x09-\x0D\x20]").alias("worded"))
    return scored.select("doc_id", "quality_score", (F.col("worded") & (F.col("quality_score") >= threshold)).alias("accepted"))


def accepted_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    _, weights = fit(docs, id_column, text_column)
    return docs.where(accepted(F.col(f"`{text_column}`").cast("string"), weights, threshold))
