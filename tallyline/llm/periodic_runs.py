"""Periodic stretches of words, found by window minima at several scales.

A run is a stretch of consecutive words that repeats with a smallest period q at least four times and cannot be made
longer on either side. Periods below ``SHORT`` are found by comparing the words with themselves, shifted by each of them.
For the periods of a scale, P <= q < 2P, all windows of 2P words are hashed and the least of every P neighbouring hashes
is marked. Inside a run, windows are equal exactly a multiple of q apart, so some marked window comes again, marked, after
q words and not before: neighbouring marks of equal hash are the seeds. Each is extended over the words themselves, so a
run is exact whatever the hashes; what a smaller period explains is left to that period's scale.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.words import mix, row_slices

#: Periods below it are found by direct comparison.
SHORT = 8
#: A run holds its period at least this often, and this many words.
TIMES, LEAST_WORDS = 4, 6
#: Text bytes that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 2 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FOUND = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def _stretches(ids: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """From and to of the stretches of places whose word is that ``lag`` places on, if long enough for a run."""
    same = np.zeros(max(len(ids) - lag, 0) + 2, dtype=np.int8)
    same[1:-1] = ids[: len(ids) - lag] == ids[lag:] if len(ids) > lag else 0
    turns = np.diff(same)
    begin, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    long = end - begin >= max(LEAST_WORDS, TIMES * lag) - lag
    return begin[long], end[long]


def _prime_factors(number: int) -> list[int]:
    found, at = [], 2
    while at * at <= number:
        if number % at == 0:
            found.append(at)
            while number % at == 0:
                number //= at
        at += 1
    return [*found, number] if number > 1 else found


def _is_smallest(ids: np.ndarray, start: int, period: int) -> bool:
    """Whether no part of ``period`` is a period of the run at ``start`` too.

    Two periods of a stretch that holds the greater one twice have a common divisor as period, so the parts of
    ``period`` by its prime factors are all there is to try.
    """
    first = ids[start : start + period]
    parts = (period // prime for prime in _prime_factors(period))
    return not any(np.array_equal(first, ids[start + part : start + part + period]) for part in parts)


def _windowed(values: np.ndarray, width: int, pick: np.ufunc, filler: int) -> np.ndarray:
    """``pick`` over every ``width`` neighbouring values, from running results forth and back within blocks."""
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, filler, dtype=values.dtype)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    forth = pick.accumulate(padded, axis=1).ravel()
    back = pick.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    ends = len(values) - width + 1
    return pick(back[:ends], forth[width - 1 : width - 1 + ends])


def _minima(values: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the least value of some ``width`` neighbours, ties included."""
    if len(values) < width:
        return np.empty(0, dtype=np.int64)
    least = _windowed(values, width, np.minimum, np.iinfo(values.dtype).max)
    around = np.zeros(len(least) + 2 * (width - 1), dtype=values.dtype)
    around[width - 1 : width - 1 + len(least)] = least
    return np.flatnonzero(_windowed(around, width, np.maximum, 0) == values)


def _seeds(values: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and distance of neighbouring minima of equal value, ``scale`` to below twice ``scale`` apart."""
    places = _minima(values, scale)
    places = places[np.argsort(values[places], kind="stable")]
    gap = np.diff(places)
    held = (np.diff(values[places]) == 0) & (gap >= scale) & (gap < 2 * scale)
    return places[:-1][held], gap[held]


def _extended(ids: np.ndarray, place: int, lag: int) -> tuple[int, int]:
    """The stretch around ``place`` whose words equal those ``lag`` on, compared in growing pieces."""
    end, most, step = place, len(ids) - lag, 4 * lag
    while end < most:
        stop = min(end + step, most)
        wrong = ids[end:stop] != ids[end + lag : stop + lag]
        if wrong.any():
            end += int(wrong.argmax())
            break
        end, step = stop, 2 * step
    begin, step = place, 4 * lag
    while begin > 0:
        stop = max(begin - step, 0)
        wrong = (ids[stop:begin] != ids[stop + lag : begin + lag])[::-1]
        if wrong.any():
            begin -= int(wrong.argmax())
            break
        begin, step = stop, 2 * step
    return begin, end


def _scale_runs(ids: np.ndarray, values: np.ndarray, scale: int) -> list[tuple[int, int, int]]:
    """Runs with a period from ``scale`` to below twice it; a stretch is extended once, however many seeds it has."""
    found: list[tuple[int, int, int]] = []
    places, lags = _seeds(values, scale)
    order = np.lexsort((places, lags))
    last, reached = -1, -1
    for place, lag in zip(places[order].tolist(), lags[order].tolist()):
        if lag == last and place < reached:
            continue
        begin, end = _extended(ids, place, lag)
        last, reached = lag, end
        if end - begin >= (TIMES - 1) * lag and _is_smallest(ids, begin, lag):
            found.append((begin, end - begin + lag, lag))
    return found


def find_runs(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, length and period of every run, by text, start and period.

    ``ids`` numbers the words of some texts, one after the other, each text ended by a number that occurs nowhere else;
    ``lengths`` counts each text's words without it. No stretch that repeats can go over such an end.
    """
    ids, lengths, texts = ids.astype(np.int64), lengths.astype(np.int64), np.arange(len(lengths))
    parts: list[np.ndarray] = []

    def keep(runs: list[tuple[int, int, int]]) -> None:
        if runs:
            table = np.array(runs, dtype=np.int64)
            starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
            owner = np.searchsorted(starts, table[:, 0], side="right") - 1
            parts.append(np.column_stack((texts[owner], table[:, 0] - starts[owner], table[:, 1], table[:, 2])))

    for lag in range(1, SHORT):
        begin, end = _stretches(ids, lag)
        keep([(a, b - a + lag, lag) for a, b in zip(begin.tolist(), end.tolist()) if _is_smallest(ids, a, lag)])
    values, scale, width = mix(ids), SHORT, 1
    while True:
        fits = lengths >= TIMES * scale
        if not fits.any():
            break
        if not fits.all():
            held = np.repeat(fits, lengths + 1)
            ids, values, texts, lengths = ids[held], values[held], texts[fits], lengths[fits]
        while width < 2 * scale:
            with np.errstate(over="ignore"):
                wider = values * _STEP
                wider[:-width] += values[width:]
            values, width = mix(wider), 2 * width
        keep(_scale_runs(ids, values, scale))
        scale *= 2
    table = np.concatenate(parts) if parts else np.empty((0, 4), dtype=np.int64)
    table = table[np.lexsort((table[:, 3], table[:, 1], table[:, 0]))]
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def _of_slice(texts: pa.Array) -> tuple[np.ndarray, pa.StructArray, list[bytes]]:
    """Runs per text, the runs themselves, and the texts without the repeats."""
    words = [text.split() if text else [] for text in texts.cast(pa.binary()).to_pylist()]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids = np.empty(int(lengths.sum()) + len(words), dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    for k, (own, start) in enumerate(zip(words, starts.tolist())):
        ids[start : start + len(own)] = np.fromiter(map(number.__getitem__, own), dtype=np.int64, count=len(own))
        ids[start + len(own)] = -1 - k
    text, start, length, period = find_runs(ids, lengths)
    change = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(change, starts[text] + start + period, 1)
    np.add.at(change, starts[text] + start + length, -1)
    kept = np.cumsum(change) == 0
    hit = set(text.tolist())
    out = [b" ".join(compress(own, kept[at : at + len(own)].tolist()) if k in hit else own) for k, (own, at) in enumerate(zip(words, starts.tolist()))]
    runs = pa.StructArray.from_arrays([pa.array(v) for v in (start, length, period)], names=["start", "length", "period"])
    return np.column_stack((lengths, np.bincount(text, minlength=len(words)))), runs, out


def runs_of(text: Column, slice_bytes: int = SLICE_BYTES) -> Column:
    """``n_words``, ``runs`` (``start``, ``length``, ``period`` in words, by start and period) and ``collapsed`` of a text.

    Words are the runs without spaces and control blanks, told apart by case. ``collapsed`` is the text with one space
    between words and, of each run, its first period only: a word goes if any run has it after that run's first period.
    Null and empty texts have no words, no runs and an empty ``collapsed``.
    """

    @F.arrow_udf(_FOUND)
    def find(texts: pa.Array) -> pa.Array:
        facts, runs, out = [np.empty((0, 2), dtype=np.int64)], [], []
        for _, part in row_slices(texts, slice_bytes):
            of_text, found, collapsed = _of_slice(part)
            facts.append(of_text)
            runs.append(found)
            out.append(pa.array(collapsed, pa.binary()).cast(pa.string()))
        n_words, n_runs = np.concatenate(facts).T
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        bounds = pa.array(np.concatenate(([0], np.cumsum(n_runs))).astype(np.int32))
        lists = pa.ListArray.from_arrays(bounds, pa.concat_arrays(runs) if runs else pa.array([], kind))
        texts_out = pa.concat_arrays(out) if out else pa.array([], pa.string())
        return pa.StructArray.from_arrays([pa.array(n_words), lists, texts_out], names=["n_words", "runs", "collapsed"])

    return find(text.cast("string"))


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``runs``, ``collapsed`` for every row, as told in :func:`runs_of`.

    A projection: no row moves, so hot keys do not matter, and repeated rows and ids each keep a row. A null text has no
    words, a null id stays null, other columns are ignored, an empty table gives no rows. Memory follows the longest
    text of a task, not the number of rows in a batch.
    """
    found = docs.select(F.col(f"`{id_column}`").alias("doc_id"), runs_of(F.col(f"`{text_column}`")).alias("found"))
    return found.select("doc_id", "found.n_words", "found.runs", "found.collapsed")


def longest_run(runs: Column) -> Column:
    """The run with the greatest length, of equal ones that with the smallest start and then period; null without runs."""
    ranked = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    return F.when(F.size(runs) > 0, F.struct((-ranked["back"]).alias("start"), ranked["length"].alias("length"), (-ranked["short"]).alias("period")))


def written(runs: Column) -> Column:
    """A line ``start,length,period`` per run."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")
