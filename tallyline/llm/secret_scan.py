"""Secrets in texts: fixed forms, and character Markov models that tell random strings from ordinary identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.words import row_slices

# The three base forms, in the order in which their kinds are listed.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

#: Characters of the models; anything else ends a string.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SIZE = len(ALPHABET)
_CODE = np.full(256, -1, dtype=np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(_SIZE)
#: Characters at which a string is cut into words and parts of keys.
_JOINTS = "/_-"
_IS_JOINT = np.zeros(_SIZE, dtype=bool)
_IS_JOINT[[ALPHABET.index(c) for c in _JOINTS]] = True

_LETTERS = 52

#: Lengths of the strings that are samples of the ordinary class; longer ones hold too many keys to be called that, but
#: for those of letters only.
LEAST_IDENTIFIER, MOST_IDENTIFIER = 4, 19
#: Least length of a random stretch.
LEAST_RANDOM = 12
#: Made-up random strings per alphabet that join the corpus' own in the random class.
RANDOM_SAMPLES = 2000
#: Share of the made-up random strings of least length that may fall below the threshold, and the lowest threshold (nats).
MISSED, LEAST_RATIO = 0.02, 14.0
#: Weight of a character's own frequency in a transition probability: in characters, and at least as a share. The share
#: keeps what is never seen equally unlikely in a corpus of any size.
_BACKOFF, _LEAST_BACKOFF = 5.0, 0.02
_BLOCK = 1 << 20


class Span(NamedTuple):
    kind: int
    start: int
    end: int


_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
_LONG_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")


def base_spans(text: str) -> list[Span]:
    """Spans of the base forms, in code points. Runs of hex digits and access keys are maximal, so length can be asked at once."""
    found = []
    if ":" in text or "=" in text:
        found += [Span(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [Span(1, m.start(), m.end()) for m in _LONG_ACCESS.finditer(text)]
    found += [Span(2, m.start(), m.end()) for m in _LONG_HEX.finditer(text)]
    return found


def _value(text: str, span: Span) -> str:
    """The secret itself: of an assignment, what follows the sign."""
    own = text[span.start : span.end]
    return ASSIGN.fullmatch(own).group(2) if span.kind == 0 else own


def transitions(texts: list[str], least: int = LEAST_IDENTIFIER, most: int = MOST_IDENTIFIER) -> np.ndarray:
    """Counts of (previous character or start, character) in the strings of ``least`` to ``most`` characters, and longer ones of letters only."""
    counts = np.zeros((_SIZE + 1) * _SIZE, dtype=np.int64)
    raw = np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    at = 0
    while at < len(raw):
        end = at + _BLOCK
        while end < len(raw) and _CODE[raw[end]] >= 0:
            end += 1
        code = _CODE[raw[at:end]]
        inside = code >= 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        start, length = edge[::2], edge[1::2] - edge[::2]
        marks = np.concatenate(([0], np.cumsum(code >= _LETTERS)))
        used = (length >= least) & ((length <= most) | (marks[start + length] == marks[start]))
        start, length = start[used], length[used]
        if len(start):
            place = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
            previous = code[place - 1]
            previous[np.concatenate(([0], np.cumsum(length)[:-1]))] = _SIZE
            counts += np.bincount(previous * _SIZE + code[place], minlength=len(counts))
        at = end
    return counts


#: The alphabets that keys are commonly written in.
_ALPHABETS = (ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-", ALPHABET[26:36] + ALPHABET[52:62], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62])


def random_samples(per_alphabet: int = RANDOM_SAMPLES, seed: int = 9, least: int = 20, most: int = 64) -> list[str]:
    """Labelled random strings: uniform over the alphabets."""
    draw = np.random.default_rng(seed)
    return ["".join(np.array(list(a))[draw.integers(0, len(a), draw.integers(least, most + 1))]) for a in _ALPHABETS for _ in range(per_alphabet)]


def _log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P(character | previous character); a transition leans on how frequent the character is."""
    table = counts.reshape(_SIZE + 1, _SIZE).astype(float)
    alone = (1 - _LEAST_BACKOFF) * table.sum(axis=0) / max(table.sum(), 1.0) + _LEAST_BACKOFF / _SIZE
    alone /= alone.sum()
    rows = table.sum(axis=1, keepdims=True)
    lean = np.maximum(_BACKOFF / (rows + _BACKOFF), _LEAST_BACKOFF)
    return np.log((1 - lean) * table / np.maximum(rows, 1.0) + lean * alone[None, :])


class Odds(NamedTuple):
    """Per transition, log P(random) - log P(ordinary), and the ratio from which a stretch is called random."""

    table: np.ndarray
    threshold: float


def fit_odds(random: np.ndarray, ordinary: np.ndarray) -> Odds:
    """The models' log odds from transition counts, and a threshold from labelled random strings of least length.

    Made-up random strings weigh as much as the corpus' own at least, so a corpus full of secrets that are plain words
    does not make words random. The threshold is what all but ``MISSED`` of fresh random strings of ``LEAST_RANDOM``
    letters and digits reach, and ``LEAST_RATIO`` at least: longer strings only score higher.
    """
    made = transitions(random_samples(), 1, _BLOCK).astype(float)
    own = random.astype(float) * min(1.0, made.sum() / max(random.sum(), 1))
    table = _log_probabilities(made + own) - _log_probabilities(ordinary)
    draw = np.random.default_rng(10)
    scores = [ratio("".join(np.array(list(ALPHABET[:62]))[draw.integers(0, 62, LEAST_RANDOM)]), table) for _ in range(2000)]
    return Odds(table, float(max(LEAST_RATIO, np.quantile(scores, MISSED))))


def train(docs: DataFrame, text_column: str = "text") -> Odds:
    """The log odds, learned from all texts.

    Random strings: the values of all base spans, and made-up ones. Ordinary identifiers: all other strings of the texts
    but long ones with digits or signs. Texts are worked on in slices, tasks send counts per slice; Spark adds them up, and the driver receives two rows of fixed length.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in row_slices(batch.column(0), _BLOCK):
                secret, rest = [], []
                for text in part.to_pylist():
                    at, text = 0, text or ""
                    for span in sorted(base_spans(text), key=lambda s: s.start):
                        secret.append(_value(text, span))
                        rest.append(text[at : span.start])
                        at = max(at, span.end)
                    rest.append(text[at:])
                pair = np.concatenate([transitions(secret, 1, _BLOCK), transitions(rest)])
                index = np.flatnonzero(pair)
                yield pa.RecordBatch.from_arrays([pa.array(index.astype(np.int32)), pa.array(pair[index])], names=["cell", "n"])

    cells = docs.select(F.col(f"`{text_column}`").cast("string").alias("text")).mapInArrow(count, "cell int, n bigint")
    summed = cells.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros(2 * (_SIZE + 1) * _SIZE, dtype=np.int64)
    both[summed["cell"].to_numpy(np.int64)] = summed["n"].to_numpy(np.int64)
    return fit_odds(both[: len(both) // 2], both[len(both) // 2 :])


def ratio(string: str, table: np.ndarray) -> float:
    """Log-likelihood ratio of a string of the alphabet: above zero speaks for a random string."""
    code = _CODE[np.frombuffer(string.encode("ascii"), dtype=np.uint8)]
    return float(table[np.concatenate(([_SIZE], code[:-1])), code].sum())


def _stretches(scores: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
    """Places (from, to) of the best stretches: a running sum starts anew where it is not positive, its peak ends the stretch.

    The sum also ends where it has fallen by the threshold below its peak, so two keys with a word between are two.
    """
    total, begin, peak, end = 0.0, 0, 0.0, 0
    for at, score in enumerate(scores.tolist()):
        total += score
        if total > peak:
            peak, end = total, at + 1
        if total <= 0 or total < peak - threshold:
            if peak >= threshold:
                yield begin, end
            total, peak, begin = 0.0, 0.0, at + 1
    if peak >= threshold:
        yield begin, end


def _whole_parts(joints: np.ndarray, begin: int, end: int) -> tuple[int, int]:
    """A stretch widened to whole parts between joints, less those of which it holds less than half; joints at its ends go."""
    cuts = np.concatenate(([-1], np.flatnonzero(joints), [len(joints)]))
    left, right = int(np.searchsorted(cuts, begin, side="right")) - 1, int(np.searchsorted(cuts, end, side="left"))
    first, last = int(cuts[left]) + 1, int(cuts[left + 1])
    begin = first if 2 * (last - max(begin, first)) >= last - first else last + 1
    first, last = int(cuts[right - 1]) + 1, int(cuts[right])
    end = last if 2 * (min(end, last) - first) >= last - first else first - 1
    while begin < end and joints[begin]:
        begin += 1
    while begin < end and joints[end - 1]:
        end -= 1
    return begin, end


def random_stretches(text: str, odds: Odds, taken: list[Span] | tuple[()] = ()) -> Iterator[tuple[int, int]]:
    """Places (from, to) of the stretches that the models call random, in code points.

    Strings of the alphabet are judged by the best stretch of their characters' log odds, so a key behind a path or a name
    counts by itself. What lies in the spans ``taken`` ends strings, so a key beside one counts by itself too. Short strings and those whose running sum stays low never leave the whole-array steps.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if taken:
        points = points.copy()
        for span in taken:
            points[span.start : span.end] = 0
    at = 0
    while at < len(points):
        stop = min(at + _BLOCK, len(points))
        while stop < len(points) and points[stop] < 256 and _CODE[points[stop]] >= 0:
            stop += 1
        part = points[at:stop]
        # A sign of equality ends a string: it pads a key or stands before one.
        code = np.where((part < 256) & (part != ord("=")), _CODE[np.minimum(part, 255)], -1)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], code >= 0, [False])).astype(np.int8)))
        begins, ends = edges[::2], edges[1::2]
        long = ends - begins >= LEAST_RANDOM
        for begin, end in zip(begins[long].tolist(), ends[long].tolist()):
            own = code[begin:end]
            scores = odds.table[np.concatenate(([_SIZE], own[:-1])), own]
            sums = np.concatenate(([0.0], np.cumsum(scores)))
            if (sums - np.minimum.accumulate(sums)).max() < odds.threshold:
                continue
            for a, b in _stretches(scores, odds.threshold):
                a, b = _whole_parts(_IS_JOINT[own], a, b)
                if b - a < LEAST_RANDOM or sums[b] - sums[a] < odds.threshold:
                    continue
                while b >= len(own) and begin + b < len(part) and part[begin + b] == ord("="):
                    b += 1
                string = text[at + begin + a : at + begin + b]
                if 2 * len(set(string)) >= min(len(string), 16) and not string.isdigit():
                    yield at + begin + a, at + begin + b
        at = stop


def all_spans(text: str, odds: Odds) -> list[Span]:
    """Base spans, and random stretches of what is left, by start and then kind."""
    base = base_spans(text)
    return sorted(base + [Span(3, a, b) for a, b in random_stretches(text, odds, base)], key=lambda s: (s.start, s.kind))


def spans(text: Column, odds: Odds) -> Column:
    """All spans of a text: array of (``kind``, ``start``, ``stop``), by start and then kind as listed; code points."""
    kind = "array<struct<kind:int,start:int,stop:int>>"

    @F.arrow_udf(kind)
    def scan(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts:
            rows.append([{"kind": s.kind, "start": s.start, "stop": s.end} for s in all_spans(value.as_py() or "", odds)])
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])))

    return scan(text.cast("string"))


def written(found: Column) -> Column:
    """kind:start:stop of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", odds: Odds | None = None) -> DataFrame:
    """``doc_id``, ``found`` (the spans) for every row; the models are learned from ``docs`` unless given.

    Null and empty texts have no spans. The base spans of a text do not depend on other rows; the random ones do, through
    the models. Repeated rows are rows of their own; other columns are ignored.
    """
    table = train(docs, text_column) if odds is None else odds
    return docs.select(F.col(f"`{id_column}`").alias("doc_id"), spans(F.col(f"`{text_column}`"), table).alias("found"))


def redact(docs: DataFrame, text_column: str = "text", length_column: str | None = "n_chars", odds: Odds | None = None, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one); the length column counts code points anew.

    Rows and other columns stay; texts without a span, null among them, are unchanged.
    """
    table = train(docs, text_column) if odds is None else odds

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts:
            own = value.as_py()
            if own:
                parts, at = [], 0
                for span in all_spans(own, table):
                    if span.start >= at:
                        parts += [own[at : span.start], mark]
                    at = max(at, span.end)
                own = "".join(parts) + own[at:] if parts else own
            out.append(own)
        return pa.array(out, pa.string())

    masked = docs.withColumn(text_column, mask(F.col(f"`{text_column}`")))
    if length_column is None or length_column not in docs.columns:
        return masked
    return masked.withColumn(length_column, F.when(F.col(f"`{text_column}`").isNotNull(), F.char_length(f"`{text_column}`").cast("bigint")).otherwise(F.col(f"`{length_column}`")))
