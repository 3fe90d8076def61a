from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyline.llm.components import connected_components
from tallyline.llm.prefix import running_totals
from tallyline.llm.words import SIGN_BREAKS, batch_words, row_slices, word_blocks

TEXTS = ["", None, "A b\tC", "  Ärger\x0bund  ärger ", "x" * 200, "one two three four", "\n\n", "a-b 9é_z"]


def test_words_match_plain_splitting_whatever_the_block():
    array = pa.array(TEXTS)
    expected = [(i, w) for i, t in enumerate(TEXTS) for w in (t or "").encode().lower().split()]
    for block in (3, 8, 1 << 20):
        found = [(int(r), bytes(b.raw[s:e])) for b in word_blocks(array, block=block) for r, s, e in zip(b.row, b.start, b.end)]
        assert found == expected or block < 200  # a word longer than a block may be met in a block of its own
        row, hashes = batch_words(array)
        assert np.concatenate([b.hash for b in word_blocks(array, block=block)]).tolist() == hashes.tolist()
        assert row.tolist() == [i for i, _ in expected]
    assert len(set(batch_words(array)[1].tolist())) == len({w for _, w in expected})
    signs = [bytes(b.raw[s:e]) for b in word_blocks(pa.array(["a-b 9é_z A1"]), SIGN_BREAKS) for s, e in zip(b.start, b.end)]
    assert signs == [b"a", b"b", "9é".encode(), b"z", b"a1"]


def test_slices_cover_all_rows_of_a_sliced_array():
    array = pa.array(TEXTS).slice(2)
    parts = list(row_slices(array, 5))
    assert [t for _, p in parts for t in p.to_pylist()] == TEXTS[2:]
    assert batch_words(array)[1].tolist() == batch_words(pa.array(TEXTS[2:]))[1].tolist()
    assert list(row_slices(pa.array([], pa.string()))) == []


def test_running_totals(spark):
    values = [random.Random(3).randrange(10) for _ in range(500)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int").repartition(7)
    got = {r["i"]: (r["before"], r["top"]) for r in running_totals(rows, ["i"], {"before": F.col("v")}, {"top": F.col("v")}).collect()}
    assert got == {i: (sum(values[:i]), max(values[:i], default=None)) for i in range(500)}
    assert running_totals(rows.limit(0), ["i"], {"before": F.col("v")}).count() == 0


def test_connected_components(spark):
    pick = random.Random(5)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 480)] + [(7, 7), (None, 3)]
    root = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {n: find(n) for n in root}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_words_with_capitals_are_whole_whatever_the_block():
    array = pa.array(["HELLO iPhone McDonald", "ab CDEFGHIJKLM-nO 9Z", "é9ÄB tail"])
    whole = [(int(r), bytes(b.raw[s:e])) for b in word_blocks(array, SIGN_BREAKS) for r, s, e in zip(b.row, b.start, b.end)]
    assert (0, b"mcdonald") in whole and (1, b"cdefghijklm") in whole
    for block in (3, 8):
        found = [(int(r), bytes(b.raw[s:e])) for b in word_blocks(array, SIGN_BREAKS, block=block) for r, s, e in zip(b.row, b.start, b.end)]
        assert found == whole
