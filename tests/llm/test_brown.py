from __future__ import annotations

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyline.llm import brown as B
from tallyline.llm.words import row_slices


def rows():
    pick = random.Random(12)
    nouns, verbs, others = [f"n{k}" for k in range(40)], [f"v{k}" for k in range(40)], [f"o{k}" for k in range(2000)]
    made = [" ".join(x for _ in range(pick.randrange(1, 40)) for x in (pick.choice(nouns), pick.choice(verbs), pick.choice(others))) for _ in range(400)]
    return list(enumerate(made)) + [(400, ""), (401, None), (402, "N1 n1\x0bÄ"), (7, made[7]), (None, "n1 v1")]


def test_exchange_gain_is_the_change_of_the_likelihood():
    pick = random.Random(1)
    units, classes = 12, 4
    text = [pick.randrange(units) for _ in range(2000)]
    member = np.array([pick.randrange(classes) for _ in range(units)])

    def bigrams(of):
        counts = np.zeros((classes, classes), dtype=np.int64)
        for a, b in zip(text, text[1:]):
            counts[of[a], of[b]] += 1
        return counts

    counts = bigrams(member)
    for unit in range(units):
        left, right, same = np.zeros(classes, int), np.zeros(classes, int), 0
        for a, b in zip(text, text[1:]):
            right[member[b]] += a == unit
            left[member[a]] += b == unit
            same += a == b == unit
        gain = B.exchange_gains(left, right, float(same), int(member[unit]), counts)
        for to in range(classes):
            moved = member.copy()
            moved[unit] = to
            assert gain[to] - gain[member[unit]] == pytest.approx(B.likelihood(bigrams(moved)) - B.likelihood(counts), abs=1e-6)


@pytest.fixture(scope="module")
def trained(spark):
    texts = spark.createDataFrame([(t or "",) for _, t in rows()], "text string")
    vocabulary = B.word_counts(texts)
    units = B.core_units(vocabulary, 40)
    member, core = B.cluster(B.unit_pairs(texts, units), units.rest + 1, 8)
    classed = B.word_classes(texts, vocabulary, units, member, core)
    return texts, vocabulary, units, member, core, {r["hash"]: (r["n"], r["class"]) for r in classed.collect()}, classed


def hashes(text):
    """The tokens of a text as the model knows them, with its end."""
    return B._tokens(pa.array([text or ""]))[1].view(np.int64).tolist()


def test_every_word_is_a_unit_with_the_class_of_its_contexts(trained):
    _, vocabulary, units, member, core, classes, _ = trained
    counts = Counter(h for _, t in rows() for h in hashes(t))
    assert {h: n for h, (n, _) in classes.items()} == counts and len(counts) > 2000
    of = dict(zip(units.hashes.view(np.int64).tolist(), member[units.numbers].tolist()))
    assert 20 < len(of) <= 40 and all(classes[h][1] == c for h, c in of.items())
    scores, sides = B.context_scores(core), {}
    for _, t in rows():
        own = [hashes("")[0], *hashes(t)]
        for before, word, after in zip(own, own[1:], [*own[2:], None]):
            if word not in of:
                cells = sides.setdefault(word, Counter())
                cells.update([of[before]] if before in of else [])
                cells.update([8 + of[after]] if after in of else [])
    for word, cells in sides.items():
        best = np.round(sum((scores[slot] * n for slot, n in sorted(cells.items())), np.zeros(8)), 9)
        assert classes[word][1] == (best.argmax() if cells else member[units.rest])
    held = core + 1.0
    assert np.allclose(scores[:8], np.log(held / held.sum(axis=0))) and np.allclose(scores[8:], np.log(held / held.sum(axis=1, keepdims=True)).T)


def test_exchange_ends_at_a_likelihood_that_no_turn_raises(spark):
    pick = random.Random(4)
    kinds = [[f"{k}{i}" for i in range(12)] for k in "abcd"]
    texts = spark.createDataFrame([(" ".join(pick.choice(kinds[i % 4]) for i in range(40)),) for _ in range(300)], "text string")
    vocabulary = B.word_counts(texts)
    units = B.core_units(vocabulary, 100)
    pairs = B.unit_pairs(texts, units)
    member, counts = B.cluster(pairs, units.rest + 1, 6)
    of = {w: member[units.of(B.batch_words(pa.array([w]))[1])][0] for kind in kinds for w in kind}
    # Classes are of one kind each; a kind may have two of the six.
    held = Counter((of[w], w[0]) for w in of)
    assert sum(max(held[c, k] for k in "abcd") for c in range(6)) == 48, held
    plain = np.zeros_like(counts)
    for r in pairs.collect():
        plain[member[r["u"]], member[r["v"]]] += r["n"]
    assert (plain == counts).all()
    # No single move raises the likelihood by more than what ends the sweeps.
    table = np.zeros((units.rest + 1, units.rest + 1))
    for r in pairs.collect():
        table[r["u"], r["v"]] += r["n"]
    for unit in range(len(table)):
        for to in range(6):
            other, trial = member.copy(), np.zeros((6, 6))
            other[unit] = to
            np.add.at(trial, (other[:, None], other[None, :]), table)
            assert B.likelihood(trial) <= B.likelihood(counts) + B.LEAST_RISE * table.sum()


@pytest.mark.parametrize("hot", [1, 60, 10_000])
def test_class_bigrams_equal_brute_force(trained, hot):
    texts, _, _, _, _, classes, classed = trained
    want, end = np.zeros((8, 8), dtype=np.int64), hashes("")[0]
    for _, t in rows():
        own = [end, *hashes(t)]
        for a, b in zip(own, own[1:]):
            want[classes[a][1], classes[b][1]] += 1
    frequent = B.hot_words(classed, hot)
    assert (B.class_bigrams(texts, classed, frequent, 8) == want).all() and len(frequent.hashes) <= hot + 1


def test_scores(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows()], "doc_id long, text string, score double")
    got = B.class_model_scores(docs, classes=8, core=60, hot=200).collect()
    assert len(got) == len(rows())
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(x for i, t in rows() if not held(i) for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (repr(i), held(i), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for i, t in rows()
    )
    assert sorted((repr(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got) == expected
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert all(r["score"] < 0 for r in got)
    assert B.class_model_scores(docs.limit(0)).count() == 0


def test_scores_are_the_models_log_probabilities(spark, trained):
    """Each text against the plain formula, word by word, with long texts and words that the model has never seen."""
    texts = trained[0]
    pick, own = random.Random(5), rows()
    long = " ".join(pick.choice(own[k % 400][1].split()) + ("new" if k % 7 == 0 else "") for k in range(150_000))
    docs = spark.createDataFrame([*own, (900, long), (901, "never seen these words"), (902, "")], "doc_id long, text string").na.fill("", "text")
    found = []
    for hot in (1, 60, 10_000):
        model, classed = B.train(texts, classes=8, core=40, hot=hot)
        classes = {r["hash"]: (r["n"], r["class"]) for r in classed.collect()}
        assert np.allclose((10.0**model.transition).sum(axis=1), 1)
        mass = np.zeros(8)
        for n, c in classes.values():
            mass[c] += 10.0 ** (model.known_mass[c] + math.log10(n))
        assert all(math.isclose(m + 10.0**e, 1) for m, e in zip(mass, model.escape) if m)

        def score(text):
            total, before = 0.0, classes[hashes("")[0]][1]
            for h in hashes(text):
                n, c = classes.get(h, (0, model.unseen))
                total += model.transition[before, c] + (model.known_mass[c] + math.log10(n) if n else model.escape[c])
                before = c
            return total

        got = {(r["doc_id"], r["text"]): (r["score"], r["n_known"]) for r in B.score_rows(docs.withColumn("kept", docs["text"]), model, classed).withColumnRenamed("kept", "text").collect()}
        for i, t in docs.collect():
            assert got[i, t][0] == pytest.approx(score(t), rel=1e-9) and got[i, t][1] == sum(h in classes for h in hashes(t))
        found.append(sorted((repr(k[0]), round(s, 6)) for k, (s, _) in got.items()))
    assert found[0] == found[1] == found[2]


def test_training_does_not_depend_on_the_slices_and_they_are_small(spark, monkeypatch):
    # The arrays of the tokens of one slice, as a training task makes them.
    text = pa.array(["ab cde f " * (B.SLICE_BYTES // 9)])
    tracemalloc.start()
    for _, part in row_slices(text, B.SLICE_BYTES):
        B._tokens(part)
    assert tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()

    rng = random.Random(5)
    texts = spark.createDataFrame([(" ".join(rng.choice("abcdefghijkl") for _ in range(40)),) for _ in range(60)], "text string").coalesce(1)

    def learned():
        model, classed = B.train(texts, 4, 6, 8)
        return model.transition.tolist(), sorted(map(tuple, classed.collect()))

    whole = learned()
    monkeypatch.setattr(B, "SLICE_BYTES", 200)
    assert learned() == whole
