from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tallyline.llm import weak_labels as Q


def corpus():
    pick = random.Random(21)
    words = [f"{a}{b}{c}" for a in "tr st pl br".split() for b in "ing and est ol".split() for c in ["", "er", "ly"]]
    prose = lambda: ". ".join(" ".join(pick.choice(words) for _ in range(pick.randrange(6, 14))).capitalize() for _ in range(pick.randrange(3, 9))) + "."
    made = [(1, prose()) for _ in range(400)]
    made += [(0, " ".join(w + pick.choice(["###", "%%%", "$$$"]) for w in prose().split())) for _ in range(30)]
    made += [(0, "!! ".join(prose().upper().split()) + "!!") for _ in range(30)]
    made += [(0, " ".join(x for w in prose().split()[:9] for x in [w] * 12)) for _ in range(30)]
    pick.shuffle(made)
    return made


def test_expectation_maximisation_recovers_accuracies():
    draw = np.random.default_rng(5)
    truth = draw.random(40_000) < 0.7
    accuracies, coverage = [0.9, 0.8, 0.7, 0.95, 0.6], [0.9, 0.7, 0.8, 0.5, 0.9]
    votes = []
    for accuracy, cover in zip(accuracies, coverage):
        right = np.where(draw.random(len(truth)) < accuracy, truth, ~truth)
        votes.append(np.where(draw.random(len(truth)) < cover, np.where(right, "g", "b"), "-"))
    patterns, counts = np.unique(np.array(["".join(v) for v in zip(*votes)]), return_counts=True)
    model = Q.fit_label_model(dict(zip(patterns.tolist(), counts.tolist())))
    assert model.prior == pytest.approx(0.7, abs=0.03)
    assert np.allclose(model.accuracy, accuracies, atol=0.03)
    assert Q.fit_label_model({}).posterior == {}


def test_planted_faults_go_and_prose_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en") for i, (_, t) in enumerate(rows)] + [(9000, None, "en"), (9001, "", "en"), (9002, " \n", "en"), (3, rows[3][1], "en")], "doc_id long, text string, accepted string")
    got = Q.classify(docs).collect()
    assert len(got) == len(rows) + 4
    verdict = {r["doc_id"]: r["accepted"] for r in got}
    good = [verdict[i] for i, (label, _) in enumerate(rows) if label]
    bad = [verdict[i] for i, (label, _) in enumerate(rows) if not label]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)
    assert not verdict[9000] and not verdict[9001] and not verdict[9002]
    kept = Q.accepted_documents(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, v in verdict.items() if v}
    assert Q.classify(docs.limit(0)).count() == 0


def test_profiles_count_words(spark):
    text = "One one ONE!! a### 1,\n\n b. b. é|é"
    docs = spark.createDataFrame([(text,), (None,)], "text string")
    row, empty = Q.profiles(docs, docs["text"]).collect()
    assert row.asDict() == {"n_words": 8, "n_chars": 24, "n_signs": 4, "n_sign_words": 2, "n_upper_words": 1, "n_shout_words": 1, "n_stops": 3, "n_stutters": 1, "n_distinct": 7}
    assert set(empty.asDict().values()) == {0}


def test_texts_longer_than_a_part_count_as_a_whole(spark, monkeypatch):
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    long = " ".join(words[k // 3 % 5] for k in range(800_000))
    docs = spark.createDataFrame([(long,), ("x x",)], "text string")
    row, short = sorted(Q.profiles(docs, docs["text"]).collect(), key=lambda r: -r["n_words"])
    assert (row["n_words"], row["n_distinct"], row["n_stutters"]) == (800_000, 5, 533_333)
    assert (short["n_distinct"], short["n_stutters"]) == (1, 1)
    pick, whole = random.Random(3), Q.word_blocks
    texts = pa.array([" ".join(pick.choice(words + ["A!", "##", "é."]) for _ in range(pick.randrange(60))) for _ in range(30)] + [None, ""])
    counts = lambda: sum(Q._part_counts(p, len(texts)) for p in Q._parts(texts))
    plain, features = counts(), Q._features(texts)
    for size in (3, 17, 100):
        monkeypatch.setattr(Q, "word_blocks", lambda t, b, lower, size=size: whole(t, b, size, lower=lower))
        assert (counts() == plain).all()
        assert all(np.allclose(a, b) for a, b in zip(Q._features(texts), features))
    monkeypatch.undo()
    for k, text in enumerate(texts.to_pylist()):
        own = (text or "").split()
        assert plain[k, 0] == len(own) and plain[k, 8] == len(set(own)) and plain[k, 7] == sum(a == b for a, b in zip(own, own[1:]))


def test_the_scorer_is_logistic_regression_on_the_features(spark):
    """Scores of the tasks against the plain formula, from the weights and one text's features."""
    rows = corpus()[:80]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    model, weights = Q.fit(docs)
    assert model.posterior and np.isfinite(weights).all()
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", Q.score(docs["text"], weights).alias("s")).collect()}
    for i, (_, text) in enumerate(rows):
        own = text.split()
        _, slot, value = Q._features(pa.array([text]))
        assert np.isclose((value**2).sum(), 1) and len(slot) <= 2 * len(set(own)) + 1
        odds = sum(weights[s] * v for s, v in zip(slot, value)) + weights[-1]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-9)
