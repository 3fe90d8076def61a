from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import secret_scan as S

CASES = [
    "password = hunter22x and Token: 'short' secret:abcdefgh.",
    "api_key=\"A1b2C3d4e5\" apiKEY= zzzzzzzz PASSWD:12345678",
    "x AKIAABCDEFGHIJKL y AKIA123 AKIAAKIAAKIAAKIA",
    "0123456789abcdef0123456789abcdef é 0123456789abcdef0123456789abcde",
    "token=0123456789abcdef0123456789abcdef01",
    "é token = ſecret toKen: abcdefgh token==aaaaaaaaa secret : : b",
    "",
    None,
]


def brute(text):
    text, found = text or "", []
    for m in re.finditer(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 16:
            found.append((m.start(), 1, m.end()))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 32:
            found.append((m.start(), 2, m.end()))
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


@pytest.fixture(scope="module")
def corpus():
    pick = random.Random(2)
    words = "configuration manager handler internationalization synchronize userAccountRepository parse_the_document buildHttpClientFactory getUserName setItemCount buildUrl parseJson".split()
    prose = [" ".join(pick.choice(words) for _ in range(50)) for _ in range(60)]
    key = "".join(pick.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    return prose, key


def test_base_spans_match_brute_force(spark, corpus):
    pick = random.Random(4)
    atoms = ["token", "=", ":", " ", "'", "abcdef01", "AKIA", "QWERTY12", "secret", "api_key", "0123456789abcdef", "é", "\n", ".", "API"]
    texts = CASES + ["".join(pick.choice(atoms) for _ in range(30)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    got = {r["doc_id"]: r for r in S.scan_documents(docs).select("doc_id", "found", S.written(F.filter("found", lambda s: s["kind"] < 3)).alias("w")).collect()}
    for i, t in enumerate(texts):
        assert got[i]["w"] == ",".join(f"{k}:{a}:{b}" for k, a, b in brute(t)), t
        base = [s for s in got[i]["found"] if s["kind"] < 3]
        assert not any(r["kind"] == 3 and r["start"] < b["stop"] and b["start"] < r["stop"] for r in got[i]["found"] for b in base)
    assert S.scan_documents(docs.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(S.written(F.array().cast("array<struct<kind:int,start:int,stop:int>>")), 256)).first()[0]


def test_models_tell_random_strings_from_identifiers(spark, corpus):
    prose, key = corpus
    texts = [*prose, f"use {key} here", f"see https://host.example/a/path/of/userAccountRepository and {'-' * 40} 1234567890123456789012345"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["found"] for r in S.scan_documents(docs).collect()}
    assert [(s["kind"], s["start"], s["stop"]) for s in rows[60]] == [(3, 4, 44)]
    assert all(not found for i, found in rows.items() if i != 60)


def test_redaction(spark, corpus):
    prose, key = corpus
    docs = spark.createDataFrame([(0, f"a token={key} b", 0, 1), (1, prose[0], len(prose[0]), 2), (2, None, None, 3), (3, "é AKIAABCDEFGHIJKL", 18, 4)], "doc_id long, text string, n_chars long, extra int")
    got = {r["doc_id"]: r for r in S.redact(docs).collect()}
    assert got[0]["text"] == "a <secret> b" and got[0]["n_chars"] == 12 and got[3]["text"] == "é <secret>"
    assert got[1]["text"] == prose[0] and got[2]["text"] is None and got[2]["n_chars"] is None and S.redact(docs).columns == docs.columns


def test_transitions_count_across_blocks():
    texts = ["abc-def ghi", "xyzxyzéabcdef", "", "k" * 100]
    counts = S.transitions(texts, 6, 1000)
    assert S.transitions(texts, 6, 19).sum() == 19 + 100 and S.transitions(["1" * 100, "a-" * 30], 6, 19).sum() == 0
    strings = [s for t in texts for s in re.findall("[A-Za-z0-9+/_=-]{6,}", t)]
    assert counts.sum() == sum(map(len, strings)) and counts.reshape(S._SIZE + 1, S._SIZE)[S._SIZE].sum() == len(strings)
    before, S._BLOCK = S._BLOCK, 7
    try:
        assert np.array_equal(S.transitions(texts, 6, 1000), counts)
    finally:
        S._BLOCK = before


def corpus_of(n, seed=3):
    """Texts of made-up words, names and numbers, with some capitals and paths."""
    pick = random.Random(seed)
    parts = "con fig ura tion man ager hand ler inter nal ize syn chro user acc ount repo sit ory parse doc ument build client fact ory get name set item url".split()
    word = lambda: "".join(pick.choice(parts) for _ in range(pick.randrange(1, 5)))
    made = lambda: pick.choice([word, word, word, lambda: word().capitalize() + word().capitalize(), lambda: word().upper(), lambda: "/".join(word() for _ in range(3)), lambda: str(pick.randrange(10**6)), lambda: f"{word()}_{word()}-{pick.randrange(99)}"])()
    return [" ".join(made() for _ in range(60)) for _ in range(n)]


@pytest.mark.parametrize("n", [200, 1000, 10_000])
def test_short_and_embedded_keys_are_found_in_corpora_of_any_size(n):
    pick, texts = random.Random(n), corpus_of(n)
    odds = S.fit_odds(S.transitions(["0123456789abcdef" * 2], 1, S._BLOCK), S.transitions(texts))
    for length, least in ((12, 0.9), (15, 0.95), (19, 0.98)):
        for before, after in (("", ""), ("/account/document/factory/", ""), ("user_", "-name"), ("key=", "=="), ("x+", "")):
            found = 0
            for _ in range(200):
                key = "".join(pick.choice(S.ALPHABET[:62]) for _ in range(length))
                text = f"é see {before}{key}{after} here"
                start = text.index(key)
                found += any(a <= start and start + length <= b and b - a <= length + 3 for a, b in S.random_stretches(text, odds))
            assert found >= least * 200, (length, before, found)
    plain = corpus_of(300, seed=99)
    assert sum(bool(list(S.random_stretches(t, odds))) for t in plain) <= 3


def test_best_stretches_equal_brute_force():
    draw = np.random.default_rng(6)
    for _ in range(300):
        scores = draw.integers(-9, 8, draw.integers(1, 40)).astype(float)
        threshold = float(draw.integers(5, 30))
        got = list(S._stretches(scores, threshold))
        assert all(scores[a:b].sum() >= threshold and a < b for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
        best = max((scores[a:b].sum() for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0)
        assert bool(got) == (best >= threshold)


def test_random_stretches_do_not_depend_on_blocks_and_touch_no_base_span(monkeypatch):
    pick, texts = random.Random(8), corpus_of(300)
    odds = S.fit_odds(S.transitions([], 1, S._BLOCK), S.transitions(texts))
    key = lambda n: "".join(pick.choice(S.ALPHABET[:62]) for _ in range(n))
    text = " é\n".join(f"{t} token={key(30)} {key(20)} AKIA{'Q' * 20}/{key(25)} {'0123456789abcdef' * 2}" for t in texts[:40])
    whole = S.all_spans(text, odds)
    base = S.base_spans(text)
    extra = [s for s in whole if s.kind == 3]
    assert len(extra) >= 75 and [s for s in whole if s.kind < 3] == sorted(base, key=lambda s: (s.start, s.kind))
    assert not any(r.start < b.end and b.start < r.end for r in extra for b in base)
    monkeypatch.setattr(S, "_BLOCK", 50)
    assert S.all_spans(text, odds) == whole


def test_a_very_long_text_of_keys(spark):
    pick, texts = random.Random(1), corpus_of(100)
    key = lambda: "".join(pick.choice(S.ALPHABET[:62]) for _ in range(24))
    long = " ".join(f"{key()} token={key()} word" for _ in range(20_000))
    docs = spark.createDataFrame([(1, long), (2, texts[0]), (3, None)], "doc_id long, text string")
    odds = S.fit_odds(S.transitions([], 1, S._BLOCK), S.transitions(texts))
    rows = {r["doc_id"]: r for r in S.scan_documents(docs, odds=odds).select("doc_id", F.size("found").alias("n"), F.size(F.filter("found", lambda s: s["kind"] == 0)).alias("base")).collect()}
    assert rows[1]["base"] == 20_000 and rows[1]["n"] >= 39_500 and rows[3]["n"] == 0
