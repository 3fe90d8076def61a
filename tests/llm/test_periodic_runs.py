from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyline.llm import periodic_runs as R
from tallyline.llm import queries


def brute_runs(words):
    """(start, length, period) of every run, by start and period: all lags, all stretches, all smaller periods."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - at + q
            if length >= max(6, 4 * q) and not any(all(words[i] == words[i + p] for i in range(at, at + length - p)) for p in range(1, q)):
                found.append((at, length, q))
            at = end
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(rng, parts=6):
    """Words with stretches of many periods, repeated just under, at and over four times, next to and inside each other."""
    out = []
    for _ in range(rng.randrange(1, parts)):
        period = rng.choice([1, 2, 3, 4, 6, 7, 8, 9, 12, 15, 16, 17, 20, 31, 32, 33, 40])
        base = [str(rng.randrange(rng.choice([1, 2, 3, 5, 50]))) for _ in range(period)]
        out += [base[i % period] for i in range(int(period * rng.choice([1, 2, 3.5, 3.9, 4, 4.1, 5, 7.3])))]
        if rng.random() < 0.5:
            out += [str(rng.randrange(50)) for _ in range(rng.randrange(6))]
    return out


def test_runs_of_many_texts_at_once_equal_brute_force():
    rng, seen = random.Random(1), 0
    for _ in range(120):
        texts = [repetitive(rng) for _ in range(rng.randrange(1, 7))] + [[], ["x"]]
        number = {}
        ids = np.array([i for k, t in enumerate(texts) for i in [*(number.setdefault(w, len(number)) for w in t), -1 - k]])
        got = np.column_stack(R.find_runs(ids, np.array([len(t) for t in texts]))).tolist()
        want = [[k, *run] for k, t in enumerate(texts) for run in brute_runs(t)]
        assert got == want
        seen += len(want)
    assert seen > 500


def test_a_run_inside_a_longer_period_and_equal_neighbours():
    inner = ["a", "b"] * 5 + ["c"] * 7
    words = inner * 4
    runs = brute_runs(words)
    assert (0, len(words), len(inner)) in runs and len(runs) == 9
    ids = np.array([ord(w) for w in words] + [-1])
    assert np.column_stack(R.find_runs(ids, np.array([len(words)])))[:, 1:].tolist() == [list(r) for r in runs]


def test_nulls_blanks_repeats_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "x " * 6), (4, "x " * 6), (None, "X x X x X x x"), (5, "no-break space " * 6), (6, "ä ö " * 4)]
    docs = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in rows], "doc_id long, text string, runs string, n_words int, found string")
    got = {(repr(r["doc_id"]), r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in R.periodic_runs(docs).collect()}
    assert got == {
        ("1", 0, (), ""),
        ("2", 0, (), ""),
        ("3", 0, (), ""),
        ("4", 6, ((0, 6, 1),), "x"),
        ("None", 7, (), "X x X x X x x"),
        ("5", 6, ((0, 6, 1),), "no-break space"),
        ("6", 8, ((0, 8, 2),), "ä ö"),
    }
    assert R.periodic_runs(docs).count() == 8
    assert R.periodic_runs(docs.limit(0)).count() == 0


def test_ties_of_the_longest_run(spark):
    runs = "array(named_struct('start', 9L, 'length', 8L, 'period', 2L), named_struct('start', 3L, 'length', 8L, 'period', 2L), named_struct('start', 3L, 'length', 8L, 'period', 1L), named_struct('start', 0L, 'length', 7L, 'period', 1L))"
    row = spark.range(1).select(F.expr(runs).alias("r")).select(R.longest_run(F.col("r")).alias("x"), R.longest_run(F.slice("r", 1, 0)).alias("none")).first()
    assert tuple(row["x"]) == (3, 8, 1) and row["none"] is None


def test_a_very_long_text_and_long_periods(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(9999)}" for _ in range(70_001)]
    plain = [f"v{i}" for i in range(150_000)]
    words = plain + base * 5 + base[:17] + ["end"] * 9
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(plain))], "doc_id long, text string")
    one, two = sorted(R.periodic_runs(docs).collect())
    assert [tuple(r) for r in one["runs"]] == [(150_000, 5 * 70_001 + 17, 70_001), (150_000 + 5 * 70_001 + 17, 9, 1)]
    assert one["collapsed"] == " ".join(plain + base + ["end"]) and two["runs"] == [] and two["n_words"] == 150_000


def test_slices_give_what_whole_batches_give(spark):
    rng = random.Random(3)
    texts = [" ".join(repetitive(rng)) for _ in range(40)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = {i: (brute_runs((t or "").split()), collapsed((t or "").split(), brute_runs((t or "").split()))) for i, t in enumerate(texts)}
    for size in (64, 1 << 20):
        found = docs.select("doc_id", R.runs_of(F.col("text"), size).alias("f")).select("doc_id", "f.*")
        assert {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect()} == want


def test_the_query_equals_brute_force_on_every_document(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(repetitive(rng) if i % 3 else [f"w{rng.randrange(30)}" for _ in range(rng.randrange(120))])) for i in range(200)]
    rows += [(1000, None), (1001, ""), (12, "a b c"), (13, "  a \n b\t" * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for i, text in rows:
        own, h = (text or "").split(), zlib.crc32(str(i).encode())
        n, g = len(own), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            own = [own[k] if k < a else own[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(own)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        exponent = 1000 * best[1] // best[2] if runs else None
        want.append((i, len(runs), *best, exponent, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(collapsed(own, runs))))
    assert got == sorted(want, key=repr)
    assert sum(1 for r in got if r[1]) > 100
