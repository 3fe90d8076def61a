from __future__ import annotations

import random
from itertools import permutations

from pyspark.sql import functions as F

from tallyline.llm import filter_audit as A

SCHEMA, LABELS = "doc_id long, text string, lang string, failed int, n int", "doc_id long, quality int, toxic int, part string"


def failures(docs):
    """Failed filters of every document by the words of the contract."""
    out = []
    for i, text, lang in docs:
        text = text or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
        fails = ""
        if len(words) < 200:
            fails += "A"
        if 100 * len(set(words)) < 50 * len(words):
            fails += "B"
        if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
            fails += "C"
        if any(c in "#$%&*|" for c in text):
            fails += "D"
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs):
            fails += "E"
        out.append((i, lang or "", fails))
    return out


def brute(docs, labels):
    """All orders run filter by filter over the documents."""
    good = {i for i, q, _, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, _ in labels if t == 1 and i is not None}
    facts, rows = failures(docs), {}
    for part in {lang for _, lang, _ in facts}:
        own = [(i, f) for i, lang, f in facts if lang == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                total[x] += len(gone)
                rows[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == x for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), x,
                ]
        for key in [k for k in rows if k[0] == part]:
            rows[key][-1] = total[rows[key][-1]]
    return {(*k, *v) for k, v in rows.items()}


def corpus():
    rng = random.Random(8)
    docs = []
    for i in range(160):
        n = rng.choice([0, 5, 199, 200, 260])
        words = [f"w{rng.randrange(rng.choice([20, 90, 5000]))}" for _ in range(n)]
        if rng.random() < 0.3:
            words[: n // 20] = ["SHOUT"] * (n // 20)
        docs.append((i, " ".join(words) + rng.choice(["", "", "", " #", "|"]), rng.choice(["en", "en", "de", "", None])))
    docs += [(200 + k, docs[k % 7][1], rng.choice(["en", "fr"])) for k in range(60)]
    docs += [(3, docs[3][1], "en"), (3, docs[3][1], "en"), (300, None, "it"), (301, "", "it"), (None, None, "en"), (None, docs[3][1], "xx"), (302, "word " * 90_000, "it")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "p") for i in range(0, 260, 2)] + [(2, 1, 0, "p"), (2, 0, 1, "p"), (None, 1, 1, "p"), (9999, 1, 1, "p")]
    return docs, labels


def test_every_order_equals_brute_force(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], SCHEMA)
    got = A.filter_audit(frame, spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = got.collect()
    want = brute(docs, labels)
    assert len(rows) == len(want) == 600 * len({d[2] or "" for d in docs})
    assert set(map(tuple, rows)) == want


def test_counts_at_the_limits(spark):
    texts = ["w " * 199, " ".join(map(str, range(200))), " ".join(str(k // 2) for k in range(200)), " ".join(str(min(k, 98)) for k in range(200)), "A" * 3 + "é" * 97, "AAAA" + "é" * 96, "a b c", "50&"]
    docs = [(k, t, "x") for k, t in enumerate(texts)]
    got = A.failure_counts(spark.createDataFrame([(*d, 0, 0) for d in docs], SCHEMA), spark.createDataFrame([], LABELS))
    want = {}
    for _, _, fails in failures(docs):
        bits = sum(1 << "ABCDE".index(x) for x in fails)
        want[bits] = want.get(bits, 0) + 1
    assert {r["failed"]: r["rows"] for r in got.where(F.col("rows") > 0).collect()} == want


def test_a_large_group_of_copies_in_few_rows(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lang"))
    counts = {(r["part"], r["failed"]): r["rows"] for r in A.failure_counts(docs, spark.createDataFrame([], LABELS)).collect() if r["rows"]}
    assert counts == {("a", 1): 1, ("a", 17): 2499, ("b", 17): 2500}


def test_potentials_are_the_mean_over_orders(spark):
    rng = random.Random(9)
    for n in (1, 2, 3, 5):
        game = [0] + [rng.randrange(1000) for _ in range((1 << n) - 1)]
        frame = spark.createDataFrame([(game,)], "g array<bigint>").select(A.potentials(F.col("g"), n).alias("p"))
        p, full = frame.first()["p"], (1 << n) - 1
        assert len(p) == 1 << n
        for i in range(n):
            over_orders = 0
            for order in permutations(range(n)):
                before = sum(1 << j for j in order[: order.index(i)])
                over_orders += game[before | 1 << i] - game[before]
            assert p[full] - p[full ^ (1 << i)] == over_orders


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert A.filter_audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None, 0, 0)], SCHEMA)
    rows = A.filter_audit(one, labels).collect()
    assert len(rows) == 600 and {(r["part"], r["removed"] + r["kept"]) for r in rows if r["step"] == 1} == {("", 1)}
