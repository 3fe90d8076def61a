from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tallyline.llm import quality_rules as Q


def counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_counts_match_brute_force(spark):
    pick = random.Random(9)
    rows = ["", None, " \n\t", "a b c d e f g h i j", "a a a a a a a", "x\n\nx\r\n x\nx", "é# <b>\x0bö"]
    rows += ["".join(pick.choice(["a", "b", " ", " ", "\n", "#"]) for _ in range(pick.randrange(200))) for _ in range(60)]
    rows += [" ".join(str(pick.randrange(40)) for _ in range(3000)) + " 1 2 3 4 5 6 1 2 3 4 5 6"]
    docs = spark.createDataFrame([(i, t, None if i % 7 == 0 else "en", "s", 1) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, kept int")
    got = Q.quality_verdicts(docs, prior_rows=5)
    found = {r["doc_id"]: tuple(r)[1:] for r in got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert found == {i: counts(t) for i, t in enumerate(rows)}
    assert got.where("kept and base_failed").count() == 0
    assert Q.quality_verdicts(docs.limit(0)).count() == 0


def test_thresholds_adapt_to_the_group(spark):
    pick = random.Random(1)
    prose = lambda: " ".join(pick.choice("one three seven eleven fifteen words here".split()) + str(pick.randrange(10**6)) for _ in range(80))
    marked = lambda share: " ".join(w + ("#" * 3 if pick.random() < share else "") for w in prose().split())
    rows = [("en", "plain", prose()) for _ in range(300)] + [("en", "code", marked(0.5)) for _ in range(300)]
    rows += [("en", "plain", marked(0.5)), ("en", "code", marked(0.5)), ("xx", "tiny", prose()), (None, None, prose())]
    docs = spark.createDataFrame([(i, t, lang, s) for i, (lang, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    rejected = {r["doc_id"] for r in Q.quality_verdicts(docs).where("not kept").collect()}
    assert rejected == {600}


def test_sketches_merge(spark):
    values = spark.range(5000).select(F.col("id"), Q.bucket(F.col("id")).alias("b")).collect()
    assert all(0 <= r["id"] - r["b"] <= r["id"] / 32 for r in values) and all(r["b"] == r["id"] for r in values if r["id"] < 64)
    rows = spark.range(1000).selectExpr("'en' lang", "if(id % 2 = 0, 'a', 'b') source", "false base_failed", *[f"id as {m.name}" for m in Q.MEASURES])
    merged = Q.sketches(rows).groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    whole = Q.sketches(rows.withColumn("source", F.lit("a"))).select("measure", "bucket", "n")
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))


def brute_thresholds(rows, prior):
    """Quartiles of every group by weighing single values: a language leans on all rows, a source on its language."""
    bucket = lambda v: v - v % (1 << max(len(bin(v)) - 2 - 6, 0))
    spread = lambda values: Counter(map(bucket, values))
    every = spread(v for _, _, v in rows)
    out = {}
    for lang in {r[0] for r in rows}:
        own = spread(v for x, _, v in rows if x == lang)
        total = sum(every.values())
        of_lang = Counter({b: own[b] * total + prior * every[b] for b in every})
        for source in {r[1] for r in rows if r[0] == lang}:
            own = spread(v for x, y, v in rows if (x, y) == (lang, source))
            total = sum(of_lang.values())
            pooled = {b: own[b] * total + prior * of_lang[b] for b in of_lang}
            whole = sum(pooled.values())
            quartile = lambda q: next(b for b in sorted(pooled) if 4 * sum(w for c, w in pooled.items() if c <= b) >= q * whole)  # noqa: B023, E731
            out[lang, source] = (quartile(1), quartile(3))
    return out


def test_small_groups_lean_on_larger_ones_by_their_size(spark):
    pick = random.Random(5)
    sizes = [("en", "a", 400, 0), ("en", "b", 30, 900), ("en", None, 3, 900), ("de", "a", 60, 500), (None, "a", 1, 70), (None, None, 9, 2000)]
    rows = [(lang, source, pick.randrange(200) + base) for lang, source, n, base in sizes for _ in range(n)]
    frame = spark.createDataFrame(rows, "lang string, source string, v long").withColumn("base_failed", F.lit(False))
    measures = (Q.Measure("v", True, True, 1),)
    for prior in (1, 10, 100, 5000):
        cuts = {r["group"]: (r["v_low"], r["v_high"]) for r in Q.thresholds(Q.sketches(frame, measures), measures, prior_rows=prior, reach=2).collect()}
        want = brute_thresholds(rows, prior)
        named = frame.select("lang", "source", Q._group_key(F.col("lang"), F.col("source")).alias("g")).distinct().collect()
        assert len(named) == len(cuts) == len(want)
        for r in named:
            q1, q3 = want[r["lang"], r["source"]]
            assert cuts[r["g"]] == (q1 - 2 * max(q3 - q1, 1), q3 + 2 * max(q3 - q1, 1))
    own = {(lang, source) for lang, source, *_ in sizes}
    assert len({brute_thresholds(rows, 1)[g] for g in own}) == len(own)
