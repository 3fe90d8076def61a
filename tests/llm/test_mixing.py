from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallyline.llm import mixing as M


def targets(sizes):
    """Shares by weight; what is over three times a source goes to the others, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, out, free = float(sum(sizes.values())), {}, set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    return out


def corpus():
    pick = random.Random(6)
    rows = [(k, " ".join(["w"] * pick.randrange(400)), pick.choice(["a", "b", "ä", None, "c", "c", "c", "c"])) for k in range(300)]
    return rows + [(300, None, "d"), (301, "", "d"), (302, " \t\n", "e"), (5, rows[5][1], rows[5][2]), (None, "x y", "a")]


def test_targets_and_taken_words(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, size int")
    got = M.mix(docs).collect()
    assert sorted((repr(r["doc_id"]), r["size"]) for r in got) == sorted((repr(i), len((t or "").split())) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    wanted, taken = targets(sizes), {}
    by_source = {i: s for i, _, s in rows}
    for r in got:
        source = by_source[r["doc_id"]]
        assert abs(r["target"] - wanted[source]) < 1e-6 and r["source_size"] == sizes[source]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] = taken.get(source, 0) + r["taken"]
    for source, words in taken.items():
        assert abs(words - wanted[source]) <= 3
    assert sorted(map(repr, got)) == sorted(map(repr, M.mix(docs).collect()))
    carried = M.mix(docs, carry=True)
    assert carried.select("doc.*").columns == docs.columns


def test_any_prefix_of_the_schedule_is_near_the_shares(spark):
    docs = spark.createDataFrame([(k, "w " * 50, "abc"[k % 3]) for k in range(300)], "doc_id long, text string, source string")
    rows = M.sized_rows(docs)
    plan = M.schedule(rows, M.source_targets(rows)).join(rows.select("row", "key"), "row").orderBy("slot").collect()
    total = sum(r["word_to"] - r["word_from"] for r in plan)
    assert total == 15_000
    for part in (0.1, 0.33, 0.7):
        words = {"0a": 0, "0b": 0, "0c": 0}
        for r in plan[: int(len(plan) * part)]:
            words[r["key"]] += r["word_to"] - r["word_from"]
        share = words["0a"] / sum(words.values())
        assert abs(share - 5 / 8) < 0.02
    starts = sorted((r["row"], r["epoch"], r["word_from"]) for r in plan)
    assert len(starts) == len(set(starts))


def test_empty_tables_and_texts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(docs).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert sorted((r["doc_id"], r["size"], r["taken"], r["target"]) for r in M.mix(blank).collect()) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]
    one = spark.createDataFrame([(1, "only", "a")], "doc_id long, text string, source string")
    assert [(r["size"], r["taken"]) for r in M.mix(one).collect()] == [(1, 1)]
    assert one.select(M.word_count(F.lit("\x0ba\x0c b\r\n")).alias("n")).first()["n"] == 2
