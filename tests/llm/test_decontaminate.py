from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from tallyline.llm import decontaminate as D


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        own, hit, names = words(text), set(), set()
        for item_id, item in items:
            w = words(item)
            n = min(10, len(w))
            for i in range(len(w) - n + 1) if w else ():
                for j in range(len(own) - n + 1):
                    if own[j : j + n] == w[i : i + n]:
                        hit.update(range(j, j + n))
                        names.add(str(item_id))
        out.append((doc_id, len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def cases():
    pick = random.Random(8)
    vocabulary = [f"w{k}" for k in range(6)] + ["é9", "straße"]
    item = lambda n: " ".join(pick.choice(vocabulary) for _ in range(n))
    items = [(k, item(n)) for k, n in enumerate([30, 14, 10, 9, 4, 2, 1])] + [(10, item(25)), (10, item(12)), (11, ""), (12, None)]
    docs = []
    for k in range(60):
        part = words(items[k % 9][1])
        at = pick.randrange(max(1, len(part) - 9))
        docs.append((k, f"{item(pick.randrange(12))}, {' '.join(part[at : at + pick.randrange(8, 14)]).upper()}! {item(pick.randrange(12))}"))
    return docs + [(3, docs[3][1]), (900, None), (901, ""), (902, "...")], items


def test_matches_brute_force(spark):
    docs, items = cases()
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, pos int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(frame, bench).select("doc_id", "n_words", "n_hit", "n_items", D.items_digest(F.col("item_ids")).alias("d"), "contaminated")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)
    clean = D.clean_documents(frame, bench)
    assert clean.columns == frame.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r[0] for r in brute(docs, items) if not r[-1])
    none = D.contamination(frame, bench.limit(0))
    assert none.count() == len(docs) and none.where("contaminated").count() == 0
    assert D.contamination(frame.limit(0), bench).count() == 0


def test_very_long_text_is_searched_to_its_end(spark):
    passage = " ".join(f"p{k}" for k in range(12))
    long = " ".join(f"filler{k % 977}" for k in range(400_000)) + " " + passage
    docs = spark.createDataFrame([(1, long), (2, passage[:-4])], "doc_id long, text string")
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in D.contamination(docs, bench).collect()}
    assert got == {1: (400_012, 12), 2: (11, 11)}


def test_proximity_finds_terms_in_another_order(spark):
    item = "red green blue cyan black white grey brown pink gold"
    docs = spark.createDataFrame(
        [(1, "x gold pink brown grey white black y cyan blue green z red"), (2, "red something green else"), (3, item)], "doc_id long, text string"
    )
    terms = D.item_terms(spark.createDataFrame([(5, item)], "item_id long, text string"))
    rows = D.postings(docs, D.item_terms(spark.createDataFrame([(k, w) for k, w in enumerate(item.split())], "item_id long, text string")), window=1)
    index = D.inverted_index(rows)
    near = D.proximity_matches(index, terms).join(rows.select("doc", "doc_id"), "doc")
    assert {(r["doc_id"], r["item_id"]) for r in near.collect()} == {(1, 5), (3, 5)}
    exact = D.phrase_matches(index, terms).join(rows.select("doc", "doc_id"), "doc")
    assert [(r["doc_id"], r["start"], r["stop"]) for r in exact.collect()] == [(3, 0, 10)]


def test_proximity_finds_a_match_without_its_rarest_term(spark):
    item = "red green blue cyan black white grey brown pink gold"
    docs = [(1, "x gold pink brown grey white black y cyan blue green z changed"), (2, "only red here"), (3, "pink gold " * 9 + "blue"), (4, None)]
    bench = spark.createDataFrame([(5, item), (6, "")], "item_id long, text string")
    got = D.proximity(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert {r["doc_id"]: (r["n_near"], r["near_items"]) for r in got.collect()} == {1: (1, ["5"]), 2: (0, []), 3: (0, []), 4: (0, [])}


def test_proximity_is_a_registered_query():
    from tallyline.llm.queries import QUERIES

    assert "op6_proximity" in QUERIES and next(n for n in QUERIES if n.startswith("op6_")) == "op6_decontaminate"
