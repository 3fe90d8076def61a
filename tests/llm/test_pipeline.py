from __future__ import annotations

import random

import corpus_pipeline as P
from __spark_entry__ import oracle_sql, queries
from test_simhash import plain_fingerprint


def test_registration():
    names = queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(oracle_sql()) <= set(names)


def corpus():
    pick = random.Random(33)
    words = [f"{a}{b}{c}" for a in "tr st pl br gl".split() for b in "ing and est ol um".split() for c in ["", "er", "ly", "ness"]]
    prose = lambda n: ". ".join(" ".join(pick.choice(words) for _ in range(10)).capitalize() for _ in range(n)) + "."
    clean = [(k, prose(12)) for k in range(200)]
    junk = [(1000 + k, " ".join(w + "$$$" for w in prose(9).split())) for k in range(20)]
    copies = [(2000 + k, clean[k][1]) for k in range(5)] + [(2100 + k, clean[k][1].replace(clean[k][1].split()[40], "changed", 1)) for k in range(5, 10)]
    item = prose(3)
    leaks = [(3000 + k, prose(6) + " " + item + " " + prose(6)) for k in range(5)]
    secret = [(4000, prose(12) + " token = 0123456789abcdef0123456789abcdef")]
    return clean, junk, copies, leaks, secret, item


def test_stages(spark, tmp_path):
    clean, junk, copies, leaks, secret, item = corpus()
    rows = [(i, t, "en", f"src{i % 3}" if i % 11 else None, len(t), 7) for i, t in [*clean, *junk, *copies, *leaks, *secret]]
    rows += [(5000, None, None, None, None, 7), (5001, "", "en", "src1", 0, 7), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, taken int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf, kept = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        kept = P.materialize(stage(spark, kept, sf), name)
        seen[name] = [r["doc_id"] for r in kept.select("doc_id").collect()]
        if name != P.STAGES[-1][0]:
            assert kept.columns == docs.columns
    ids = lambda part: {i for i, _ in part}
    assert not ids(junk) & set(seen["quality"]) and len(ids(clean) & set(seen["quality"])) >= 0.98 * len(clean)
    # Fingerprints of three-word shingles: exact copies go, and near copies where at most three bits differ.
    close = [i for i, t in copies if bin(plain_fingerprint(t) ^ plain_fingerprint(clean[i % 100][1])).count("1") <= 3]
    assert len(close) >= 5 and not set(close) & set(seen["near_dedup"]) and len(seen["near_dedup"]) == len(set(seen["near_dedup"]))
    assert set(seen["near_dedup"]) >= ids(clean) & set(seen["quality"])
    assert not ids(leaks) & set(seen["decontamination"]) and ids(clean) & set(seen["quality"]) <= set(seen["decontamination"])
    assert seen["secrets"] and sorted(seen["secrets"]) == sorted(seen["decontamination"])
    last = kept.where("doc_id = 4000").first()
    assert last is None or "0123456789abcdef" not in last["text"]
    assert kept.columns == [*docs.columns, "size", "source_size", "target", "_taken"] and kept.where("_taken <= 0 or _taken > 3 * size").count() == 0
    again = P.run(spark, sf)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, kept.collect()))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "a b c d e f g h i j k")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
