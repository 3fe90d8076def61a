from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyline.llm import queries
from tallyline.llm import sharding as S


def brute_shard(key, weights):
    """The scores of all shards, one by one."""
    hashed = 42 if key is None else xxhash.xxh64_intdigest(str(key).encode(), 42)
    hashed = xxhash.xxh64_intdigest(int(key is None).to_bytes(4, "little"), hashed)
    seed = xxhash.xxh64_intdigest(hashed.to_bytes(8, "little"), 42)
    scores = {}
    for shard, weight in enumerate(weights):
        if weight > 0:
            drawn = xxhash.xxh64_intdigest(shard.to_bytes(8, "little"), seed) >> 11
            scores[shard] = -weight / math.log((drawn + 0.5) * 2.0**-53)
    return max(scores, key=lambda s: (scores[s], -s))


def shards_of(spark, n, weights, extra=()):
    first, second = S.rendezvous(F.col("id"), weights, extra)
    return spark.range(n).select("id", first.alias("a"), second.alias("b")).collect()


def test_shards_equal_brute_force(spark):
    weights = [1.0, 0.5, 0.0, 3.0, 1.0]
    for r in shards_of(spark, 500, weights, [2.0, 0.0]):
        assert r["a"] == brute_shard(r["id"], weights) and r["b"] == brute_shard(r["id"], [*weights, 2.0, 0.0])


def test_shares_follow_the_weights_and_few_records_move(spark):
    weights, n = [1.0, 2.0, 5.0], 40_000
    rows = shards_of(spark, n, weights, [2.0])
    held = Counter(r["a"] for r in rows)
    for shard, weight in enumerate(weights):
        assert abs(held[shard] / n - weight / 8) < 0.01
    moved = [r for r in rows if r["a"] != r["b"]]
    assert {r["b"] for r in moved} == {3} and abs(len(moved) / n - 0.2) < 0.01
    less = {r["id"]: r["a"] for r in shards_of(spark, n, [1.0, 0.0, 5.0])}
    assert all(less[r["id"]] == r["a"] for r in rows if r["a"] != 1)
    heavier = {r["id"]: r["a"] for r in shards_of(spark, n, [1.0, 2.0, 6.0])}
    assert all(heavier[r["id"]] in (r["a"], 2) for r in rows)


def test_weights_that_cannot_be(spark):
    for weights in ([], [0.0], [-1.0, 2.0], [float("inf")], [float("nan"), 1.0]):
        with pytest.raises(ValueError):
            S.rendezvous(F.col("id"), weights)
    assert {r["a"] for r in shards_of(spark, 50, [0.0, 4.0])} == {1}


def corpus():
    pick = random.Random(5)
    rows = [(i, "é" * pick.randrange(40)) for i in range(300)]
    return rows + [(7, rows[7][1])] * 3 + [(7, "other")] * 200 + [(None, "x"), (None, None), (400, None), (401, ""), (402, "long " * 300_000)]


def test_every_row_has_a_gapless_slot(spark):
    docs = spark.createDataFrame([(i, t, 1, "s", 2, 3) for i, t in corpus()], "doc_id long, text string, shard int, slot string, row int, part int")
    got = S.assign(docs, [1.0] * 6, part_bytes=2000).collect()
    size = lambda t: len((t or "").encode()) + 16
    want = sorted((repr(i), size(t), zlib.crc32((t or "").encode()), brute_shard(i, [1.0] * 6), brute_shard(i, [1.0] * 7)) for i, t in corpus())
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == want
    assert {r["grown_shard"] - r["shard"] for r in got if r["grown_shard"] != 6} == {0}
    for shard in range(6):
        rows = sorted((r["slot"], r["part"], r["size"]) for r in got if r["shard"] == shard)
        assert [r[0] for r in rows] == list(range(len(rows)))
        before = 0
        for _, part, size_ in rows:
            assert part == before // 2000
            before += size_
    again = S.assign(docs.repartition(7), [1.0] * 6, part_bytes=2000).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_empty_table_and_shards_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.assign(docs).count() == 0
    one = spark.createDataFrame([("k", None)], "doc_id string, text string")
    assert [tuple(r) for r in S.assign(one, [1.0], ()).collect()] == [("k", 16, 0, 0, 0, 0, 0)]


def test_written_shards_hold_every_row_in_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "s") for i, t in corpus()], "doc_id long, text string, _other string")
    path = f"{tmp_path}/shards"
    S.write_shards(docs, path, [1.0, 2.0], part_bytes=4000)
    back = spark.read.parquet(path)
    assert sorted(map(repr, back.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))
    placed = {(repr(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"]) for r in S.assign(docs, [1.0, 2.0]).collect()}
    assert {(repr(r["doc_id"]), zlib.crc32((r["text"] or "").encode()), r["_shard"], r["_slot"]) for r in back.collect()} == placed
    files = back.select("_shard", "_slot", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).collect()
    by_file = {}
    for r in sorted(files, key=lambda r: r["at"]):
        by_file.setdefault((r["file"], r["_shard"]), []).append(r["_slot"])
    assert all(slots == sorted(slots) for slots in by_file.values()) and len(by_file) >= 2


def test_the_query_is_the_law_of_keys(spark, tmp_path):
    rows = [(i, f"text {i % 9}") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_sharding(spark, str(tmp_path)).collect()
    assert len(got) == 200 and {r["law"] for r in got} == {"key"}
    for r in got:
        assert r["shard"] == brute_shard(r["doc_id"], [1.0] * 40) and r["grown_shard"] == brute_shard(r["doc_id"], [1.0] * 41)
