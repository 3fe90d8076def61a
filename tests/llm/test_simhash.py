from __future__ import annotations

import random
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from tallyline.llm import simhash as S


def plain_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts(n=60, seed=1):
    pick = random.Random(seed)
    made = [" ".join(pick.choice("alpha beta gamma delta EPSILON zeta éta".split()) + str(pick.randrange(9)) for _ in range(pick.randrange(1, 60))) for _ in range(n)]
    return made + made[:9] + [t + " x" for t in made[:9]] + ["", None, " \t", "one", "Two words"]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_and_components_match_brute_force(spark):
    rows = list(enumerate(texts())) + [(3, texts()[3]), (None, texts()[4])]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, fp string")
    got = S.near_duplicates(docs).select("doc_id", S.as_hex(F.col("fp")).alias("h"), "component_id").collect()
    prints = {}
    for i, t in rows:
        prints.setdefault(plain_fingerprint(t), []).append(i)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in combinations(prints, 2):
        if bin(a ^ b).count("1") <= 3:
            root[find(a)] = find(b)
    least = {}
    for p, ids in prints.items():
        least.setdefault(find(p), []).extend(i for i in ids if i is not None)
    expected = sorted((repr(i), f"{plain_fingerprint(t):016x}", min(least[find(plain_fingerprint(t))])) for i, t in rows)
    assert sorted((repr(r["doc_id"]), r["h"], r["component_id"]) for r in got) == expected
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_pairs_match_brute_force_and_crowds_lose_no_connection(spark):
    pick = random.Random(2)
    centres = [pick.getrandbits(64) for _ in range(5)]
    values = sorted({c ^ sum(1 << b for b in pick.sample(range(64), pick.randrange(4))) for c in centres for _ in range(40)} | {0, (1 << 64) - 1, 1 << 63})
    prints = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    brute = {tuple(sorted((signed(a), signed(b)))) for a, b in combinations(values, 2) if bin(a ^ b).count("1") <= 3}
    assert {tuple(r) for r in S.close_pairs(prints).collect()} == brute

    def components(links):
        return sorted(sorted(v) for v in group(links).values())

    def group(links):
        root = {n: n for link in links for n in link}

        def find(n):
            while root[n] != n:
                n = root[n]
            return n

        for a, b in links:
            root[find(a)] = find(b)
        out = {}
        for n in root:
            out.setdefault(find(n), []).append(n)
        return out

    crowded = {tuple(r) for r in S.close_pairs(prints, crowd=2).collect()}
    assert crowded <= brute and components(crowded) == components(brute)


def test_one_row_of_every_component_stays(spark):
    pick, base = random.Random(4), [t or "" for t in texts(40, 7)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.upper()) for i, t in enumerate(base[:20])] + [(3, base[3]), (None, base[5]), (None, "one of its kind, without id"), (500, None), (501, "")]
    long = [f"w{pick.randrange(5000)}" for _ in range(20_000)]
    rows += [(600, " ".join(long)), (601, " ".join([*long[:9000], "changed", *long[9001:]])), (602, " ".join(reversed(long)))]
    pick.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, fp int, row int, place int")
    kept = S.deduplicate(docs)
    assert kept.columns == docs.columns
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if bin(prints[a] ^ prints[b]).count("1") <= 3 and root[a] != root[b]:
                root = [root[a] if r == root[b] else r for r in root]
    order = lambda i: (i is None, i)
    expected = sorted((min((rows[k][0] for k in range(len(rows)) if root[k] == r), key=order) for r in set(root)), key=order)
    got = sorted((r["doc_id"] for r in kept.collect()), key=order)
    assert got == expected and 601 not in got and {600, 602} <= set(got)
    assert S.deduplicate(docs.limit(0)).count() == 0
