"""The same results in SQL, where SQL can express them on whole tables."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SIGN_WORDS = r"coalesce(regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

OP1 = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT *, array_to_string(list_transform(flatten(list_transform([1, 11, 21, 31],
    lambda g: list_transform(range(7, -1, -1), lambda i: (CAST('0x' || substr(hex, g, 10) AS BIGINT) >> (5 * i)) & 31))),
    lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v AS INT) + 1, 1)), '') AS payload_digest
  FROM p
),
f AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < first_id THEN first_id END AS refers_to
FROM f
"""

OP2 = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
),
g AS (SELECT k, i, hash(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS h FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (
  SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS p FROM (SELECT k, i, count(*) OVER (PARTITION BY k, h) AS c FROM g) WHERE c > 1) GROUP BY k
),
f AS (
  SELECT k, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(regexp_extract_all(t, '!')) AS BIGINT) AS n_shouts,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (k)
),
m AS (
  SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    1000 * n_symbols // greatest(word_chars, 1) AS symbol_share, 1000 * (len(lines) - len(list_distinct(lines))) // greatest(len(lines), 1) AS line_repeat_share,
    1000 * n_repeat_words // greatest(n_words, 1) AS word_repeat_share, 1000 * n_shouts // greatest(n_words, 1) AS shout_share, 100 * word_chars // greatest(n_words, 1) AS word_length
  FROM f
),
v AS (
  SELECT lang, source, measure, value - value % (1::BIGINT << greatest(length(bin(value)) - 6, 0)) AS bucket
  FROM (SELECT * FROM m WHERE NOT base_failed) UNPIVOT (value FOR measure IN (symbol_share, line_repeat_share, word_repeat_share, shout_share, word_length))
),
o AS (SELECT lang, source, measure, bucket, count(*)::HUGEINT AS n FROM v GROUP BY ALL),
g3 AS (SELECT measure, bucket, sum(n)::HUGEINT AS w FROM o GROUP BY ALL),
t3 AS (SELECT measure, sum(w)::HUGEINT AS t FROM g3 GROUP BY ALL),
g2 AS (
  SELECT lang, measure, bucket, sum(w)::HUGEINT AS w
  FROM (
    SELECT lang, measure, bucket, n * t AS w FROM (SELECT lang, measure, bucket, sum(n)::HUGEINT AS n FROM o GROUP BY ALL) JOIN t3 USING (measure)
    UNION ALL SELECT lang, measure, bucket, 100 * w FROM (SELECT DISTINCT lang, measure FROM o) JOIN g3 USING (measure)
  ) GROUP BY ALL
),
t2 AS (SELECT lang, measure, sum(w)::HUGEINT AS t FROM g2 GROUP BY ALL),
g1 AS (
  SELECT lang, source, measure, bucket, sum(w)::HUGEINT AS w
  FROM (
    SELECT o.lang, o.source, o.measure, o.bucket, o.n * t2.t AS w FROM o JOIN t2 ON o.lang IS NOT DISTINCT FROM t2.lang AND o.measure = t2.measure
    UNION ALL
    SELECT x.lang, x.source, x.measure, g2.bucket, 100 * g2.w
    FROM (SELECT DISTINCT lang, source, measure FROM o) x JOIN g2 ON x.lang IS NOT DISTINCT FROM g2.lang AND x.measure = g2.measure
  ) GROUP BY ALL
),
u AS (
  SELECT *, sum(w) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS upto, sum(w) OVER (PARTITION BY lang, source, measure) AS total FROM g1
),
q AS (
  SELECT lang, source, measure, min(bucket) FILTER (WHERE 4 * upto >= total) AS q1, min(bucket) FILTER (WHERE 4 * upto >= 3 * total) AS q3 FROM u GROUP BY ALL
),
c AS (
  SELECT *, 4 * greatest(q3 - q1, CASE measure WHEN 'symbol_share' THEN 10 WHEN 'line_repeat_share' THEN 100 WHEN 'word_repeat_share' THEN 50 WHEN 'shout_share' THEN 25 ELSE 60 END) AS reach
  FROM q
),
cuts AS (SELECT lang, source, measure, CASE WHEN measure = 'word_length' THEN q1 - reach ELSE -1 END AS low, q3 + reach AS high FROM c),
bad AS (
  SELECT DISTINCT k
  FROM (SELECT k, lang, source, measure, value FROM m UNPIVOT (value FOR measure IN (symbol_share, line_repeat_share, word_repeat_share, shout_share, word_length))) x
  JOIN cuts c ON x.measure = c.measure AND x.lang IS NOT DISTINCT FROM c.lang AND x.source IS NOT DISTINCT FROM c.source
  WHERE value < low OR value > high
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND k NOT IN (SELECT k FROM bad) AS kept FROM m
"""

OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_SIGN_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SIGN_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
),
hits AS (SELECT k, i, n, item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT k, i, n FROM hits)) GROUP BY k),
items AS (
  SELECT k, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
  FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""

OP8 = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce('0' || source, '1') AS key, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
),
s AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key),
w AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY key) - 1) % 3 + 1] AS weight FROM s),
c AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight::DOUBLE AS lvl FROM w),
p AS (
  SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER ahead, 0) AS left_words,
    (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER ahead, 0) AS left_weight
  FROM c WINDOW ahead AS (ORDER BY lvl, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
l AS (SELECT arg_min(left_words::DOUBLE / left_weight::DOUBLE, (lvl, key)) AS x FROM p WHERE left_words::DOUBLE / left_weight::DOUBLE <= lvl),
t AS (SELECT key, source_size, least(cap::DOUBLE, (SELECT x FROM l) * weight) AS target FROM c),
r AS (
  SELECT *, CAST(round(target) AS HUGEINT) AS share, coalesce(sum(CAST(round(target) AS HUGEINT)) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before
  FROM t
),
n AS (SELECT (SELECT sum(source_size) FROM s)::HUGEINT AS words, (SELECT sum(share) FROM r)::HUGEINT AS shares),
m AS (
  SELECT words, shares, (1::HUGEINT << least(floor(log2(words))::INT, greatest(16, ceil(log2(greatest(1.0, words / 1024.0)))::INT))) AS slots FROM n
),
o AS (
  SELECT key, source_size, target, ((before + share) * slots + shares - 1) // shares - (before * slots + shares - 1) // shares AS owned FROM r, m
),
placed AS (
  SELECT k, key, size, sum(size) OVER (PARTITION BY key ORDER BY shuffle, size, k) - size AS place FROM d WHERE size > 0
),
u AS (
  SELECT k, least(greatest((owned * words) // slots - (e * source_size + place), 0), size) AS taken
  FROM placed JOIN o USING (key), m, (SELECT unnest([0, 1, 2]) AS e)
),
g AS (SELECT k, sum(taken) AS taken FROM u GROUP BY k)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM d JOIN t USING (key) LEFT JOIN g USING (k)
"""

OP13 = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
k AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM w LEFT JOIN k USING (doc_id)
),
g AS (SELECT part, good, toxic, map(['A', 'B', 'C', 'D', 'E'], [a, b, c, d, e]) AS fails, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT [p.x, q.x, r.x, s.x, t.x] AS o FROM l p, l q, l r, l s, l t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
),
z AS (SELECT part, n, good, toxic, fails, o, step, o[step] AS own, list_filter(o, lambda x, i: i <= step AND fails[x]) AS hit FROM g, o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, array_to_string(o, '') AS filter_order, own, CAST(step AS INT) AS step, sum(CASE WHEN len(hit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN hit = [own] THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails[own] AND len(hit) > 1 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails[own] AND len(list_filter(map_values(fails), lambda v: v)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN hit = [own] AND good = 1 THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN hit = [own] AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
  FROM z GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""

ORACLES: dict[str, str] = {
    "op1_warc": OP1,
    "op2_quality_rules": OP2,
    "op6_decontaminate": OP6,
    "op8_mixing": OP8,
    "op13_filter_audit": OP13,
}
