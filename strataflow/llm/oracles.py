"""What the queries return, in SQL over the same tables, where SQL can say it."""

from __future__ import annotations

from strataflow.llm import quality, secrets, sharding

WORDS = r"[^\x20\x09-\x0D]+"

#: The CRC-32 of a text's UTF-8 bytes, by table.
CRC = """
crc_table AS (SELECT list(list_reduce([i] || range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS tab FROM range(256) t(i)),
coded AS (SELECT d.*, coalesce(text, '') AS body, hex(encode(coalesce(text, ''))) AS h FROM documents d),
crcs AS (
  SELECT doc_id, octet_length(encode(body)) + 1 AS size,
    xor(list_reduce([4294967295] || list_transform(range(octet_length(encode(body))), lambda i: ('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2))::BIGINT),
      lambda c, b: xor(c // 256, tab[(xor(c, b) % 256) + 1])), 4294967295) AS text_crc32
  FROM coded, crc_table)
"""


def drawn(shard: int) -> str:
    return f"-ln((('0x' || substr(md5('k' || doc_id || '/{shard}'), 1, 13))::BIGINT + 1.0::DOUBLE) / {float(1 << 52)}::DOUBLE) / 1.0"


OP1 = f"""
WITH {CRC},
draws AS (SELECT *, list_min([{", ".join(f"{{'d': {drawn(i)}, 's': {i}}}" for i in range(16))}]) AS won, {drawn(16)} AS fresh FROM crcs),
placed AS (SELECT doc_id, size, text_crc32, won.s AS shard, CASE WHEN fresh < won.d THEN 16 ELSE won.s END AS grown_shard,
  ('0x' || substr(md5('slot/' || doc_id || '/' || size || '/' || text_crc32), 1, 8))::BIGINT % {sharding.SLOT_BUCKETS} AS bucket FROM draws)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM placed
"""

OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS s FROM w),
sized AS (SELECT doc_id, len(s) AS n, list_sort(s) AS s FROM sets),
classes AS (SELECT s, n, min(doc_id) AS rep FROM sized WHERE n > 0 GROUP BY 1, 2),
shingles AS (SELECT rep, n, unnest(s) AS x FROM classes),
rare AS (SELECT rep, n, x FROM (SELECT rep, n, x, row_number() OVER (PARTITION BY rep ORDER BY df, x) AS k FROM (SELECT *, count(*) OVER (PARTITION BY x) AS df FROM shingles)) WHERE k <= n - ceil(0.8 * n) + 1),
pairs AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM rare a JOIN rare b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (SELECT a, b FROM pairs JOIN classes p ON p.rep = a JOIN classes q ON q.rep = b WHERE 100 * len(list_intersect(p.s, q.s)) >= 80 * (p.n + q.n - len(list_intersect(p.s, q.s)))),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT r.a, e.b FROM reach r JOIN sides e ON e.a = r.b),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY 1)
SELECT d.doc_id, d.n AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, coalesce(r.root, d.doc_id) = d.doc_id AS kept
FROM sized d LEFT JOIN classes c ON c.s = d.s AND d.n > 0 LEFT JOIN roots r ON r.a = c.rep
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
r AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / w AS ratio FROM r),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::BIGINT - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT *, (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) AS top FROM l),
p AS (SELECT source, source_size, coalesce(least(most, w * top), most) AS target FROM t),
k AS (SELECT d.*, ('0x' || substr(md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12))::BIGINT AS key FROM d),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key NULLS FIRST, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END * size + greatest(0, least(size, floor(target)::BIGINT - CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM b JOIN p ON b.source IS NOT DISTINCT FROM p.source
"""

OP7 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP8 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
m AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d, max(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND first <> page_id THEN first END AS refers_to FROM m
"""


def op9() -> str:
    q = lambda x: x.replace("'", "''")
    parts = []
    for kind, (name, pattern) in enumerate((("assign", secrets.ASSIGN), ("access", secrets.ACCESS), ("hex", secrets.HEX), ("markov", secrets.TOKEN))):
        extra = f"regexp_extract_all(body, '{q(pattern)}', 2)" if kind == 0 else f"regexp_extract_all(body, '{q(pattern)}')"
        parts.append(
            f"m{kind} AS (SELECT doc_id, i, m, x, length(g) AS gap FROM (SELECT doc_id, unnest(range(len(regexp_extract_all(body, '{q(pattern)}')))) AS i, "
            f"unnest(regexp_extract_all(body, '{q(pattern)}')) AS m, unnest({extra}) AS x, unnest((regexp_split_to_array(body, '{q(pattern)}'))[1:len(regexp_extract_all(body, '{q(pattern)}'))]) AS g FROM t WHERE regexp_matches(body, '{q(pattern)}'))), "
            f"s{kind} AS (SELECT doc_id, '{name}' AS kind, {kind} AS k, m, x, sum(gap + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM m{kind})"
        )
    size = len(secrets.ALPHABET)
    place = lambda c: f"(strpos('{secrets.ALPHABET}', {c}) - 1)"
    ratio = f"list_sum(list_transform(range(1, length(m)), lambda j: ([{','.join(map(str, secrets.default_table()))}])[{place('substr(m, j, 1)')} * {size} + {place('substr(m, j + 1, 1)')} + 1]))"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
{", ".join(parts)},
base AS (SELECT doc_id, kind, k, (stop - length(m))::BIGINT AS start, stop::BIGINT AS stop FROM (
  SELECT * FROM s0 WHERE length(x) >= {secrets.LEAST_VALUE} UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2)),
found AS (SELECT doc_id, kind, k, (stop - length(m))::BIGINT AS start, stop::BIGINT AS stop FROM s3 WHERE {ratio} > (length(m) - 1) * {secrets.THRESHOLD}),
free AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = f.doc_id AND b.start < f.stop AND f.start < b.stop)),
every AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM free) GROUP BY 1),
counted AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS joined FROM base GROUP BY 1)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(joined, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN counted USING (doc_id) LEFT JOIN every USING (doc_id)
"""


def op10() -> str:
    words = [w.replace("'", "''") for w in quality.COMMON_WORDS]
    common = ", ".join(f"len(list_filter(ws, lambda x: lower(x) = '{w}'))" for w in words)
    gone = lambda pattern: f"(length(body) - length(regexp_replace(body, '{pattern}', '', 'g')))"
    distance = lambda p, q: (
        f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0.0, list_sum(list_transform(list_zip(list_transform({p}, lambda v: v / list_sum({p})::DOUBLE), list_transform({q}, lambda v: v / list_sum({q})::DOUBLE)), "
        "lambda z: (CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END) / 2)))) ELSE 0 END"
    )
    sums = lambda column, n: "[" + ", ".join(f"sum({column}[{i + 1}])" for i in range(n)) + "]"
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
wins AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: [ws[i], ws[i + 1], ws[i + 2]])) AS win FROM t WHERE len(ws) > 2),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1),
inside AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM often) GROUP BY 1),
lines AS (SELECT doc_id, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS ls FROM t),
c AS (SELECT t.doc_id, lang, body, ws, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, {gone("[#*$%&|<>]")} AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(inside.n, 0) AS n_repeat_words FROM t JOIN lines USING (doc_id) LEFT JOIN inside USING (doc_id)),
h AS (SELECT *, [{gone("[a-z]+")}, {gone("[A-Z]+")}, {gone("[0-9]+")}, length(body) - word_chars, n_symbols, {gone("[^\x00-\x7F]+")}] AS six, [{common}] AS common FROM c),
g AS (SELECT *, six || [length(body) - list_sum(six)::BIGINT] AS classes FROM h),
r AS (SELECT lang AS l, {sums("classes", len(quality.CLASSES))} AS rc, {sums("common", len(words))} AS rw FROM g GROUP BY 1),
j AS (SELECT g.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  CASE WHEN n_words >= {quality.LEAST_WORDS} THEN {distance("classes", "rc")} ELSE 0 END AS dc, CASE WHEN list_sum(common) >= {quality.LEAST_COMMON} THEN {distance("common", "rw")} ELSE 0 END AS dw
  FROM g JOIN r ON lang IS NOT DISTINCT FROM l)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND dc <= {quality.MOST_CLASSES} AND dw <= {quality.MOST_COMMON} AS kept FROM j
"""


ORACLES = {"op1_sharding": OP1, "op2_neardup": OP2, "op6_mixing": OP6, "op7_topk": OP7, "op8_warc": OP8, "op9_secrets": op9(), "op10_quality": op10()}
