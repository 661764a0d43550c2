"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from .mixing import BLOCK, MOST_PASSES, ROUNDS, TOTAL_PERCENT

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

NEAR = f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(LOWER)} AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' '] ELSE [] END) AS g FROM d),
    n AS MATERIALIZED (SELECT d.doc_id, count(g) AS n_shingles FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n_shingles + y.n_shingles - c)),
    r(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a),
    m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
    SELECT n.doc_id, n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN m ON n.doc_id = m.doc_id"""

EXACT = f"""
    WITH d AS (SELECT doc_id, {LOWER} AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM d"""

_HASH = "CAST('0x' || substr(md5({}), 1, {}) AS BIGINT)"
_OTHER = "((keys[r + 1] + n - x) % n)"
_BACK = f"""list_reduce(list_prepend({{0}}, range({ROUNDS - 1}, -1, -1)), lambda x, r:
    CASE WHEN ascii(md5(name || '|' || pass || '|' || r || '|' || greatest(x, {_OTHER}))) % 2 = 1 THEN {_OTHER} ELSE x END)"""
_WORD_COUNT = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

#: The words that a pass takes of a block follow from the block's slot: the permutation taken back.
MIXED = f"""
    WITH d AS MATERIALIZED (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS name, CAST({_WORD_COUNT} AS BIGINT) AS size, md5('order|' || doc_id) AS mixed FROM documents),
    p0 AS (SELECT source, name, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source, name),
    p1 AS (SELECT *, [3.0, 1.0, 2.0][(k - 1) % 3 + 1]::DOUBLE AS weight, (source_size * {MOST_PASSES})::DOUBLE AS most FROM p0),
    p2 AS (SELECT *, most / weight AS ratio, sum(source_size) OVER () * {TOTAL_PERCENT} / 100.0::DOUBLE AS total, sum(weight) OVER () AS all_weight FROM p1),
    p3 AS (SELECT *, row_number() OVER w AS place, (total - coalesce(sum(most) OVER b, 0.0)) / (all_weight - coalesce(sum(weight) OVER b, 0.0)) AS level FROM p2
        WINDOW w AS (ORDER BY ratio, source NULLS LAST), b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    p AS MATERIALIZED (SELECT name, source_size, least(most, coalesce((SELECT arg_min(level, place) FROM p3 WHERE level <= ratio) * weight, most)) AS target FROM p3),
    q0 AS (SELECT name, source_size, CAST(ceil(source_size / {BLOCK}.0) AS BIGINT) AS n, v.pass,
            greatest(0, least(source_size, CAST(floor(target) AS BIGINT) - v.pass * source_size)) AS take FROM p, (VALUES (0), (1)) AS v(pass)),
    q1 AS (SELECT *, list_transform(range({ROUNDS}), lambda r: {_HASH.format("name || '|' || pass || '|key|' || r", 15)} % n) AS keys FROM q0 WHERE take > 0),
    q AS MATERIALIZED (SELECT *, {_BACK.format("n - 1")} AS short FROM q1),
    b0 AS (SELECT *, unnest(range(n)) AS block FROM q),
    b1 AS (SELECT *, {_BACK.format("block")} AS slot FROM b0),
    b AS MATERIALIZED (SELECT name, block, least({BLOCK} - CASE WHEN short = slot THEN n * {BLOCK} - source_size ELSE 0 END,
            take - slot * {BLOCK} + CASE WHEN short < slot THEN n * {BLOCK} - source_size ELSE 0 END) AS words FROM b1),
    s AS MATERIALIZED (SELECT *, sum(size) OVER (PARTITION BY name ORDER BY mixed, doc_id) - size AS start FROM d),
    c AS (SELECT s.doc_id, sum(least(start + size, block * {BLOCK} + words) - greatest(start, block * {BLOCK}))::BIGINT AS taken FROM s JOIN b ON s.name = b.name
        AND b.words > 0 AND start + size > block * {BLOCK} AND start < block * {BLOCK} + words AND size > 0 GROUP BY s.doc_id)
    SELECT d.doc_id, d.size, p.source_size, p.target, coalesce(c.taken, 0) AS taken FROM d JOIN p ON d.name = p.name LEFT JOIN c ON d.doc_id = c.doc_id"""

#: Hexadecimal digits to bits, bits in fives to base32.
_BITS = "array_to_string(list_transform(string_split(sha1(h), ''), lambda x: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', x) - 1) + 1, 4)), '')"
WARC = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), b AS MATERIALIZED (SELECT page_id, strlen(h) AS payload_bytes, {_BITS} AS bits FROM p),
    e AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + list_sum(list_transform(range(5), lambda k: CAST(substr(bits, 5 * i + k + 1, 1) AS INTEGER) << (4 - k)))::INTEGER, 1)), '') AS payload_digest FROM b),
    f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM e)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM f"""

REPEATS = """
    WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
    w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS m FROM (SELECT doc_id, x, unnest(range(n - 99)) AS i FROM d WHERE n >= 100) u),
    f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS k FROM w) v WHERE k > 1),
    g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM
        (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS fresh FROM f) y),
    s AS MATERIALIZED (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, span),
    t AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id),
    k AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM (SELECT doc_id, a, b FROM s UNION ALL SELECT doc_id, n, n FROM d) e),
    r AS (SELECT k.doc_id, string_agg(substr(x, CAST(2 * z + 1 AS BIGINT), CAST(2 * (a - z) AS BIGINT)), '' ORDER BY a) AS rest FROM k JOIN d ON k.doc_id = d.doc_id GROUP BY k.doc_id)
    SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(rest)) AS kept_sha256
    FROM d LEFT JOIN t ON d.doc_id = t.doc_id JOIN r ON d.doc_id = r.doc_id"""

#: The base columns of the quality rules; the outlier verdict is not SQL's.
QUALITY_BASE = r"""
    WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
    g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3) u),
    m AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) v WHERE k > 1),
    r AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM m, (VALUES (0), (1), (2)) AS x(o) GROUP BY doc_id),
    b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN r ON d.doc_id = r.doc_id)
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b"""

ORACLES = {"quality_base_statistics": QUALITY_BASE, "op1_minhash_near_dedup": NEAR, "op2_mixing": MIXED, "op4_exact_dedup": EXACT, "op5_warc": WARC, "op8_suffix_dedup": REPEATS}
