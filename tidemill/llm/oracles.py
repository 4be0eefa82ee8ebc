"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_HEAD = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?"""


def _found(kind: int, name: str, pattern: str, keep: str) -> str:
    return f"""
 SELECT row, {kind} AS kind, '{name}' AS name, s AS start, s + length(m) AS "end" FROM (
  SELECT row, m, i, sum(length(g)) OVER w + sum(length(m)) OVER w - length(m) AS s FROM (
   SELECT row, unnest(list_slice(string_split_regex(text, '{pattern}'), 1, len(ms))) AS g, unnest(ms) AS m, generate_subscripts(ms, 1) AS i
   FROM (SELECT row, text, regexp_extract_all(text, '{pattern}') AS ms FROM d) WHERE len(ms) > 0)
  WINDOW w AS (PARTITION BY row ORDER BY i ROWS UNBOUNDED PRECEDING))
 WHERE {keep}"""


def _secrets() -> str:
    found = {
        "base": " UNION ALL ".join([
            _found(0, "assign", _HEAD + "[A-Za-z0-9+/_.=-]+", f"length(regexp_replace(m, '^{_HEAD}', '')) >= 8"),
            _found(1, "access", "AKIA[A-Z0-9]+", "length(m) >= 16"),
            _found(2, "hex", "[0-9a-f]+", "length(m) >= 32"),
        ]),
        "weak": " UNION ALL ".join([
            _found(3, "identifier", r"(?:client_id|access_id|user_id|account)\x20*[:=]\x20*[A-Za-z0-9._@-]{4,}", "true"),
            _found(4, "secret", "[A-Za-z0-9+/]{40,}", "length(m) = 40 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')"),
            _found(5, "endpoint", "https?://[A-Za-z0-9.-]+", "true"),
        ]),
    }
    near = lambda kinds: f"""EXISTS (SELECT 1 FROM parts p WHERE p.row = w.row AND p.kind IN ({kinds}) AND p.start <= w."end" + 256 AND w.start <= p."end" + 256)"""
    text = lambda where: f"""coalesce(string_agg(name || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, kind, "end") {where}, '')"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
base AS ({found["base"]}),
loose AS ({found["weak"]}),
weak AS (SELECT * FROM loose w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = w.row AND b.start < w."end" AND w.start < b."end")),
parts AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
linked AS (SELECT * FROM weak w WHERE CASE kind WHEN 3 THEN {near("0, 2, 4")} WHEN 4 THEN {near("1, 3")} ELSE {near("1, 3")} AND {near("0, 2, 4")} END),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM linked)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
 sha256({text("FILTER (kind < 3)")}) AS base_sha256, {text("")} AS spans
FROM d LEFT JOIN spans USING (row) GROUP BY row, doc_id
"""


_MIX = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  md5(coalesce(doc_id::VARCHAR, 'null') || ':mix') AS hkey FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS cap FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
f AS (SELECT *, sum(source_size) OVER () AS total,
  coalesce(sum(cap) OVER o, 0) AS full_, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open_
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((total - full_) / open_) FILTER ((total - full_) / open_ <= cap / weight) AS level FROM f),
t AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM f, l),
b AS (SELECT *, round(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t)
SELECT doc_id, size, source_size, target,
 (epochs * size + greatest(0, least(size, budget - epochs * source_size
   - coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY hkey, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""


_WINDOWS = r"""
WITH low AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT row, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
i AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id::VARCHAR AS item_id,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
dw AS (SELECT row, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT row, w, n, unnest(range(1, greatest(1, len(w) - n + 2))) AS k FROM d, (SELECT DISTINCT n FROM iw))),
h AS (SELECT row, k, n, item_id FROM dw JOIN iw USING (n, g)),
hit AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(k, k + n)) AS p FROM h) GROUP BY row),
it AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT row, item_id FROM h) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN it USING (row)
"""

_B32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {at}, 5))::BIGINT >> {shift}) & 31)::INT + 1, 1)"
_ARCHIVE = f"""
SELECT page_id, n AS payload_bytes, {" || ".join(_B32.format(at=5 * g + 1, shift=k) for g in range(8) for k in (15, 10, 5, 0))} AS payload_digest,
 CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM (SELECT page_id, strlen(p)::BIGINT AS n, sha1(p) AS h, min(page_id) OVER (PARTITION BY p) AS first
  FROM (SELECT page_id, coalesce(html, '') AS p FROM pages))
"""


def _sharding(shards: int, seed: int, rounds: int = 6) -> str:
    """The permutation of row numbers; CRC-32 by its table, which is made by rule."""
    keys, x = [], (seed * 2654435761 + 97) & 0xFFFFFFFF
    for _ in range(rounds):
        x = (x * 1664525 + 1013904223) & 0xFFFFFFFF
        keys.append(x)
    step = "SELECT row, n, h, pos >> h AS l, pos & ((1 << h) - 1) AS r FROM {}"
    sql = step.format("walk WHERE pos >= n OR fresh")
    for k in keys:
        a = f"((r + {k}) & 4294967295)"
        b = f"((xor({a}, {a} >> 16) * 73244475) & 4294967295)"
        sql = f"SELECT row, n, h, r AS l, xor(l, xor(c, c >> 16) & ((1 << h) - 1)) AS r FROM (SELECT *, (xor(b, b >> 13) * 73244475) & 4294967295 AS c FROM (SELECT *, {b} AS b FROM ({sql})))"
    bit = "list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, {})"
    return f"""
WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, {bit.format("i")} AS c FROM range(256) r(i))),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, xor(list_reduce(list_transform(range(strlen(coalesce(text, ''))), lambda i: ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i + 1, 2))::BIGINT),
  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM documents, t),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row, count(*) OVER () AS n FROM d),
walk AS (SELECT row, n, (greatest(2, length(ltrim(bin(greatest(n, 1) - 1), '0'))) + 1) // 2 AS h, row AS pos, true AS fresh FROM numbered
 UNION ALL SELECT row, n, h, (l << h) | r, false FROM ({sql}))
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (pos % {shards})::INT AS shard, pos // {shards} AS slot, NULL::INT AS grown_shard, d.row AS row_number
FROM numbered d JOIN walk w ON d.row = w.row AND NOT w.fresh AND w.pos < w.n
"""


_REPEATS = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT row, i, md5(substr(h, 2 * i + 1, 400)) AS g FROM (SELECT row, h, unnest(range(greatest(0, n - 199))) AS i FROM d)),
s AS (SELECT row, i FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
r AS (SELECT row, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY row ORDER BY i) AS run FROM (SELECT *, (i > coalesce(lag(i) OVER (PARTITION BY row ORDER BY i), -300) + 200)::INT AS new FROM s)) GROUP BY row, run),
k AS (SELECT row, b AS x, coalesce(lead(a) OVER (PARTITION BY row ORDER BY a), 1099511627776) AS y FROM (SELECT row, a, b FROM r UNION ALL SELECT row, -1, 0 FROM d)),
kept AS (SELECT row, string_agg(substr(h, 2 * x + 1, 2 * (least(y, n) - x)), '' ORDER BY x) AS h FROM k JOIN d USING (row) WHERE x < least(y, n) GROUP BY row),
gone AS (SELECT row, sum(b - a)::BIGINT AS removed, count(*) AS spans FROM r GROUP BY row)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (row) LEFT JOIN gone USING (row)
"""

_GROUPS = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT row, g FROM (SELECT row, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT row, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT row, count(*) AS n FROM s GROUP BY row),
p AS (SELECT a.row AS a, b.row AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.row < b.row GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.row = a JOIN n y ON y.row = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(row, to_) AS (SELECT row, row FROM d UNION SELECT reach.row, e.b FROM reach JOIN e ON e.a = reach.to_)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(g.low, d.doc_id) AS component_id FROM d LEFT JOIN n USING (row) JOIN (SELECT reach.row, min(t.doc_id) AS low FROM reach JOIN d t ON t.row = reach.to_ GROUP BY 1) g USING (row)
"""

ORACLES: dict[str, str] = {
    "op1_feistel_sharding": _sharding(24, 20),
    "op2_suffix_array_dedup": _REPEATS,
    "op4_linked_secrets": _secrets(),
    "op5_weighted_mix": _MIX,
    "op6_warc_archives": _ARCHIVE,
    "op7_partition_jaccard": _GROUPS,
    "op9_benchmark_windows": _WINDOWS,
}
