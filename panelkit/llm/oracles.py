"""DuckDB SQL for the results of those queries that SQL can tell, over the same tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_WORDS = r"""regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"""

# components: the smallest id that links reach
_REACH = """reach(a, b) AS (
  SELECT id, id FROM nodes
  UNION SELECT r.a, l.v FROM reach r JOIN (SELECT u, v FROM links UNION ALL SELECT v, u FROM links) l ON l.u = r.b)"""

ORACLE["op1_rp_forest"] = f"""
WITH RECURSIVE valid AS (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.id AS u, b.id AS v FROM valid a JOIN valid b ON a.label = b.label AND a.id < b.id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
nodes AS (SELECT vec_id AS id FROM embeddings),
{_REACH},
component AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY a),
degree AS (SELECT id, count(*) AS n FROM (SELECT u AS id FROM links UNION ALL SELECT v FROM links) GROUP BY id)
SELECT c.id AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, c.id = c AS kept
FROM component c LEFT JOIN degree d ON c.id = d.id
"""

ORACLE["op2_minhash_dedup"] = f"""
WITH RECURSIVE w AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents),
runs AS (
  SELECT id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
weights AS (SELECT id, s, count(*) AS n FROM runs GROUP BY id, s),
total AS (SELECT id, sum(n) AS t FROM weights GROUP BY id),
common AS (
  SELECT a.id AS u, b.id AS v, sum(least(a.n, b.n)) AS m FROM weights a JOIN weights b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id),
links AS (
  SELECT u, v FROM common JOIN total x ON x.id = u JOIN total y ON y.id = v WHERE 9 * m >= 4 * (x.t + y.t)),
nodes AS (SELECT doc_id AS id FROM documents),
{_REACH}
SELECT a AS doc_id, min(b) AS class_id, a = min(b) AS kept FROM reach GROUP BY a
"""

_KINDS = (("assign", r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
          ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24), ("owned", "[A-Za-z0-9_-]+", 0, 24))
_FOUND = "\n  UNION ALL ".join(
    f"""SELECT d, src, {k} AS kind, '{name}' AS name, unnest(string_split_regex(t, '{p}')) AS gap,
      unnest(list_append(regexp_extract_all(t, '{p}', 0), '')) AS hit, unnest(list_append(regexp_extract_all(t, '{p}', {g}), '')) AS value,
      unnest(range(len(regexp_extract_all(t, '{p}', 0)) + 1)) AS i, {least} AS least FROM docs"""
    for k, (name, p, g, least) in enumerate(_KINDS))

ORACLE["op5_secret_scan"] = f"""
WITH docs AS (SELECT doc_id AS d, source AS src, coalesce(text, '') AS t FROM documents),
found AS ({_FOUND}),
placed AS (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY d, kind ORDER BY i) AS e FROM found),
spans AS (
  SELECT d, src, kind, name, CAST(e - length(hit) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, sha256(value) AS h, value
  FROM placed WHERE length(value) >= least AND hit <> ''),
apart AS (
  SELECT o.* FROM spans o WHERE kind < 3 OR (
    regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
    AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.kind < 3 AND b.d = o.d AND b.s < o.e AND o.s < b.e))),
held AS (SELECT h, src, count(DISTINCT d) AS n FROM apart GROUP BY h, src),
holders AS (SELECT h, count(*) <= 2 OR 10 * max(n) >= 9 * sum(n) AS live FROM held GROUP BY h),
judged AS (SELECT a.*, live FROM apart a JOIN holders USING (h) WHERE kind < 3 OR live),
lists AS (
  SELECT d, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
         string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS every,
         count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, count(*) FILTER (kind = 3) AS n3,
         count(*) FILTER (live) AS nl, count(*) FILTER (NOT live) AS ne
  FROM judged GROUP BY d)
SELECT docs.d AS doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, coalesce(n3, 0) AS n_owned,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans, coalesce(nl, 0) AS n_live, coalesce(ne, 0) AS n_example
FROM docs LEFT JOIN lists ON docs.d = lists.d
"""

ORACLE["op6_lm_scores"] = f"""
WITH w AS (SELECT doc_id AS d, {_WORDS} AS w FROM documents),
pos AS (SELECT d, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM w),
pair AS (SELECT d, i, x, lag(x) OVER (PARTITION BY d ORDER BY i) AS y FROM pos),
c1 AS (SELECT x, count(*) AS n FROM pos GROUP BY x), o1 AS (SELECT d, x, count(*) AS n FROM pos GROUP BY d, x),
c2 AS (SELECT y, x, count(*) AS n FROM pair WHERE y IS NOT NULL GROUP BY y, x),
o2 AS (SELECT d, y, x, count(*) AS n FROM pair WHERE y IS NOT NULL GROUP BY d, y, x),
rest AS (SELECT d, (SELECT count(*) FROM pos) - len(w) AS r, len(w) AS n FROM w),
each AS (
  SELECT p.d, p.y, r, c1.n - o1.n AS uni, ctx.n - octx.n AS con, c2.n - o2.n AS bi
  FROM pair p JOIN rest ON rest.d = p.d JOIN c1 ON c1.x = p.x JOIN o1 ON o1.d = p.d AND o1.x = p.x
  LEFT JOIN c1 ctx ON ctx.x = p.y LEFT JOIN o1 octx ON octx.d = p.d AND octx.x = p.y
  LEFT JOIN c2 ON c2.y = p.y AND c2.x = p.x LEFT JOIN o2 ON o2.d = p.d AND o2.y = p.y AND o2.x = p.x),
scored AS (
  SELECT d, sum(CASE WHEN bi > 0 THEN ln(bi / con)
    ELSE CASE WHEN y IS NULL THEN 0.0 ELSE ln(0.4) END + CASE WHEN uni > 0 THEN ln(uni / r) ELSE -ln(r + 1) END END) AS s
  FROM each GROUP BY d)
SELECT rest.d AS doc_id, CAST(rest.n AS BIGINT) AS n_words, round(coalesce(s, 0.0), 4) + 0.0 AS score
FROM rest LEFT JOIN scored ON scored.d = rest.d
"""

ORACLE["op9_substring_dedup"] = f"""
WITH w AS (SELECT doc_id AS d, {_WORDS} AS w FROM documents),
pos AS (SELECT d, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM w),
windows AS (SELECT d, i, array_to_string(w[i : i + 49], ' ') AS s
  FROM (SELECT d, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
firsts AS (SELECT s, min(d) AS d FROM windows GROUP BY s),
dup AS (SELECT windows.d, i FROM windows JOIN firsts ON firsts.s = windows.s AND firsts.d < windows.d),
covered AS (
  SELECT pos.d, pos.i, x, coalesce(max(dup.i) OVER (PARTITION BY pos.d ORDER BY pos.i), -50) > pos.i - 50 AS gone
  FROM pos LEFT JOIN dup ON dup.d = pos.d AND dup.i = pos.i),
digest AS (
  SELECT d, count(*) FILTER (gone) AS n, sha256(coalesce(string_agg(x, ' ' ORDER BY i) FILTER (NOT gone), '')) AS h FROM covered GROUP BY d)
SELECT w.d AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, coalesce(h, sha256('')) AS kept_sha256
FROM w LEFT JOIN digest ON digest.d = w.d
"""


def _crc_step(c: int) -> int:
    for _ in range(4):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    return c


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a string's UTF-8 bytes: half a byte at a time, the lower half first."""
    digit = f"(strpos('0123456789ABCDEF', substr(hex(encode({text})), {{}}, 1)) - 1)"
    halves = f"list_transform(range(CAST(length(hex(encode({text}))) AS BIGINT)), lambda k: {digit.format('CAST(k + 2 - 2 * (k % 2) AS BIGINT)')})"
    table = "[" + ", ".join(str(_crc_step(k)) for k in range(16)) + "]"
    return (f"xor(CAST(4294967295 AS BIGINT), list_reduce({halves}, lambda c, x: "
            f"xor(c >> 4, CAST({table}[(xor(c, CAST(x AS BIGINT)) & 15) + 1] AS BIGINT)), CAST(4294967295 AS BIGINT)))")


ORACLE["op11_importance_resampling"] = f"""
WITH texts AS (
  SELECT 0 AS kind, doc_id AS d, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
words AS (
  SELECT kind, d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
each AS (SELECT kind, d, unnest(w) AS x FROM words),
buckets AS (SELECT x, {_crc32('x')} % 10000 AS b FROM (SELECT DISTINCT x FROM each)),
features AS (SELECT kind, d, b FROM each JOIN buckets USING (x)),
held AS (SELECT b, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM features GROUP BY b),
total AS (SELECT CAST(sum(s) AS DOUBLE) AS ss, CAST(sum(t) AS DOUBLE) AS tt FROM held),
gain AS (SELECT b, CAST(floor(1000 * ln(((t + 1.0::DOUBLE) * (ss + 10000)) / ((s + 1.0::DOUBLE) * (tt + 10000)))) AS BIGINT) AS g FROM held, total),
weights AS (SELECT d, CAST(sum(g) AS BIGINT) AS weight FROM features JOIN gain USING (b) WHERE kind = 0 GROUP BY d),
scored AS (
  SELECT words.d, CAST(len(w) AS BIGINT) AS n, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || words.d), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (d) WHERE kind = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, d) AS r, count(*) OVER (PARTITION BY n >= 20) AS held FROM scored)
SELECT d AS doc_id, n AS n_features, weight, score, CASE WHEN n >= 20 AND r <= 10 * held // 100 THEN r END AS rank FROM ranked
"""

ORACLE["op13_periodic_runs"] = f"""
WITH split AS (SELECT doc_id AS d, {_WORDS} AS w FROM documents),
hashed AS (SELECT d, w, len(w) AS n, {_crc32('CAST(d AS VARCHAR)')} AS h FROM split),
aimed AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM hashed),
placed AS (SELECT d, w, n, a, 1 + (n - a) // (3 + g % 8) AS p FROM aimed),
pos AS (
  SELECT d, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS x
  FROM (SELECT *, unnest(range(n)) AS i FROM placed)),
matched AS (
  SELECT a.d, a.i, b.i - a.i AS q FROM pos a JOIN pos b ON a.d = b.d AND a.x = b.x AND b.i > a.i WHERE 4 * (b.i - a.i) <= a.n),
stretches AS (
  SELECT d, q, min(i) AS s, count(*) + q AS l
  FROM (SELECT *, i - row_number() OVER (PARTITION BY d, q ORDER BY i) AS k FROM matched) GROUP BY d, q, k),
long AS (SELECT * FROM stretches WHERE l >= greatest(6, 4 * q)),
runs AS (
  SELECT * FROM long r WHERE NOT EXISTS (SELECT 1 FROM long o WHERE o.d = r.d AND o.q < r.q AND o.s <= r.s AND o.s + o.l >= r.s + r.l)),
listed AS (
  SELECT d, count(*) AS n_runs, sha256(string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q)) AS h FROM runs GROUP BY d),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY d ORDER BY CAST(l AS DOUBLE) / q DESC, s, q) = 1),
gone AS (SELECT DISTINCT d, unnest(range(s + q, s + l)) AS i FROM runs),
collapsed AS (
  SELECT pos.d, sha256(string_agg(x, ' ' ORDER BY pos.i)) AS h FROM pos LEFT JOIN gone ON gone.d = pos.d AND gone.i = pos.i
  WHERE gone.i IS NULL GROUP BY pos.d)
SELECT split.d AS doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period,
       1000 * best.l // best.q AS exponent_milli, coalesce(listed.h, sha256('')) AS runs_sha256, coalesce(collapsed.h, sha256('')) AS collapsed_sha256
FROM split LEFT JOIN listed ON listed.d = split.d LEFT JOIN best ON best.d = split.d LEFT JOIN collapsed ON collapsed.d = split.d
"""
