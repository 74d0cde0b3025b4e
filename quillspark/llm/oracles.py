"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

W = r"[^\x20\x09-\x0D]+"
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = rf"""
WITH RECURSIVE parts AS (
  SELECT page_id, url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UP}', '{LOW}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    translate(regexp_extract(coalesce(url, ''), '(?s)^(.*?)://', 1), '{UP}', '{LOW}') AS scheme,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1) AS query
  FROM pages),
tokens AS (
  SELECT *, list_distinct(['scheme=' || scheme]
    || list_transform(list_filter(string_split(host, '.'), lambda p: p <> ''), lambda p: 'host=' || p)
    || list_transform(list_filter(string_split(path, '/'), lambda p: p <> ''), lambda p: 'path=' || regexp_replace(p, '[0-9]+', '0', 'g'))
    || list_transform(list_filter(string_split(query, '&'), lambda p: p <> ''), lambda p: 'query=' || regexp_extract(p, '(?s)^([^=]*)', 1))) AS tokens
  FROM parts),
quality AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
labelled AS (
  SELECT row_number() OVER () AS r, tokens, quality = 0 AS blocked
  FROM tokens JOIN quality ON page_id = doc_id WHERE quality IS NOT NULL AND url IS NOT NULL),
need AS (SELECT ceil(greatest(0.001 * count(*), 5) - 1e-6) AS need, 1.25::DOUBLE * count(*) FILTER (WHERE blocked) / count(*) AS least FROM labelled),
single AS (SELECT r, token FROM (SELECT r, unnest(tokens) AS token FROM labelled WHERE blocked) WHERE token IN (SELECT token FROM (SELECT unnest(tokens) AS token FROM labelled WHERE blocked) GROUP BY token HAVING count(*) >= (SELECT need FROM need))),
sets AS (
  SELECT r, token AS last, [token] AS tokens FROM single
  UNION ALL SELECT s.r, n.token, list_append(s.tokens, n.token) FROM sets s JOIN single n ON s.r = n.r AND n.token > s.last),
frequent AS (SELECT tokens, count(*) AS hits FROM sets GROUP BY tokens HAVING count(*) >= (SELECT need FROM need)),
rules AS (
  SELECT f.tokens, any_value(hits)::DOUBLE / count(*) AS confidence FROM frequent f JOIN labelled l ON list_has_all(l.tokens, f.tokens)
  GROUP BY f.tokens HAVING any_value(hits)::DOUBLE / count(*) >= (SELECT least FROM need)),
found AS (
  SELECT t.tokens, max(confidence) AS mined_confidence FROM (SELECT DISTINCT list_sort(tokens) AS tokens FROM tokens) t JOIN rules u ON list_has_all(t.tokens, u.tokens)
  GROUP BY t.tokens),
judged AS (
  SELECT page_id, host, path, mined_confidence,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM tokens LEFT JOIN found ON list_sort(tokens.tokens) = found.tokens)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN mined_confidence IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  mined_confidence
FROM judged
"""

OP3 = r"""
WITH lines AS (
  SELECT row_number() OVER () AS r, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
flat AS (
  SELECT r, doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM lines),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM flat),
common AS (SELECT k FROM keyed WHERE k <> '' AND source IS NOT NULL GROUP BY k HAVING count(DISTINCT source) >= 5),
marked AS (SELECT keyed.*, common.k IS NOT NULL AS bad FROM keyed LEFT JOIN common USING (k)),
cleaned AS (
  SELECT r, any_value(doc_id) AS doc_id, count(*) FILTER (WHERE k <> '') AS n_lines, count(*) FILTER (WHERE bad) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT bad), '') AS kept
  FROM marked GROUP BY r)
SELECT doc_id, n_lines, n_removed, length(kept)::BIGINT AS kept_chars, md5(kept) AS kept_md5 FROM cleaned
"""

OP5 = rf"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '{W}') AS ws FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s
  FROM rows),
flat AS (SELECT r, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT a.r AS a, b.r AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM flat a JOIN flat b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c)),
reach AS (SELECT r AS a, r AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM sets s JOIN reach ON s.r = reach.a JOIN sets o ON o.r = reach.b GROUP BY s.r, s.doc_id, s.s
"""

OP8 = rf"""
WITH quality AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
base AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '{W}'))::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || '#11'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
      / CASE q.quality WHEN 0 THEN 0.5 WHEN 1 THEN 2.0 ELSE 1.0 END AS key
  FROM documents d LEFT JOIN quality q ON d.doc_id = q.doc_id),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM base GROUP BY source),
capped AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS ratio FROM sources),
levels AS (
  SELECT *, row_number() OVER w AS nth,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM capped WINDOW w AS (ORDER BY ratio, source NULLS LAST)),
level AS (SELECT coalesce(arg_min(level, nth) FILTER (WHERE level <= ratio), 'inf'::DOUBLE) AS level FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN ratio <= level.level THEN cap ELSE level.level * weight END AS target FROM capped, level),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets),
ordered AS (
  SELECT b.doc_id, b.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
    coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.key, b.doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM base b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source),
counted AS (SELECT *, least(epochs + (2 * before + size <= 2 * rest)::BIGINT, 3) AS times FROM ordered)
SELECT doc_id, size, source_size, target, (times * size)::BIGINT AS taken, times FROM counted
"""

OP9 = """
WITH r AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, payload_bytes, max(page_id) AS kept FROM r WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT r.page_id, r.payload_bytes::BIGINT AS payload_bytes, r.payload_digest,
  CASE WHEN k.kept IS DISTINCT FROM r.page_id AND k.kept IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k.kept IS DISTINCT FROM r.page_id THEN k.kept END AS refers_to
FROM r LEFT JOIN k USING (payload_digest, payload_bytes)
"""


def _merkle_sql(fanout: int = 16, depth: int = 8) -> str:
    """Levels unrolled: depth of them hold fanout ** depth leaves a source."""
    cell = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({cell('doc_id')} || {cell('source')} || {cell('lang')} || {cell('n_chars')} || {cell(text)})"
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord((doc_id::VARCHAR)[i])::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))"
    sql = f"""
WITH rows AS MATERIALIZED (
  SELECT doc_id, source, {leaf('text')} AS leaf, {crc} AS crc,
    CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {leaf(f"translate(text, '{UP}', '{LOW}')")} END AS tampered
  FROM documents),
trees AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, n FROM (SELECT source, count(*) AS n FROM rows GROUP BY source)),
leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, tree, n, leaf AS digest, coalesce(tampered, leaf) AS started,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
  FROM rows JOIN trees ON rows.source IS NOT DISTINCT FROM trees.source),
"""

    # Nodes of a level are (tree, idx, n, digest); trees of the sources first, then the one over their subroots.
    def tower(name: str, start: str) -> str:
        out = f"{name}0 AS MATERIALIZED ({start}),\n"
        for k in range(depth):
            out += f"{name}{k + 1} AS MATERIALIZED (SELECT tree, idx // {fanout} AS idx, (max(n) + {fanout - 1}) // {fanout} AS n, sha256(string_agg(digest, '' ORDER BY idx)) AS digest FROM {name}{k} WHERE n > 1 GROUP BY tree, idx // {fanout}),\n"
        return out + f"{name}_root AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT tree, digest FROM {name}{k} WHERE n = 1" for k in range(depth + 1)) + "),\n"

    sql += tower("s", "SELECT tree, idx, n, digest FROM leaves")
    sql += tower("u", "SELECT 0 AS tree, tree AS idx, (SELECT count(*) FROM trees) AS n, digest FROM s_root")
    sql += "w0 AS (SELECT r, doc_id, tree, n, digest AS leaf, idx, '' AS proof, started AS folded FROM leaves),\n"

    def climb(name: str, level: str, tree: str, below: str) -> str:
        return f"""{name} AS MATERIALIZED (
  SELECT w.r, any_value(w.doc_id) AS doc_id, any_value(w.tree) AS tree, any_value((w.n + {fanout - 1}) // {fanout}) AS n, any_value(w.leaf) AS leaf, any_value(w.idx // {fanout}) AS idx,
    any_value(w.proof) || coalesce(string_agg(c.digest, '' ORDER BY c.idx) FILTER (WHERE c.idx <> w.idx), '') AS proof,
    sha256(string_agg(CASE WHEN c.idx = w.idx THEN w.folded ELSE c.digest END, '' ORDER BY c.idx)) AS folded
  FROM {below} w JOIN {level} c ON c.tree = {tree} AND c.idx // {fanout} = w.idx // {fanout} WHERE w.n > 1 GROUP BY w.r
  UNION ALL SELECT r, doc_id, tree, n, leaf, idx, proof, folded FROM {below} WHERE n = 1),
"""
    for k in range(depth):
        sql += climb(f"w{k + 1}", f"s{k}", "w.tree", f"w{k}")
    sql += f"v0 AS (SELECT r, doc_id, tree, (SELECT count(*) FROM trees) AS n, leaf, tree AS idx, proof, folded FROM w{depth}),\n"
    for k in range(depth):
        sql += climb(f"v{k + 1}", f"u{k}", "0", f"v{k}")
    return sql + f"""walked AS (SELECT * FROM v{depth})
SELECT doc_id, leaf, s.digest AS subroot, u.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = u.digest AS verified
FROM walked JOIN s_root s ON s.tree = walked.tree CROSS JOIN u_root u
"""


OP11 = _merkle_sql()

OP12 = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UP}', '{LOW}') AS text FROM documents),
found AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY lang, source),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(t.total, 0) + 2 * l.v) AS p,
    1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM cells WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 10
"""

ORACLE_SQL = {
    "op1_url_filter": OP1,
    "op3_line_dedup": OP3,
    "op5_jaccard_join": OP5,
    "op8_mixing": OP8,
    "op9_warc": OP9,
    "op11_merkle_manifest": OP11,
    "op12_source_divergence": OP12,
}
