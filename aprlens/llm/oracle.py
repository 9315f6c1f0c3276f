"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

from .licenses import PHRASES, SHARE, SPREAD, TEMPLATES, WHOLE

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(nodes: str, node: str) -> str:
    """CTEs over ``edge(a, b)``, both directions in it: the smallest id that each node reaches."""
    return f"""
reach(id, other) AS (
  SELECT {node}, {node} FROM {nodes}
  UNION
  SELECT r.id, e.b FROM reach r JOIN edge e ON e.a = r.other
),
component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""


EMBEDDINGS = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
edge AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.v, y.v) >= 0.93
),
{_components("embeddings", "vec_id")}
SELECT e.vec_id, (SELECT count(*) FROM edge WHERE a = e.vec_id) AS n_links, c.component_id,
  e.vec_id = c.component_id AS kept
FROM embeddings e JOIN component c ON c.id = e.vec_id
"""

SHINGLES = rf"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM word WHERE len(w) > 0)
),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
),
edge AS (
  SELECT a, b FROM shared JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b
  WHERE 100 * shared.n >= 75 * (p.n + q.n - shared.n)
),
{_components("documents", "doc_id")}
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN size ON size.doc_id = d.doc_id JOIN component c ON c.id = d.doc_id
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    f"1 + ((('0x' || substr(hex, {5 * k + 1}, 5))::INTEGER >> {shift}) & 31), 1)"
    for k in range(8)
    for shift in (15, 10, 5, 0)
)

ARCHIVES = f"""
WITH payload AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex FROM pages
),
first AS (SELECT hex, max(page_id) AS keeper FROM payload GROUP BY hex)
SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM payload JOIN first USING (hex)
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


LICENSES = f"""
WITH word AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents
),
phrase(label, p) AS (SELECT label, string_split(p, ' ') FROM (VALUES {_values([(v, k) for k, v in PHRASES.items()])}) x(label, p)),
place AS (
  SELECT doc_id, label, i - 1 AS pos
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM word) JOIN phrase ON w[i:i + len(p) - 1] = p
),
base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
    list(DISTINCT label) AS labels
  FROM place GROUP BY doc_id
),
template AS (
  SELECT *, CASE WHEN len(tokens) < {WHOLE} THEN len(tokens) ELSE ceil({SHARE} * len(tokens) - 1e-9) END AS need,
    (CASE WHEN len(tokens) < {WHOLE} THEN length ELSE ceil({SPREAD} * length) END)::BIGINT AS span
  FROM (SELECT row_number() OVER () AS t, label, list_distinct(string_split(txt, ' ')) AS tokens, len(string_split(txt, ' ')) AS length
    FROM (VALUES {_values(TEMPLATES)}) x(label, txt))
),
-- A text without enough of the words has no such block; in the others every run of span words is counted.
candidate AS (
  SELECT * FROM (SELECT doc_id, w, list_distinct(w) AS once FROM word) x, template
  WHERE len(list_intersect(once, tokens)) >= need
),
block AS (
  SELECT doc_id, t, label, len(tokens) AS size, need, len(list_intersect(list_distinct(w[i:i + span - 1]), tokens)) AS shared
  FROM (SELECT *, unnest(range(1, greatest(len(w) - span + 1, 1) + 1)) AS i FROM candidate)
),
hit AS (SELECT doc_id, label, shared / size AS share FROM block WHERE shared >= need),
added AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(added.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(added.share, 0)::DOUBLE END AS score
FROM word LEFT JOIN base USING (doc_id) LEFT JOIN added USING (doc_id)
"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    return f"""xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"""


# Edits, states and prices of the role grammar. State: the last initial, '' at the start.
CONVERSATIONS = rf"""
WITH RECURSIVE hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("k")} % 20 AS fault
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, range(2) copy(c) WHERE fault <> 0 AND (c = 0 OR fault = 3)
),
ordered AS (
  SELECT *, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(len(role) || ':' || role || text)) AS i,
    left(role, 1) AS initial,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final
  FROM damaged
),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS occurrence FROM ordered),
turns AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair,
    CASE WHEN final = '' THEN 'blank' WHEN occurrence > 1 THEN 'duplicate'
      WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM seen
),
inserted(state, found, price, letters, body) AS (VALUES
  ('', '', 0, '', []::VARCHAR[]), ('', 'u', 2, 'I', ['user:']), ('', 'a', 4, 'II', ['user:', 'assistant:']),
  ('s', 's', 0, '', []), ('s', 'u', 2, 'I', ['user:']), ('s', 'a', 4, 'II', ['user:', 'assistant:']),
  ('u', 'u', 0, '', []), ('u', 'a', 2, 'I', ['assistant:']),
  ('a', 'a', 0, '', []), ('a', 'u', 2, 'I', ['user:'])
),
edit(found, letter, next, price) AS (VALUES
  ('', 'K', 's', 0), ('', 'K', 'u', 0), ('s', 'K', 'u', 0), ('u', 'K', 'a', 0), ('a', 'K', 'u', 0),
  ('', 'R', 'u', 2), ('s', 'R', 'u', 2), ('u', 'R', 'a', 2), ('a', 'R', 'u', 2),
  ('', 'D', '', 3), ('s', 'D', 's', 3), ('u', 'D', 'u', 3), ('a', 'D', 'a', 3)
),
path AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS state, {{'cost': 0, 'audit': '', 'body': []::VARCHAR[]}} AS best FROM turns
  UNION ALL
  SELECT p.conv_id, t.i, e.next, min({{
    'cost': p.best.cost + n.price + e.price + CASE WHEN t.fault = 'truncated' AND e.letter <> 'D' THEN 1 ELSE 0 END,
    'audit': p.best.audit || n.letters || e.letter,
    'body': list_concat(p.best.body, n.body, CASE e.letter WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [t.role || ':' || t.text]
      ELSE [CASE e.next WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || t.text] END)}})
  FROM path p JOIN turns t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i + 1
  JOIN inserted n ON n.state = p.state JOIN edit e ON e.found = n.found
  WHERE e.letter = 'D' OR t.fault NOT IN ('blank', 'duplicate') AND (e.letter = 'R' OR t.initial = e.next)
  GROUP BY p.conv_id, t.i, e.next
),
whole AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id
),
ended AS (
  SELECT w.*, e.best FROM whole w JOIN (
    SELECT p.conv_id, p.i, min({{'cost': p.best.cost + n.price, 'audit': p.best.audit || n.letters,
      'body': list_concat(p.best.body, n.body)}}) AS best
    FROM path p JOIN inserted n ON n.state = p.state WHERE n.found IN ('', 'a') GROUP BY p.conv_id, p.i
  ) e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.n
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.body, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _levels(name: str, tree: str, leaves: str) -> str:
    """CTEs: ``name`` (tree, level, i, n, h), all nodes; ``name_side`` the joined siblings before and after each."""
    return f"""
{name} AS (
  SELECT {tree} AS tree, 0 AS level, i, count(*) OVER (PARTITION BY {tree}) AS n, h FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {name}
  WHERE n > 1 GROUP BY tree, level, i // 3, n
),
{name}_side AS (
  SELECT x.tree, x.level, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS l,
    coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS r
  FROM {name} x JOIN {name} y ON x.tree IS NOT DISTINCT FROM y.tree AND x.level = y.level AND x.i // 3 = y.i // 3
  WHERE x.n > 1 GROUP BY x.tree, x.level, x.i
)"""


MERKLE = f"""
WITH RECURSIVE whole AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, h, tampered
  FROM (
    SELECT doc_id, source, sha256({" || ".join(map(_field, ["doc_id", "source", "lang", "n_chars", "text"]))}) AS h,
      sha256({" || ".join(map(_field, ["doc_id", "source", "lang", "n_chars", "CASE WHEN doc_id IS NOT NULL AND " + _crc32("coalesce(doc_id, 0)::VARCHAR") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"]))}) AS tampered
    FROM documents
  )
),
{_levels("node", "source", "whole")},
sub AS (SELECT tree AS source, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, h, 0 AS one FROM node WHERE n = 1),
{_levels("high", "one", "sub")},
walk AS (
  SELECT source, i AS leaf_at, 0 AS level, i, tampered AS h, '' AS proof FROM whole
  UNION ALL
  SELECT w.source, leaf_at, w.level + 1, w.i // 3, sha256(l || w.h || r), proof || l || r
  FROM walk w JOIN node_side s ON s.tree IS NOT DISTINCT FROM w.source AND s.level = w.level AND s.i = w.i
),
climb AS (
  SELECT w.source, leaf_at, 0 AS level, sub.i, w.h, proof
  FROM walk w JOIN node ON node.tree IS NOT DISTINCT FROM w.source AND node.level = w.level AND node.n = 1
  JOIN sub ON sub.source IS NOT DISTINCT FROM w.source
  UNION ALL
  SELECT w.source, leaf_at, w.level + 1, w.i // 3, sha256(l || w.h || r), proof || l || r
  FROM climb w JOIN high_side s ON s.level = w.level AND s.i = w.i
)
SELECT d.doc_id, d.h AS leaf, sub.h AS subroot, root.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root,
  c.h = root.h AS verified
FROM whole d JOIN sub ON sub.source IS NOT DISTINCT FROM d.source
JOIN (SELECT level, h FROM high WHERE n = 1) root ON true
JOIN climb c ON c.source IS NOT DISTINCT FROM d.source AND c.leaf_at = d.i AND c.level = root.level
"""

ORACLE_SQL = {
    "op1_embedding_near_dedup": EMBEDDINGS,
    "op5_archive_conversion": ARCHIVES,
    "op8_minhash_near_dedup": SHINGLES,
    "op9_license_scan": LICENSES,
    "op11_conversation_repair": CONVERSATIONS,
    "op12_merkle_manifest": MERKLE,
}
