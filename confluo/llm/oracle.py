"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda a, b:
      CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT unnest(range(256))::BIGINT AS i))),
d AS (
  SELECT doc_id, (strlen(coalesce(text, '')) + 16)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS digest,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM documents, crc_table),
k AS (SELECT *, ('0x' || substr(digest, 1, 16))::UBIGINT::HUGEINT AS key FROM d),
jump AS (
  SELECT doc_id, n, key, -1::BIGINT AS b, 0::BIGINT AS j FROM k, (VALUES (40), (41)) s(n)
  UNION ALL
  SELECT doc_id, n, (key * 2862933555777941757 + 1) % 18446744073709551616, j,
    floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE
      / ((((key * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM jump WHERE j < n),
shards AS (SELECT doc_id, max(b) FILTER (n = 40)::INTEGER AS shard, max(b) FILTER (n = 41)::INTEGER AS grown_shard
  FROM jump GROUP BY doc_id)
SELECT k.doc_id, size, text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY substr(md5(digest || ':' || text_crc32), 1, 3), k.doc_id) - 1)::BIGINT AS slot,
  grown_shard
FROM k JOIN shards USING (doc_id)
"""

_OP5 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) END) AS s FROM w),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, m AS component_id
FROM sets JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) ON x = doc_id
"""

_OP6 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

_OP7 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
strings AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s
  FROM (SELECT doc_id, h, unnest(range(n - 99)) AS i FROM d WHERE n >= 100)),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM strings) WHERE k > 1),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (
    SELECT doc_id, i, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (
      SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS cut FROM later))
  GROUP BY doc_id, r),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(piece, '' ORDER BY a) AS pieces, max(b) AS stop FROM (
    SELECT doc_id, a, b, substr(h, 2 * lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) + 1,
      2 * (a - lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a))) AS piece FROM runs JOIN d USING (doc_id))
  GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(pieces, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP10 = f"""
WITH items AS (
  SELECT item_id::VARCHAR AS item, {_WORDS.format(_LOWER.format('text'))} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, list_slice(w, i, i + least(len(w), 10) - 1) AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS.format(_LOWER.format('text'))} AS w FROM documents),
places AS (
  SELECT doc_id, size, i, list_slice(w, i, i + size - 1) AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, p.size, item FROM places p JOIN windows v ON p.g = v.g AND p.size = v.size),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
owners AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN owners USING (doc_id)
"""

def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a string's UTF-8 bytes; reads ``crc_table(t)``."""
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform("
            f"regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)), "
            f"lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))")


_CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda a, b:
      CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT unnest(range(256))::BIGINT AS i)))"""


def _framed(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_framed, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _levels(tree: str, of: str) -> str:
    """All levels of the trees whose first levels are ``of (tree, k, nodes)``."""
    return f"""{tree}(tree, k, nodes) AS (
  SELECT tree, 0, nodes FROM {of}
  UNION ALL
  SELECT tree, k + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], '')))
  FROM {tree} WHERE len(nodes) > 1)"""


def _siblings(place: str) -> str:
    """Left and right siblings at each level, as text with a bar between."""
    at = f"({place} // pow(3, k)::BIGINT)"
    start = f"({at} // 3 * 3)"
    return (f"array_to_string(nodes[{start} + 1:{at}], '') || '|' || array_to_string(nodes[{at} + 2:{start} + 3], '')")


_OP11 = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf,
    {_leaf("CASE WHEN " + _crc32('doc_id::VARCHAR') + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS shown,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM documents, crc_table),
leaves AS (SELECT tree, list(leaf ORDER BY place) AS nodes FROM d GROUP BY tree),
{_levels('lower_levels', 'leaves')},
subroots AS (SELECT tree, nodes[1] AS subroot FROM lower_levels WHERE len(nodes) = 1),
tops AS (SELECT 0 AS tree, list(subroot ORDER BY tree) AS nodes FROM subroots),
{_levels('upper_levels', 'tops')},
root AS (SELECT nodes[1] AS root FROM upper_levels WHERE len(nodes) = 1),
steps AS (
  SELECT doc_id, k, {_siblings('place')} AS s FROM d JOIN lower_levels l ON l.tree = d.tree WHERE len(nodes) > 1
  UNION ALL
  SELECT doc_id, 1000 + k, {_siblings('d.tree')} FROM d, upper_levels u WHERE len(u.nodes) > 1),
paths AS (SELECT doc_id, list(s ORDER BY k) AS path FROM steps GROUP BY doc_id),
folded AS (
  SELECT d.*, coalesce(path, []) AS path, list_reduce(list_prepend(shown, coalesce(path, [])),
    lambda node, s: sha256(split_part(s, '|', 1) || node || split_part(s, '|', 2))) AS folded_root
  FROM d LEFT JOIN paths USING (doc_id))
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM folded JOIN subroots USING (tree), root
"""

_OP12 = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
hashed AS (SELECT r, {_crc32("doc_id || ':' || r")} AS h FROM runs, crc_table WHERE length(r) >= 6),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word FROM hashed),
v AS (SELECT word, count(*) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
gaps AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
shorter AS (SELECT DISTINCT g.word AS x, v.word AS y FROM gaps g JOIN v ON v.word = g.a || g.b),
near AS (
  SELECT x.word, y.word AS w FROM gaps x JOIN gaps y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT x, y FROM shorter UNION ALL SELECT y, x FROM shorter),
best AS (
  SELECT near.word, count(*) AS n_near, min_by(w, (-v.n, w)) AS w, max(v.n) AS m FROM near JOIN v ON v.word = near.w GROUP BY near.word),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN w END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n
  FROM v LEFT JOIN best USING (word)),
chain(word, root) AS (
  SELECT word, word FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.root
FROM forms f JOIN chain c ON c.word = f.word JOIN forms e ON e.word = c.root AND e.form IS NULL
"""

ORACLE: dict[str, str] = {
    "op1_sharding": _OP1,
    "op5_ngram_join": _OP5,
    "op6_exact_dedup": _OP6,
    "op7_suffix_dedup": _OP7,
    "op10_decontamination": _OP10,
    "op11_merkle": _OP11,
    "op12_variants": _OP12,
}
