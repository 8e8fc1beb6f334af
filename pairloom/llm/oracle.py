"""SQL for the operators' queries, where SQL can express them."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The turned hashes: one md5 of a document, and the sixteen turns a source tries.
_MIXING = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS u
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighted AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM totals),
leveled AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0) AS DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighted
  WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
reached AS (
  SELECT *, first_value(level) OVER (ORDER BY CASE WHEN level * weight <= 3 * source_size THEN 0 ELSE 1 END, 3.0::DOUBLE * source_size / weight, level) AS at_level,
    bool_or(level * weight <= 3 * source_size) OVER () AS any_open
  FROM leveled),
targets AS (
  SELECT source, source_size, CASE WHEN any_open THEN least(CAST(3 * source_size AS DOUBLE), at_level * weight) ELSE CAST(3 * source_size AS DOUBLE) END AS target
  FROM reached),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets),
tried AS (
  SELECT s.source, k, abs(sum(s.size * (floor(rate) + CASE WHEN ((u + k * 268435456) % 4294967296) / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)) - any_value(target)) AS off
  FROM sizes s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source, (SELECT unnest(range(16)) AS k) t
  GROUP BY s.source, k),
turned AS (SELECT source, k FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY off, k) AS n FROM tried) x WHERE n = 1)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN ((u + k * 268435456) % 4294967296) / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sizes s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source JOIN turned t ON s.source IS NOT DISTINCT FROM t.source
"""

_PREFERENCE = """
WITH turns AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place, role, text
  FROM conversations WHERE conv_id IS NOT NULL),
met AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.place, b.place) AS place,
    a.pair_id IS NOT NULL AND b.pair_id IS NOT NULL AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS same
  FROM (SELECT * FROM turns WHERE side = 'chosen') a FULL JOIN (SELECT * FROM turns WHERE side = 'rejected') b ON a.pair_id = b.pair_id AND a.place = b.place),
prefix AS (SELECT pair_id, CAST(coalesce(min(CASE WHEN NOT same THEN place END), count(*)) AS BIGINT) AS n_prefix FROM met GROUP BY pair_id),
kept AS (SELECT t.*, n_prefix, '<|' || coalesce(role, '') || '|>' || chr(10) AS header FROM turns t JOIN prefix p ON t.pair_id = p.pair_id WHERE place >= n_prefix OR side = 'chosen'),
shown AS (SELECT *, header || coalesce(text, '') || '<|end|>' || chr(10) AS content, place >= n_prefix AND role IS NOT DISTINCT FROM 'assistant' AS learned FROM kept)
SELECT pair_id, CASE WHEN place < n_prefix THEN 'prompt' ELSE side END AS part, place, content,
  CAST(CASE WHEN learned THEN length(header) ELSE 0 END AS BIGINT) AS mask_start, CAST(CASE WHEN learned THEN length(content) ELSE 0 END AS BIGINT) AS mask_end, n_prefix
FROM shown
"""

_LINES = """
WITH split AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
page_lines AS (SELECT DISTINCT doc_id, source, unnest(lines) AS line FROM split),
counts AS (SELECT source, line, count(*) AS n FROM page_lines WHERE trim(line, ' ') <> '' GROUP BY source, line),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
boiler AS (SELECT c.source, c.line FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE total >= 10 AND n > CAST(0.1 AS DOUBLE) * total),
numbered AS (SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM split),
kept AS (
  SELECT n.doc_id, count(*) AS n_lines, count(b.line) AS n_dropped, coalesce(string_agg(n.line, chr(10) ORDER BY k) FILTER (WHERE b.line IS NULL), '') AS text
  FROM numbered n LEFT JOIN boiler b ON n.source IS NOT DISTINCT FROM b.source AND n.line = b.line GROUP BY n.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL WHEN n_dropped > 0 THEN k.text ELSE d.text END AS text, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

_TOPK = """
WITH parts AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
whole AS (SELECT vec_id, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM parts),
products AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.v * c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.i = c.i WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id GROUP BY q.vec_id, c.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM products) r WHERE rank <= 5
"""

_DECONTAMINATION = rf"""
WITH doc_words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS window_text
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM item_words WHERE len(w) > 0) x),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') AS window_text
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM doc_words, sizes WHERE len(w) >= size) x),
found AS (SELECT d.doc_id, d.k, d.size, i.item_id FROM doc_windows d JOIN item_windows i ON d.size = i.size AND d.window_text = i.window_text),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM found) x GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""

_NEARDUP = rf"""
WITH RECURSIVE doc_words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM doc_words WHERE len(w) > 0) x),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM doc_words d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

#: The table of the crc32, and the crc32 of a list of bytes with it.
_CRC_TABLE = """
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), list_transform(range(8), lambda x: CAST(x AS BIGINT))),
      lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i) b) t"""


def _crc32(codes: str) -> str:
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: xor(c // 256, tab[(xor(c, b) % 256) + 1])), CAST(4294967295 AS BIGINT))"


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, start: str, levels: int) -> str:
    """CTEs {name}0 to {name}{levels} of nodes (owner, idx, h, n), and sib{name}{k} with each node's siblings before and after it."""
    found = [f"{name}0 AS ({start})"]
    for k in range(levels):
        found.append(f"""sib{name}{k} AS (
  SELECT owner, idx, n, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {name}{k} WINDOW w AS (PARTITION BY owner, idx // 16 ORDER BY idx))""")
        found.append(f"""{name}{k + 1} AS (
  SELECT owner, idx // 16 AS idx, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h, (any_value(n) + 15) // 16 AS n
  FROM {name}{k} GROUP BY owner, idx // 16)""")
    return ",\n".join(found)


def _ways(name: str, tree: str, start: str, levels: int) -> str:
    """CTEs {name}0 to {name}{levels}: each leaf's proof and folded node, level by level."""
    found = [f"{name}0 AS ({start})"]
    for k in range(levels):
        found.append(f"""{name}{k + 1} AS (
  SELECT doc_id, source_no, leaf, w.owner, w.idx // 16 AS idx, proof || CASE WHEN n = 1 THEN '' ELSE before || after END AS proof,
    CASE WHEN n = 1 THEN folded ELSE sha256(before || folded || after) END AS folded
  FROM {name}{k} w JOIN sib{tree}{k} s ON s.owner = w.owner AND s.idx = w.idx)""")
    return ",\n".join(found)


_SUBSTRING = r"""
WITH doc_words AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS window_text FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM doc_words WHERE len(w) >= 13) x),
repeated AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY window_text) AS first FROM windows) x WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS i FROM repeated),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM doc_words),
left_over AS (
  SELECT p.doc_id, count(g.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p.i) FILTER (WHERE g.i IS NULL), '') AS kept
  FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc_words d LEFT JOIN left_over l ON d.doc_id = l.doc_id
"""

#: Enough levels for 16 ** 5 rows of a source, and 16 ** 3 sources.
_MERKLE = f"""
WITH crc AS ({_CRC_TABLE}),
leaves AS (
  SELECT doc_id, {_leaf("text")} AS leaf,
    CASE WHEN {_crc32("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(unicode(ch) AS BIGINT))")} % 5 = 0
      THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS shown,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS source_no, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n
  FROM documents, crc),
{_tree("a", "SELECT source_no AS owner, place AS idx, leaf AS h, n FROM leaves", 5)},
{_tree("b", "SELECT 0 AS owner, owner AS idx, h, count(*) OVER () AS n FROM a5", 3)},
{_ways("u", "a", "SELECT doc_id, source_no, leaf, source_no AS owner, place AS idx, '' AS proof, coalesce(shown, leaf) AS folded FROM leaves", 5)},
{_ways("v", "b", "SELECT doc_id, source_no, leaf, 0 AS owner, source_no AS idx, proof, folded FROM u5", 3)}
SELECT doc_id, leaf, a5.h AS subroot, b3.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = b3.h AS verified
FROM v3 JOIN a5 ON a5.owner = source_no, b3
"""

#: Near words by their deletions, not by chunks.
_SPELLING = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) x
  WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (
  SELECT run, c, {_crc32("flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(ch) AS BIGINT) - 64] END))")} AS h
  FROM runs, crc),
words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT c, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed) x
  WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
shorter AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words) x),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word),
best AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS place FROM near),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word AND place = 1),
reach AS (SELECT word, word AS root FROM forms UNION ALL SELECT r.word, f.form FROM reach r JOIN forms f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM forms f JOIN reach r ON r.word = f.word JOIN forms l ON l.word = r.root AND l.form IS NULL
"""

ORACLES: dict[str, str] = {
    "op1_mixing": _MIXING,
    "op2_preference": _PREFERENCE,
    "op3_neardup": _NEARDUP,
    "op4_lines": _LINES,
    "op5_decontamination": _DECONTAMINATION,
    "op9_topk": _TOPK,
    "op11_substring": _SUBSTRING,
    "op12_merkle": _MERKLE,
    "op13_spelling": _SPELLING,
}
