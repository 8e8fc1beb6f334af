"""SQL counterparts of the registered queries, in DuckDB's dialect.

Written relationally and independently of the operators: tokens and positions are
rows, contexts are compared pair by pair, patterns are numbered by a plain window.
"""

from __future__ import annotations

from pairloom.workload.corpus import REPORTS, SENTENCE_ID, SHAPE_TAG, TAGGED, sentence_expression

# The published settings, and the numbers of level-1 buckets.
_WINDOW_SIZE, _MAX_DISTANCE, _SIMILARITY, _MATCH, _LEAST_SIZE, _CONFIDENCE = 5, 5, 0.4, 0.6, 5, 0.9
_BUCKETS, _SIDE_BUCKETS = 16, 4
_ENTITY = "'<([A-Z]+)>(.+?)</([A-Z]+)>'"
# Opening marks, a word of letters, its full stop, closing marks.
_DOTTED = r"""'^([("\[''])*([A-Za-z]+(?:[.''-][A-Za-z]+)*)(\.?)[,;:)\]"'']*$'"""


def _vector(window: str) -> str:
    count = f"len(list_filter({window}, lambda x: x = t))"
    return (
        f"list_transform(list_sort(list_distinct({window})), "
        f"lambda t: {{'token': t, 'weight': CAST({count} AS DOUBLE) / len({window})}})"
    )


def _shown(vector: str, name: str | None = None) -> str:
    item = "x.token || '=' || CAST(CAST(floor(x.weight * 1000000 + 0.3) AS BIGINT) AS VARCHAR)"
    return f"array_to_string(list_transform({vector}, lambda x: {item}), ' ') AS {name or vector}"


def _found(centroid: str) -> str:
    return f"coalesce(list_filter({centroid}, lambda y: y.token = x.token)[1].weight, 0.0)"


def _sum(vector: str, term: str) -> str:
    return f"coalesce(list_sum(list_transform({vector}, lambda x: {term})), 0.0)"


def _part(p: str, c: str, damped: bool) -> str:
    dot = _sum(p, f"x.weight * {_found(c)}")
    own, norm = _sum(p, "x.weight * x.weight"), _sum(c, "x.weight * x.weight")
    if damped:
        norm = f"({norm} + {_sum(p, f'{_found(c)} * {_found(c)}')})"
    return f"CASE WHEN len({p}) = 0 AND len({c}) = 0 THEN 0.0 ELSE {dot} / nullif(sqrt({norm}) * sqrt({own}), 0) END"


def _similarity(p: str, c: str) -> str:
    parts = " + ".join(_part(f"{p}.{v}", f"{c}.{v}", v == "rc") for v in ("lc", "mc", "rc"))
    return f"CASE WHEN {p}.left_tag = {c}.left_tag THEN ({parts}) / 3 ELSE 0.0 END"


_SIGNATURE = (
    "CASE WHEN len(lc) > 0 THEN 4 ELSE 0 END + CASE WHEN len(mc) > 0 THEN 2 ELSE 0 END + CASE WHEN len(rc) > 0 THEN 1 ELSE 0 END"
)
# Left, middle and right context; the right one scores at most the square root of a half against itself.
_SELF = {s: ((s >> 2 & 1) + (s >> 1 & 1) + (s & 1) * 0.5**0.5) / 3 for s in range(8)}
_JOINABLE = ", ".join(str(s) for s in range(8) if _SELF[s] > _SIMILARITY)

_SHAPE = """CASE WHEN regexp_matches(word, '^[a-z]+$') THEN 'lower-' || right(word, 2) WHEN regexp_matches(word, '^[0-9]+([.,][0-9]+)*$') THEN 'number'
    WHEN regexp_matches(word, '^[^A-Za-z0-9]+$') THEN 'mark' WHEN regexp_matches(word, '^[A-Z][a-z]+$') THEN 'capital' WHEN regexp_matches(word, '^[A-Z]+$') THEN 'upper' ELSE 'other' END"""

CTES = {
    "sentences": f"""
        SELECT {SENTENCE_ID} AS sentence_id, {sentence_expression()} AS sentence
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN part ON l_partkey = p_partkey""",
    "plain": f"SELECT sentence_id, regexp_replace(sentence, {_ENTITY}, '\\2', 'g') AS sentence FROM sentences",
    "truth": """
        SELECT s_name AS org, n_name AS loc, r_name AS region, s_acctbal
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "seeds": """
        SELECT org, loc FROM (SELECT *, row_number() OVER (
            PARTITION BY region ORDER BY s_acctbal DESC, org DESC, loc DESC) AS place FROM truth) WHERE place = 1""",
    "filtered": """
        SELECT * FROM sentences WHERE contains(sentence, 'ORGANIZATION') AND contains(sentence, 'LOCATION')""",
    "org_rows": """
        SELECT sentence_id, unnest(regexp_extract_all(sentence, '<ORGANIZATION>(.+?)</ORGANIZATION>', 1)) AS org, sentence
        FROM filtered""",
    "chunks": f"""
        SELECT sentence_id, unnest(range(len(c))) AS chunk_no, unnest(c) AS chunk FROM (
            SELECT sentence_id, string_split(regexp_replace(sentence, {_ENTITY},
                chr(1) || '\\1' || chr(2) || '\\2' || chr(1), 'g'), chr(1)) AS c FROM filtered)""",
    "tokens": """
        SELECT sentence_id, CAST(row_number() OVER (PARTITION BY sentence_id ORDER BY chunk_no, word_no) - 1 AS INTEGER) AS pos,
               text, tag FROM (
            SELECT sentence_id, chunk_no, 0 AS word_no, split_part(chunk, chr(2), 2) AS text, split_part(chunk, chr(2), 1) AS tag
            FROM chunks WHERE chunk_no % 2 = 1
            UNION ALL
            SELECT sentence_id, chunk_no, word_no, text, '' AS tag FROM (
                SELECT sentence_id, chunk_no, unnest(range(len(w))) AS word_no, unnest(w) AS text
                FROM (SELECT sentence_id, chunk_no, string_split(chunk, ' ') AS w FROM chunks WHERE chunk_no % 2 = 0))
            WHERE text <> '')""",
    "pairs": f"""
        SELECT o.sentence_id, o.pos AS a, l.pos AS b, o.text AS org, l.text AS loc,
               CASE WHEN o.pos < l.pos THEN 'ORGANIZATION' ELSE 'LOCATION' END AS left_tag
        FROM tokens o JOIN tokens l ON o.sentence_id = l.sentence_id AND abs(o.pos - l.pos) <= {_MAX_DISTANCE}
        WHERE o.tag = 'ORGANIZATION' AND l.tag = 'LOCATION'""",
    "texts": "SELECT sentence_id, list(text ORDER BY pos) AS t FROM tokens GROUP BY sentence_id",
    "org_counts": "SELECT sentence_id, org, count(*) AS occurrences FROM org_rows GROUP BY sentence_id, org",
    "windows": f"""
        SELECT p.*, coalesce(occurrences, 0) AS occurrences,
               t[greatest(least(a, b) - {_WINDOW_SIZE}, 0) + 1 : least(a, b)] AS lw,
               t[least(a, b) + 2 : greatest(a, b)] AS mw,
               t[greatest(a, b) + 2 : greatest(a, b) + 1 + {_WINDOW_SIZE}] AS rw
        FROM pairs p JOIN texts USING (sentence_id) LEFT JOIN org_counts c ON p.sentence_id = c.sentence_id AND p.org = c.org""",
    "segments": f"""
        SELECT sentence_id, a, b, org, loc, left_tag, occurrences,
               {_vector('lw')} AS lc, {_vector('mw')} AS mc, {_vector('rw')} AS rc FROM windows""",
    "mentions": """
        SELECT org, loc, left_tag, list_sort(lw) AS lw, list_sort(mw) AS mw, list_sort(rw) AS rw,
               count(*) AS n, CAST(sum(occurrences) AS BIGINT) AS weight
        FROM windows GROUP BY ALL""",
    "contexts": f"""
        SELECT *, {_SIGNATURE} AS signature FROM (
            SELECT DISTINCT left_tag, lw, mw, rw, {_vector('lw')} AS lc, {_vector('mw')} AS mc, {_vector('rw')} AS rc FROM mentions)""",
    "documents_in": """
        SELECT CAST(doc_id AS INTEGER) AS "index", replace(text, chr(10), '\\n') AS raw_text FROM documents""",
    "document_lines": """
        SELECT concat_ws(chr(9), CAST(doc_id AS VARCHAR), lang, source, CAST(n_chars AS VARCHAR), replace(text, chr(10), '\\n')) AS line
        FROM documents""",
    "conversation_lines": """
        SELECT concat_ws(chr(9), CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), role, CAST(turn AS VARCHAR),
               replace(text, chr(10), '\\n')) AS line FROM conversations""",
    "articles": """
        SELECT CAST(f[1] AS BIGINT) AS "index", f[5] AS text
        FROM (SELECT string_split(line, chr(9)) AS f FROM document_lines) WHERE f[5] <> ''""",
    "clean": """SELECT "index", replace(text, '\\n', ' ') AS text FROM articles""",
    "spaced": """
        SELECT "index", trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
            '[ \\t\\n\\r\\f]+', ' ', 'g'), '([!?;()"\\[\\]])', ' \\1 ', 'g'), '([.,:]+)( |\\z)', ' \\1 ', 'g'), ' +', ' ', 'g')) AS text
        FROM clean""",
    "document_sentences": """
        SELECT "index", CAST(pos AS INTEGER) AS pos, sentence FROM (
            SELECT "index", unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM (
                SELECT "index", list_filter(string_split(regexp_replace(text,
                    '((?: [.!?]+)+(?: [)\\]])*) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM spaced))""",
    "reports": f"""
        SELECT row_number() OVER () AS id, CAST(l_orderkey AS BIGINT) AS "index", {sentence_expression(REPORTS)} AS text
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN part ON l_partkey = p_partkey""",
    "report_words": f"""
        SELECT *, lower(regexp_extract(w, {_DOTTED}, 2)) AS word, regexp_extract(w, {_DOTTED}, 3) = '.' AS stop FROM (
            SELECT id, "index", unnest(range(len(ws))) AS place, unnest(ws) AS w FROM (SELECT id, "index", string_split(text, ' ') AS ws FROM reports))""",
    "report_counts": "SELECT word, count(*) AS n, CAST(sum(CAST(stop AS INTEGER)) AS BIGINT) AS k FROM report_words WHERE word <> '' GROUP BY word",
    "abbreviated": """
        SELECT word, n, k AS n_stops, 2 * (k * ln(0.99) + (n - k) * ln(0.01) - k * ln(share) - CASE WHEN n = k THEN 0 ELSE (n - k) * ln(1 - share) END)
            * exp(-letters) * (length(word) - letters + 1) * pow(letters, k - n) AS score
        FROM (SELECT *, CAST(length(replace(word, '.', '')) AS DOUBLE) AS letters FROM report_counts WHERE k > 0), (SELECT sum(k) / sum(n) AS share FROM report_counts)""",
    "report_texts": """
        SELECT id, "index", string_agg(CASE WHEN stop AND word IN (SELECT word FROM abbreviated WHERE score >= 0.3)
            THEN regexp_replace(w, '\\.([,;:)\\]"'']*)$', chr(2) || '\\1') ELSE w END, ' ' ORDER BY place) AS text FROM report_words GROUP BY "index", id""",
    "report_spaced": """
        SELECT "index", trim(regexp_replace(regexp_replace(text, '([.,:]+)( |\\z)', ' \\1 ', 'g'), ' +', ' ', 'g')) AS text FROM report_texts""",
    "taught": f"""
        SELECT id, unnest(range(len(xs))) AS pos, regexp_extract(unnest(xs), '^(.+)_([^_]+)$', 1) AS word, regexp_extract(unnest(xs), '^(.+)_([^_]+)$', 2) AS tag FROM (
            SELECT row_number() OVER () AS id, string_split({sentence_expression(TAGGED)}, ' ') AS xs
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN part ON l_partkey = p_partkey)""",
    "taught_words": "SELECT word, tag, count(*) AS n FROM taught GROUP BY word, tag",
    "taught_tags": "SELECT tag, sum(n) AS n, count(*) AS kinds FROM taught_words GROUP BY tag",
    "taught_steps": """
        SELECT before, tag, count(*) AS n FROM (
            SELECT coalesce(lag(tag) OVER (PARTITION BY id ORDER BY pos), '') AS before, tag FROM taught
            UNION ALL SELECT arg_max(tag, pos), '' FROM taught GROUP BY id)
        GROUP BY before, tag""",
    "step_costs": """
        SELECT before, tag, CAST(round(-ln((n + 1) / (sum(n) OVER (PARTITION BY before) + count(*) OVER (PARTITION BY before))) * 1000000) AS BIGINT) AS cost
        FROM (SELECT b.tag AS before, t.tag AS tag, coalesce(n, 0) AS n
              FROM (SELECT tag FROM taught_tags UNION ALL SELECT '') b CROSS JOIN (SELECT tag FROM taught_tags UNION ALL SELECT '') t
              LEFT JOIN taught_steps s ON s.before = b.tag AND s.tag = t.tag)""",
    "shaped": f"""
        SELECT *, CASE WHEN shape LIKE 'lower-%' THEN 'lower' ELSE shape END AS coarse FROM (
            SELECT DISTINCT word, {_SHAPE} AS shape FROM (SELECT word FROM taught_words UNION SELECT w FROM plain_tokens))""",
    "new_words": """
        SELECT shape, tag, CAST(count(*) AS BIGINT) AS m FROM taught_words JOIN shaped USING (word) GROUP BY ALL
        UNION ALL SELECT coarse, tag, count(*) FROM taught_words JOIN shaped USING (word) WHERE coarse = 'lower' GROUP BY ALL
        UNION ALL SELECT '', tag, kinds FROM taught_tags""",
    "word_costs": """
        SELECT word, tag, CAST(round(-ln(c / (t.n + t.kinds)) * 1000000) AS BIGINT) AS cost FROM (
            SELECT word, tag, n AS c FROM taught_words UNION ALL
            SELECT word, tag, m FROM (
                SELECT word, CASE WHEN shape IN (SELECT shape FROM new_words) THEN shape WHEN coarse IN (SELECT shape FROM new_words) THEN coarse ELSE '' END AS shape
                FROM shaped WHERE word NOT IN (SELECT word FROM taught_words)) JOIN new_words USING (shape)) JOIN taught_tags t USING (tag)""",
    "words": """
        SELECT "index" || '-' || pos AS sentence_id, CAST(word_no AS INTEGER) AS pos, w FROM (
            SELECT "index", pos, unnest(range(len(ws))) AS word_no, unnest(ws) AS w
            FROM (SELECT "index", pos, string_split(sentence, ' ') AS ws FROM document_sentences))""",
    "items": f"SELECT lower(w) || '_' || {SHAPE_TAG.format(like='regexp_matches')} AS item FROM words",
    "pairs_of_words": "SELECT split_part(item, '_', 1) AS word, split_part(item, '_', 2) AS tag FROM items",
    "counts": "SELECT word, tag, count(*) AS n FROM pairs_of_words GROUP BY word, tag",
    "top_tags": """
        SELECT word, tag, n FROM (
            SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, tag) AS place FROM counts) WHERE place = 1""",
    "tag_numbers": "SELECT word, count(DISTINCT tag) AS n FROM pairs_of_words GROUP BY word",
    "gazetteer": "SELECT s_name AS name, 'ORGANIZATION' AS tag FROM supplier UNION ALL SELECT n_name, 'LOCATION' FROM nation",
    "plain_tokens": """
        SELECT sentence_id, unnest(range(len(ws))) AS pos, unnest(ws) AS w
        FROM (SELECT sentence_id, string_split(sentence, ' ') AS ws FROM plain)""",
    "retagged": """
        SELECT sentence_id, string_agg(CASE WHEN tag IS NULL THEN w ELSE '<' || tag || '>' || w || '</' || tag || '>' END, ' ' ORDER BY pos) AS sentence
        FROM plain_tokens LEFT JOIN gazetteer ON w = name GROUP BY sentence_id""",
    "product_tokens": """
        SELECT *, lead(w) OVER one AS later, lag(w) OVER one AS before FROM plain_tokens WINDOW one AS (PARTITION BY sentence_id ORDER BY pos)""",
    "clustered": "SELECT *, loc || '|' || left_tag AS cluster_id FROM segments",
    "sums": """
        SELECT cluster_id, part, x.token AS token, sum(x.weight) AS weight FROM (
            SELECT cluster_id, 'lc' AS part, unnest(lc) AS x FROM clustered UNION ALL
            SELECT cluster_id, 'mc', unnest(mc) FROM clustered UNION ALL
            SELECT cluster_id, 'rc', unnest(rc) FROM clustered) GROUP BY ALL""",
    "shares": """
        SELECT cluster_id, part, list({'token': token, 'weight': share} ORDER BY token) AS vector FROM (
            SELECT *, weight / sum(weight) OVER (PARTITION BY cluster_id, part) AS share FROM sums) GROUP BY ALL""",
    "centers": """
        SELECT c.cluster_id, c.loc, c.left_tag, coalesce(l.vector, []) AS lc, coalesce(m.vector, []) AS mc, coalesce(r.vector, []) AS rc
        FROM (SELECT DISTINCT cluster_id, loc, left_tag FROM clustered) c
        LEFT JOIN shares l ON c.cluster_id = l.cluster_id AND l.part = 'lc'
        LEFT JOIN shares m ON c.cluster_id = m.cluster_id AND m.part = 'mc'
        LEFT JOIN shares r ON c.cluster_id = r.cluster_id AND r.part = 'rc'""",
}


def _added(left: str, right: str, times: str) -> str:
    """Sum of a vector and ``times`` another."""
    both = f"list_concat({left}, list_transform({right}, lambda z: {{'token': z.token, 'weight': z.weight * {times}}}))"
    return _summed(both)


def _summed(parts: str) -> str:
    """The key-wise sum of the items of a list."""
    total = f"list_sum(list_transform(list_filter({parts}, lambda y: y.token = t), lambda y: y.weight))"
    return f"list_transform(list_sort(list_distinct(list_transform({parts}, lambda z: z.token))), lambda t: {{'token': t, 'weight': {total}}})"


def _scaled(vector: str) -> str:
    return f"list_transform({vector}, lambda z: {{'token': z.token, 'weight': z.weight / list_sum(list_transform({vector}, lambda y: y.weight))}})"


def _score(p: str, c: str) -> str:
    """Similarity of contexts with the same tag and signature."""
    return "(" + " + ".join(_part(f"{p}.{v}", f"{c}.{v}", v == "rc") for v in ("lc", "mc", "rc")) + ") / 3"


def _dealt(buckets: int, *parts: str) -> str:
    tokens = " || '|' || ".join(f"array_to_string(list_transform({p}, lambda z: z.token), ' ')" for p in parts)
    return f"CAST('0x' || substr(md5({tokens}), 1, 8) AS BIGINT) % {buckets}"


_VECTOR = "STRUCT(token VARCHAR, weight DOUBLE)[]"
_CLUSTER = f"STRUCT(lc {_VECTOR}, mc {_VECTOR}, rc {_VECTOR}, size BIGINT)"


def _two_levels(k: str) -> dict[str, str]:
    """The clusters of the raw patterns of a round: one pass over each bucket, a step per distinct context, then rounds of merges."""
    grown = "{" + ", ".join(f"'{v}': {_added(f'c.{v}', f'i.{v}', 'i.weight')}" for v in ("lc", "mc", "rc")) + ", 'size': c.size + i.weight}"
    times = lambda v: f"list_transform(i.{v}, lambda z: {{'token': z.token, 'weight': z.weight * i.weight}})"
    opened = "{" + ", ".join(f"'{v}': {times(v)}" for v in ("lc", "mc", "rc")) + ", 'size': i.weight}"
    group = "left_tag, signature, bucket"
    return {
        f"items{k}": f"""
            SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY weight DESC, lc, mc, rc) AS turn FROM (
                SELECT *, {_SIGNATURE} AS signature,
                       {_dealt(_BUCKETS, 'mc')} * {_SIDE_BUCKETS} + {_dealt(_SIDE_BUCKETS, 'lc', 'rc')} AS bucket FROM raw{k})
            WHERE signature IN ({_JOINABLE})""",
        f"pass{k}": f"""
            SELECT DISTINCT {group}, CAST(0 AS BIGINT) AS turn, CAST([] AS {_CLUSTER}[]) AS clusters,
                   CAST(NULL AS DOUBLE) AS best, CAST(NULL AS BIGINT) AS place, CAST([] AS {_CLUSTER}[]) AS before FROM items{k}
            UNION ALL
            SELECT {group}, turn,
                   CASE WHEN best > {_SIMILARITY} THEN list_transform(clusters, lambda c, j: CASE WHEN j = place THEN {grown} ELSE c END)
                        ELSE list_append(clusters, {opened}) END AS clusters,
                   best, place, clusters AS before
            FROM (SELECT *, list_max(scores) AS best, CAST(list_position(scores, list_max(scores)) AS BIGINT) AS place FROM (
                SELECT item.left_tag, item.signature, item.bucket, item.turn, p.clusters, list_transform(p.clusters, lambda c: {_score('item', 'c')}) AS scores,
                       {{'lc': item.lc, 'mc': item.mc, 'rc': item.rc, 'weight': item.weight}} AS i
                FROM pass{k} p JOIN items{k} item
                    ON p.left_tag = item.left_tag AND p.signature = item.signature AND p.bucket = item.bucket AND item.turn = p.turn + 1) q)""",
        f"centroid{k}": f"""
            SELECT left_tag, signature, {', '.join(f"{_scaled(f'c.{v}')} AS {v}" for v in ('lc', 'mc', 'rc'))}, c.size AS size, CAST(1 AS BIGINT) AS copies FROM (
                SELECT {group}, unnest(arg_max(clusters, turn)) AS c FROM pass{k} GROUP BY {group})
            UNION ALL
            SELECT left_tag, signature, lc, mc, rc, 1, weight FROM (SELECT *, {_SIGNATURE} AS signature FROM raw{k})
            WHERE signature NOT IN ({_JOINABLE})""",
        f"merge{k}": f"""
            SELECT CAST(0 AS BIGINT) AS turn, row_number() OVER (ORDER BY size DESC, left_tag, lc, mc, rc) AS id,
                   left_tag, signature, lc, mc, rc, CAST(size AS BIGINT) AS size
            FROM centroid{k} WHERE signature IN ({_JOINABLE})
            UNION ALL (
            WITH links AS (
                SELECT * FROM (
                    SELECT p.id AS later, c.id AS earlier, c.size AS earlier_size, {_score('p', 'c')} AS s
                    FROM merge{k} p JOIN merge{k} c ON p.left_tag = c.left_tag AND p.signature = c.signature
                        AND (c.size > p.size OR (c.size = p.size AND c.id < p.id)))
                WHERE s > {_SIMILARITY}),
            moves AS (
                SELECT later, earlier FROM (
                    SELECT *, row_number() OVER (PARTITION BY later ORDER BY s DESC, earlier_size DESC, earlier) AS place
                    FROM links WHERE earlier NOT IN (SELECT later FROM links)) WHERE place = 1)
            SELECT any_value(turn) + 1, id, any_value(left_tag), any_value(signature),
                   {', '.join(_summed(f'flatten(list({v}))') for v in ('lc', 'mc', 'rc'))}, CAST(sum(size) AS BIGINT)
            FROM (SELECT turn, coalesce(earlier, id) AS id, left_tag, signature, lc, mc, rc, size FROM merge{k} LEFT JOIN moves ON later = id)
            WHERE (SELECT count(*) FROM moves) > 0 GROUP BY id)""",
        f"patterns{k}": f"""
            SELECT CAST(row_number() OVER (ORDER BY size DESC, left_tag, lc, mc, rc) - 1 AS INTEGER) AS pattern_id, * FROM (
                SELECT left_tag, signature, {', '.join(f"{_scaled(v)} AS {v}" for v in ('lc', 'mc', 'rc'))}, size
                FROM merge{k} WHERE turn = (SELECT max(turn) FROM merge{k}) AND size > {_LEAST_SIZE})""",
    }


def _exact(k: str) -> dict[str, str]:
    """Clusters of equal contexts only."""
    return {
        f"level{k}": f"""
            SELECT *, CASE WHEN signature IN ({_JOINABLE}) THEN weight ELSE 1 END AS size,
                   CASE WHEN signature IN ({_JOINABLE}) THEN 1 ELSE weight END AS copies
            FROM (SELECT *, {_SIGNATURE} AS signature FROM raw{k})""",
        f"patterns{k}": f"""
            SELECT CAST(row_number() OVER (ORDER BY size DESC, left_tag, lc, mc, rc) - 1 AS INTEGER) AS pattern_id, *
            FROM level{k} WHERE size > {_LEAST_SIZE}""",
    }


def _round(k: str, seeds: str, two_levels: bool = False) -> dict[str, str]:
    """The tables of one round, named with the suffix ``k``."""
    return {
        f"raw{k}": f"""
            SELECT left_tag, lc, mc, rc, CAST(sum(weight) AS BIGINT) AS weight FROM (
                SELECT left_tag, weight, {_vector('lw')} AS lc, {_vector('mw')} AS mc, {_vector('rw')} AS rc
                FROM mentions JOIN {seeds} USING (org, loc) WHERE weight > 0) GROUP BY ALL""",
        **(_two_levels(k) if two_levels else _exact(k)),
        f"scores{k}": f"""
            SELECT c.left_tag, c.lw, c.mw, c.rw, pattern_id, {_similarity('c', 'p')} AS similarity
            FROM contexts c JOIN patterns{k} p ON c.left_tag = p.left_tag AND c.signature = p.signature""",
        f"matches{k}": f"SELECT * FROM scores{k} WHERE similarity >= {_MATCH}",
        f"matched{k}": f"""
            SELECT m.org, m.loc, m.left_tag, m.lw, m.mw, m.rw, m.n, pattern_id, similarity
            FROM mentions m JOIN matches{k} x ON m.left_tag = x.left_tag AND m.lw = x.lw AND m.mw = x.mw AND m.rw = x.rw""",
        f"support{k}": f"""
            SELECT pattern_id, CAST(sum(CASE WHEN m.loc = s.loc THEN n ELSE 0 END) AS BIGINT) AS positives,
                   CAST(sum(CASE WHEN m.loc = s.loc THEN 0 ELSE n END) AS BIGINT) AS negatives
            FROM matched{k} m JOIN {seeds} s ON m.org = s.org GROUP BY pattern_id""",
        f"confidence{k}": f"""
            SELECT *, CAST(positives AS DOUBLE) / (positives + negatives) AS confidence FROM support{k}""",
        f"best{k}": f"""
            SELECT * EXCLUDE (place) FROM (
                SELECT *, row_number() OVER (PARTITION BY left_tag, lw, mw, rw ORDER BY similarity DESC, pattern_id) AS place
                FROM matches{k}) WHERE place = 1""",
        f"candidates{k}": f"""
            SELECT m.org, m.loc, c.confidence AS pattern_confidence, b.similarity, m.n
            FROM mentions m JOIN best{k} b ON m.left_tag = b.left_tag AND m.lw = b.lw AND m.mw = b.mw AND m.rw = b.rw
            JOIN confidence{k} c USING (pattern_id)""",
        f"tuples{k}": f"""
            SELECT org, loc, 1 - product(power(1 - pattern_confidence * similarity, n)) AS confidence, CAST(sum(n) AS BIGINT) AS n
            FROM candidates{k} GROUP BY org, loc""",
        f"kept{k}": f"SELECT * FROM tuples{k} WHERE confidence > {_CONFIDENCE}",
        f"found{k}": f"""
            SELECT org, loc FROM (
                SELECT *, row_number() OVER (PARTITION BY org ORDER BY confidence DESC, loc) AS place FROM kept{k}) WHERE place = 1""",
        f"merged{k}": f"SELECT org, loc FROM {seeds} UNION SELECT org, loc FROM found{k}",
    }


CTES |= _round("1", "seeds") | _round("2", "merged1")
CTES |= _round("3", "seeds", two_levels=True) | _round("4", "merged3", two_levels=True)


def _with(select: str) -> str:
    """``select`` with just the tables it needs, each defined once and computed once."""
    needed: dict[str, None] = {}

    def visit(sql: str, of: str = "") -> None:
        words = set(sql.replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name, body in CTES.items():
            if name in words and name not in needed and name != of:
                visit(body, name)
                needed.setdefault(name)

    visit(select)
    if not needed:
        return select
    # Tables that grow from themselves cannot be marked as computed once.
    own = {name: f"FROM {name} " in CTES[name] for name in needed}
    kept = ",\n".join(f"{name} AS {'' if own[name] else 'MATERIALIZED '}({CTES[name]})" for name in needed)
    return f"WITH {'RECURSIVE ' if any(own.values()) else ''}{kept}\n{select}"


_BUCKET = "CAST(floor(coalesce({}, 0.0) * 10 + 0.5) AS INTEGER)"
_VECTORS = ", ".join(_shown(v) for v in ("lc", "mc", "rc"))
_WINDOWS = ", ".join(f"array_to_string({w}, '|') AS {w}" for w in ("lw", "mw", "rw"))
_EACH_PART = " UNION ALL ".join(
    f"SELECT sentence_id, a, b, '{v}' AS part, unnest({v}) AS x FROM segments" for v in ("lc", "mc", "rc")
)

_COPIES = _score(
    "i", "list_transform([{c}], lambda q: {{" + ", ".join(f"'{v}': {_added(f'q.{v}', f'i.{v}', 'j')}".replace("{", "{{").replace("}", "}}") for v in ("lc", "mc", "rc")) + "}})[1]"
)
_ALONE = _score("i", "i")

_SELECTS = {
    "scan_union": "SELECT line FROM document_lines UNION ALL SELECT line FROM conversation_lines",
    "parse_articles": """SELECT "index", text FROM articles""",
    "parse_seeds": "SELECT org, loc FROM truth",
    "format_relations": "SELECT '(' || org || ',' || loc || ')' AS line FROM truth",
    "clean_newlines": """SELECT "index", text FROM clean""",
    "split_sentences": """SELECT "index", pos, sentence FROM document_sentences""",
    "abbreviations": "SELECT word, n, n_stops, round(score, 6) AS score FROM abbreviated WHERE score >= 0.3",
    "report_sentences": """
        SELECT "index", CAST(pos AS INTEGER) AS pos, replace(sentence, chr(2), '.') AS sentence FROM (
            SELECT "index", unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM (
                SELECT "index", list_filter(string_split(regexp_replace(text, '((?: [.!?]+)+) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM report_spaced))""",
    "tag_entities": "SELECT sentence_id, sentence FROM retagged",
    "tag_products": """
        SELECT sentence_id, string_agg(CASE WHEN tag IS NOT NULL THEN '<' || tag || '>' || w || '</' || tag || '>'
            WHEN w || ' ' || later IN (SELECT p_name FROM part) THEN '<PRODUCT>' || w WHEN before || ' ' || w IN (SELECT p_name FROM part) THEN w || '</PRODUCT>'
            ELSE w END, ' ' ORDER BY pos) AS sentence
        FROM product_tokens LEFT JOIN gazetteer ON w = name GROUP BY sentence_id""",
    "tag_words": """
        SELECT sentence_id, count(*) AS n_words, string_agg(w || '_' || coalesce(tag, 'NN'), ' ' ORDER BY pos) AS tagged
        FROM words LEFT JOIN top_tags ON w = word GROUP BY sentence_id""",
    "tag_costs": "SELECT nullif(before, '') AS before, nullif(tag, '') AS tag, cost FROM step_costs",
    "tag_words_in_context": """
        SELECT sentence_id, len(tags) AS n_words, array_to_string(list_transform(list_zip(ws, tags), lambda z: z[1] || '_' || z[2]), ' ') AS tagged FROM (
            SELECT sentence_id, ws, best.tags AS tags FROM (
                WITH RECURSIVE path AS (
                    SELECT sentence_id, string_split(sentence, ' ') AS ws, 0 AS done, '' AS tag, CAST(0 AS BIGINT) AS cost, CAST([] AS VARCHAR[]) AS tags FROM plain
                    UNION ALL
                    SELECT p.sentence_id, first(p.ws), p.done + 1, w.tag, min(p.cost + s.cost) + first(w.cost), list_append(arg_min(p.tags, {'cost': p.cost + s.cost, 'tag': p.tag}), w.tag)
                    FROM path p JOIN word_costs w ON p.done < len(p.ws) AND w.word = p.ws[p.done + 1] JOIN step_costs s ON s.before = p.tag AND s.tag = w.tag
                    GROUP BY p.sentence_id, p.done, w.tag)
                SELECT sentence_id, first(ws) AS ws, arg_min({'tags': tags}, {'cost': path.cost + s.cost, 'tag': path.tag}) AS best
                FROM path JOIN step_costs s ON s.before = path.tag AND s.tag = '' WHERE done = len(ws) GROUP BY sentence_id))""",
    "filter_by_tags": "SELECT sentence_id, sentence FROM filtered",
    "org_sentences": "SELECT sentence_id, org, sentence FROM org_rows",
    "tokenize_tagged": "SELECT sentence_id, pos, text, tag FROM tokens",
    "mention_sites": """
        SELECT sentence_id, coalesce(string_agg(CASE WHEN tag = 'ORGANIZATION' THEN CAST(pos AS VARCHAR) END, '|' ORDER BY pos), '') AS org_sites,
               coalesce(string_agg(CASE WHEN tag = 'LOCATION' THEN CAST(pos AS VARCHAR) END, '|' ORDER BY pos), '') AS loc_sites
        FROM tokens GROUP BY sentence_id""",
    "entity_pairs": "SELECT sentence_id, a, b, org, loc, left_tag FROM pairs",
    "context_windows": f"SELECT sentence_id, a, b, occurrences, {_WINDOWS} FROM windows",
    "text_segments": f"SELECT sentence_id, a, b, org, loc, left_tag, occurrences, {_VECTORS} FROM segments",
    "context_vectors": f"SELECT sentence_id, a, b, part, x.token AS token, round(x.weight, 6) AS weight FROM ( {_EACH_PART} )",
    "add_vectors": """
        SELECT s.sentence_id, s.a, s.b, coalesce(vector, '') AS vector, coalesce(total, 0.0) AS total FROM segments s LEFT JOIN (
            SELECT sentence_id, a, b, round(sum(weight), 6) AS total,
                   string_agg(token || '=' || CAST(CAST(floor(weight * 1000000 + 0.3) AS BIGINT) AS VARCHAR), ' ' ORDER BY token) AS vector
            FROM (SELECT sentence_id, a, b, x.token AS token, sum(x.weight) AS weight FROM (
                SELECT sentence_id, a, b, unnest(lc) AS x FROM segments UNION ALL
                SELECT sentence_id, a, b, unnest(rc) AS x FROM segments) GROUP BY ALL)
            GROUP BY sentence_id, a, b) v ON s.sentence_id = v.sentence_id AND s.a = v.a AND s.b = v.b""",
    "sentence_seed_join": "SELECT o.org, o.sentence_id, o.sentence, s.loc FROM org_rows o JOIN seeds s ON o.org = s.org",
    "raw_patterns": f"SELECT left_tag, {_VECTORS}, weight FROM raw1",
    "split_words": "SELECT item FROM items",
    "word_tags": "SELECT word, tag FROM pairs_of_words",
    "word_tag_counts": "SELECT word, tag, n FROM counts",
    "article_word_counts": """
        SELECT split_part(item, '_', 1) AS word, split_part(item, '_', 2) AS tag, count(*) AS n FROM (
            SELECT w || '_' || coalesce(tag, 'NN') AS item FROM words LEFT JOIN top_tags ON w = word)
        WHERE regexp_matches(item, '_[^_]') GROUP BY ALL""",
    "word_tag_sorted": "SELECT word, tag, n FROM counts ORDER BY word, tag",
    "top_tag_per_word": "SELECT word, tag, n FROM top_tags",
    "tags_per_word": "SELECT word, n FROM tag_numbers",
    "most_ambiguous_words": "SELECT word, n FROM tag_numbers ORDER BY n DESC, word LIMIT 10",
    "centroids": f"SELECT cluster_id, left_tag, {_VECTORS} FROM centers",
    "degree_of_match": f"""
        SELECT cluster_id, s.left_tag, {_shown('s.lc', 'lc')}, {_shown('s.mc', 'mc')}, {_shown('s.rc', 'rc')},
               round({_similarity('s', 'k')}, 6) AS similarity
        FROM (SELECT DISTINCT loc, left_tag, lc, mc, rc FROM segments) s JOIN centers k ON s.loc = k.loc""",
    "exact_pattern_clusters": f"SELECT left_tag, {_VECTORS}, size, copies FROM level1",
    "pattern_clusters": f"SELECT left_tag, {_VECTORS}, size, copies FROM centroid3",
    "final_patterns": f"SELECT pattern_id, left_tag, {_VECTORS}, size FROM patterns3",
    "bootstrap_relations": "SELECT org, loc FROM merged4",
    "iteration_metrics": " UNION ALL ".join(
        f"""SELECT {i} AS iteration, (SELECT CAST(coalesce(sum(weight), 0) AS BIGINT) FROM raw{k} ) AS raw_patterns,
               (SELECT CAST(coalesce(sum(copies), 0) AS BIGINT) FROM centroid{k} ) AS centroids, (SELECT count(*) FROM patterns{k} ) AS final_patterns,
               (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM mentions ) AS text_segments, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM tuples{k} ) AS candidates,
               (SELECT count(*) FROM found{k} ) AS new_seeds, (SELECT count(*) FROM merged{k} ) AS total_seeds"""
        for i, k in ((1, "3"), (2, "4"))
    ),
    # The first copy of a context meets the clusters before it, every further copy the cluster that the one before it is in.
    "hist_cluster_similarity": f"""
        SELECT CAST(floor(s * 10 + 0.5) AS INTEGER) AS bucket, count(*) AS n FROM (
            SELECT unnest(CASE WHEN best > {_SIMILARITY} THEN list_transform(range(weight), lambda j: {_COPIES.format(c='before[place]', j='j')})
                WHEN len(before) = 0 THEN list_transform(range(1, weight), lambda j: {_ALONE})
                ELSE list_prepend(greatest(best, 0), list_transform(range(1, weight), lambda j: {_ALONE})) END) AS s
            FROM pass3 p JOIN items3 i ON p.left_tag = i.left_tag AND p.signature = i.signature AND p.bucket = i.bucket AND p.turn = i.turn
            UNION ALL
            SELECT CASE signature {' '.join(f'WHEN {s} THEN CAST({v} AS DOUBLE)' for s, v in _SELF.items())} END
            FROM (SELECT signature, unnest(range(1, copies)) AS j FROM centroid3 WHERE signature NOT IN ({_JOINABLE}) ))
        GROUP BY 1""",
    "pattern_matches": f"SELECT org, loc, left_tag, {_WINDOWS}, n, pattern_id, round(similarity, 6) AS similarity FROM matched1",
    "match_seed_join": """
        SELECT m.org, m.loc, s.loc AS seed_loc, pattern_id, CAST(sum(n) AS BIGINT) AS n
        FROM matched1 m JOIN seeds s ON m.org = s.org GROUP BY ALL""",
    "pattern_support": "SELECT pattern_id, positives, negatives FROM support1",
    "pattern_confidence": "SELECT pattern_id, positives, negatives, round(confidence, 6) AS confidence FROM confidence1",
    "best_pattern": f"SELECT left_tag, {_WINDOWS}, pattern_id, round(similarity, 6) AS similarity FROM best1",
    "candidate_tuples": """
        SELECT org, loc, round(pattern_confidence, 6) AS pattern_confidence, round(similarity, 6) AS similarity, CAST(sum(n) AS BIGINT) AS n
        FROM candidates1 GROUP BY org, loc, round(pattern_confidence, 6), round(similarity, 6)""",
    "tuple_confidence": "SELECT org, loc, round(confidence, 6) AS confidence, n FROM tuples1",
    "filtered_tuples": "SELECT org, loc, round(confidence, 6) AS confidence, n FROM kept1",
    "new_seeds": "SELECT org, loc FROM found1",
    "merged_seeds": "SELECT org, loc FROM merged1",
    "exact_relations": "SELECT org, loc FROM merged2",
    # Every segment and pattern, also those of different tag or signature, whose score counts as zero.
    "hist_match_similarity": f"""
        SELECT bucket, CAST(sum(n) AS BIGINT) AS n FROM (
            SELECT {_BUCKET.format('similarity')} AS bucket, m.n
            FROM mentions m JOIN scores1 x ON m.left_tag = x.left_tag AND m.lw = x.lw AND m.mw = x.mw AND m.rw = x.rw
            UNION ALL
            SELECT 0, m.n FROM mentions m
            JOIN contexts c ON m.left_tag = c.left_tag AND m.lw = c.lw AND m.mw = c.mw AND m.rw = c.rw
            JOIN patterns1 p ON c.left_tag <> p.left_tag OR c.signature <> p.signature)
        GROUP BY bucket HAVING sum(n) > 0""",
    "hist_tuple_confidence": f"SELECT {_BUCKET.format('confidence')} AS bucket, count(*) AS n FROM tuples1 GROUP BY 1",
    "prepare_corpus": """
        SELECT CAST(split_part(sentence_id, '-', 1) AS BIGINT) AS "index", 0 AS pos, sentence FROM retagged""",
}

ORACLES = {name: _with(select) for name, select in _SELECTS.items()}
