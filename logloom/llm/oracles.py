"""SQL that checks the registered queries with another engine."""

from __future__ import annotations

from logloom.llm import secrets
from logloom.llm.licenses import PHRASES, STRIDE, TEMPLATES, THRESHOLD

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> str:
    lowered = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"list_filter(string_split_regex({lowered}, '{_BREAKS}'), lambda x: x <> '')"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


OP3 = f"""
WITH w AS (SELECT doc_id, {_words('text')} AS ws FROM documents),
phrase(p, label) AS (VALUES {', '.join(f"({_list(t.split())}, '{label}')" for t, label in PHRASES)}),
template(t, label) AS (VALUES {', '.join(f"(list_distinct({_list(t.split())}), '{label}')" for t, label in TEMPLATES)}),
place AS (SELECT doc_id, i, label FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM w), phrase WHERE ws[i + 1 : i + len(p)] = p),
base AS (SELECT doc_id, count(*) AS n, min(i) AS f, max(i) AS l, list(DISTINCT label) AS labels FROM place GROUP BY doc_id),
block AS (SELECT doc_id, list_distinct(ws[k * {STRIDE} + 1 : k * {STRIDE} + {2 * STRIDE}]) AS b
          FROM (SELECT doc_id, ws, unnest(range((len(ws) + {STRIDE - 1}) // {STRIDE})) AS k FROM w)),
share AS (SELECT doc_id, label, len(list_intersect(t, b))::DOUBLE / len(t) AS s FROM block, template),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(s) AS s FROM share WHERE s >= {THRESHOLD} - 1e-9 GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_base, f AS first_word, l AS last_word,
    array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
    CASE WHEN n > 0 THEN 1.0 ELSE coalesce(s, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""

OP4 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

# Base32 of the 40 hex digits of SHA-1: each digit gives four bits, taken again five at a time.
OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS s FROM p),
y AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
        4 * (instr('0123456789abcdef', s[i]) - 1) + 1, 4)), 'string_agg', '') AS bits FROM x),
z AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
        1 + 16 * bits[5*i+1]::INT + 8 * bits[5*i+2]::INT + 4 * bits[5*i+3]::INT + 2 * bits[5*i+4]::INT + bits[5*i+5]::INT]), 'string_agg', '') AS d FROM y)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
    CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = min(page_id) OVER w THEN NULL ELSE min(page_id) OVER w END AS refers_to
FROM z WINDOW w AS (PARTITION BY s)
"""

_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = f"""(?:{_ANY_CASE})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_FORMS = (_ASSIGN, "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}", "[A-Za-z0-9+/_-]{20,}")


def _found(kind: int, form: str) -> str:
    """Matches with their code points, from the lengths of matches and of what lies between."""
    least = f"length(regexp_extract(hits[i], '{form}', 1)) >= {secrets.LEAST}" if kind == 0 else "true"
    return f"""SELECT doc_id, {kind} AS kind, hits[i] AS hit, pos AS start, pos + length(hits[i]) AS stop
      FROM (SELECT doc_id, hits, i, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS pos
        FROM (SELECT doc_id, gaps, hits, unnest(range(1, len(hits) + 1)) AS i
          FROM (SELECT doc_id, string_split_regex(t, '{form}') AS gaps, regexp_extract_all(t, '{form}') AS hits FROM d))) WHERE {least}"""


_HAS = {"hex": ("[0-9a-fA-F]+", "[0-9]", "[a-fA-F]"), "alnum": ("[0-9A-Za-z]+", "[0-9]", "[A-Za-z]"), "base64": ("[0-9A-Za-z+/_-]+", "[0-9]", "[a-z]", "[A-Z]")}
_LEVEL = "CASE " + " ".join(
    "WHEN " + " AND ".join([f"regexp_full_match(hit, '{_HAS[name][0]}')", *[f"regexp_matches(hit, '{h}')" for h in _HAS[name][1:]]]) + f" THEN {least}"
    for name, _, _, least in secrets.CLASSES) + " END"
_LINE = "coalesce(string_agg(['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind), '')"
OP6 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(_found(k, f) for k, f in enumerate(_FORMS[:3]))}),
loose AS (SELECT c.*, {_LEVEL} AS least FROM ({_found(3, _FORMS[3])}) c
    WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.start < c.stop AND c.start < b.stop)),
open AS (SELECT * FROM loose WHERE least IS NOT NULL AND NOT regexp_full_match(hit, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}')
    AND NOT regexp_matches(lower(hit), 'example|sample|placeholder|dummy|x{{8}}|0123456789|abcdefgh') AND NOT regexp_full_match(hit, '/?([A-Za-z]{{1,19}}/)+[A-Za-z0-9_-]{{0,19}}')),
win AS (SELECT doc_id, start, w, substr(hit, w, 20) AS part FROM (SELECT *, unnest(range(1, length(hit) - 18)) AS w FROM open)),
chars AS (SELECT doc_id, start, w, c, count(*) AS n FROM (SELECT doc_id, start, w, unnest(string_split(part, '')) AS c FROM win) GROUP BY ALL),
high AS (SELECT doc_id, start, max(h) AS h FROM (SELECT doc_id, start, w, log2(20) - sum(n * log2(n)) / 20 AS h FROM chars GROUP BY doc_id, start, w) GROUP BY ALL),
more AS (SELECT o.doc_id, o.kind, o.hit, o.start, o.stop FROM open o JOIN high USING (doc_id, start) WHERE h >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, {_LINE} AS line FROM base GROUP BY doc_id),
b AS (SELECT doc_id, {_LINE} AS line FROM (FROM base UNION ALL FROM more) GROUP BY doc_id)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
    sha256(coalesce(a.line, '')) AS base_sha256, coalesce(b.line, '') AS spans
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)
"""

OP7 = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS ws FROM documents),
b AS (SELECT item_id, {_words('text')} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, ws[i + 1 : i + 10] AS w
        FROM (SELECT item_id, ws, unnest(range(greatest(len(ws) - 10, 0) + 1)) AS i FROM b WHERE len(ws) > 0)),
size AS (SELECT DISTINCT len(w) AS n FROM win),
place AS (SELECT doc_id, i, ws[i + 1 : i + n] AS w, n
          FROM (SELECT doc_id, ws, n, unnest(range(len(ws) - n + 1)) AS i FROM d, size WHERE len(ws) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM place JOIN win USING (w)),
covered AS (SELECT doc_id, count(*) AS c FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS c, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(covered.c, 0) AS n_hit, coalesce(item.c, 0) AS n_items,
    sha256(coalesce(xs, '')) AS items_sha256, coalesce(covered.c, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN item USING (doc_id)
"""

OP10 = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
fill(round, amount, share) AS (
    SELECT 0, sum(total)::BIGINT, sum(w)::BIGINT FROM s
    UNION ALL
    SELECT f.round + 1,
        (SELECT sum(total) FROM s)::BIGINT - coalesce((SELECT sum(3 * total) FROM s WHERE 3 * total * f.share <= w * f.amount), 0)::BIGINT,
        (SELECT sum(w) FROM s)::BIGINT - coalesce((SELECT sum(w) FROM s WHERE 3 * total * f.share <= w * f.amount), 0)::BIGINT
    FROM fill f WHERE f.round < 40),
final AS (SELECT amount, share FROM fill ORDER BY round DESC LIMIT 1),
t AS (SELECT source, total, CASE WHEN 3 * total * share <= w * amount THEN 3 * total::DOUBLE
             ELSE (w * amount)::DOUBLE / greatest(share, 1)::DOUBLE END AS target FROM s, final),
o AS (SELECT d.doc_id, d.size, t.total, t.target, floor(t.target + 0.5)::BIGINT AS goal,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, total AS source_size, target,
    ((CASE WHEN total > 0 THEN goal // total ELSE 0 END) * size
     + greatest(0, least(size, goal - (CASE WHEN total > 0 THEN goal // total ELSE 0 END) * total - before)))::BIGINT AS taken
FROM o
"""

OP11 = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
reach(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT link.b, reach.root FROM reach JOIN link ON reach.node = link.a AND reach.root < link.b),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
many AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(many.n, 0)::BIGINT AS n_links, coalesce(least.root, e.vec_id) AS component_id, e.vec_id = coalesce(least.root, e.vec_id) AS kept
FROM embeddings e LEFT JOIN many ON e.vec_id = many.a LEFT JOIN least ON e.vec_id = least.node
"""

OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s USING (anchor_id) WHERE p.nth <= 5 AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

OP13 = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS ws FROM documents),
b AS (SELECT item_id, {_words('text')} AS ws FROM benchmark),
whole AS (SELECT count(*)::BIGINT AS docs, sum(len(ws))::BIGINT AS total FROM d WHERE len(ws) > 0),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(ws) AS t FROM b) GROUP BY ALL),
f AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, whole GROUP BY t, docs),
m AS (SELECT doc_id, 100 - 75 + ((75 * len(ws)::BIGINT * docs) // total) AS m FROM d, whole WHERE len(ws) > 0),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN f USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""

ORACLES = {"op3_licenses": OP3, "op4_topk": OP4, "op5_warc": OP5, "op6_secrets": OP6, "op7_decontaminate": OP7, "op10_mixing": OP10,
           "op11_pivots": OP11, "op12_negatives": OP12, "op13_ranked": OP13}
