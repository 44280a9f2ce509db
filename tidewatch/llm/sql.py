"""SQL of the queries that SQL can express, for an engine with lists and regular expressions."""

from __future__ import annotations

from tidewatch.llm.text import LOWER, UPPER

LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
SPACED = r"'[\x20\x09-\x0D]+'"
ALNUM = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def words(text: str, separators: str) -> str:
    return f"list_filter(string_split_regex({text}, {separators}), lambda w: w <> '')"


OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, {words(LOWERED, SPACED)} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[k + 1 : k + 5], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 4, 1))) AS k FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 80 * (x.n_shingles + y.n_shingles - common)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, ways.b FROM reach r JOIN ways ON r.node = ways.a)
SELECT r.doc_id, coalesce(any_value(n_shingles), 0)::BIGINT AS n_shingles, min(node) AS component_id FROM reach r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id"""

OP3 = f"""WITH d AS (SELECT doc_id, {words(LOWERED, ALNUM)} AS words FROM documents),
i AS (SELECT item_id::VARCHAR AS item, words, least(len(words), 10) AS n FROM (SELECT item_id, {words(LOWERED, ALNUM)} AS words FROM benchmark) WHERE len(words) > 0),
ig AS (SELECT DISTINCT item, n, array_to_string(words[k + 1 : k + n], ' ') AS gram FROM (SELECT *, unnest(range(0, len(words) - n + 1)) AS k FROM i)),
dg AS (SELECT doc_id, n, k, array_to_string(words[k + 1 : k + n], ' ') AS gram FROM (SELECT doc_id, words, n, unnest(range(0, greatest(len(words) - n + 1, 0))) AS k FROM d, (SELECT DISTINCT n FROM i))),
m AS (SELECT doc_id, k, n, item FROM dg JOIN ig USING (n, gram)),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM m) GROUP BY doc_id),
f AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id)"""

OP4 = f"""WITH l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS place FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
r AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT doc_id, place, line, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id"""

OP6 = f"""WITH z AS (SELECT doc_id, source, len({words("coalesce(text, '')", SPACED)})::BIGINT AS size, md5('mix|' || doc_id) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank FROM z GROUP BY source),
p AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][rank % 3 + 1] AS weight, source_size * 3.0::DOUBLE AS lim FROM s),
v AS (SELECT *, lim / weight AS ratio, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM p),
t AS (SELECT source, rank, source_size, CASE WHEN ratio <= level THEN lim ELSE least(lim, weight * (SELECT max(level) FROM v WHERE ratio > level)) END AS target FROM v),
b AS (SELECT doc_id, z.source, size, coalesce(sum(size) OVER (PARTITION BY z.source ORDER BY draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM z),
q AS (SELECT doc_id, size, source_size, target, rank, begun / nullif(target, 0) AS share, len(list_filter([0, 1, 2], lambda e: begun + e * source_size < target)) AS uses FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, (CASE WHEN size > 0 THEN uses * size ELSE 0 END)::BIGINT AS taken,
  CASE WHEN size > 0 AND uses > 0 THEN round(CASE rank % 3 WHEN 0 THEN 2 * share / (1.5 + sqrt(greatest(2.25 - 2 * share, 0))) WHEN 1 THEN share
    ELSE CASE WHEN share <= 0.3125 THEN 2 * share / (0.5 + sqrt(0.25 + share)) ELSE 0.5 + 2 * (share - 0.3125) / (0.75 + sqrt(0.5625 + 5 * (share - 0.3125))) END END, 6) END AS first_position FROM q"""
