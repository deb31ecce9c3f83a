"""DuckDB SQL for the queries that SQL can express."""

from corpusloom.llm.license_scan import NOTICES, PHRASES

#: Words as the operators cut them: A-Z lower-cased, split at \x20 and \x09-\x0D.
WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: Links between documents by distinct 5-word shingles, then the least document reachable.
NEAR_DEDUP = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM w, LATERAL unnest(range(1, greatest(len(ws) - 3, 2))) AS t(i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 75 * (x.n + y.n - inter)),
reach(doc_id, other) AS (SELECT a, b FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other),
c AS (SELECT doc_id, min(other) AS least_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least_id, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(c.least_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

ORACLES: dict[str, str] = {"op10_near_dedup": NEAR_DEDUP}

#: Containment of each item's distinct 5-word shingles in each document.
CONTAMINATION = r"""
WITH d AS (SELECT DISTINCT doc_id, w[i:i + 4] AS g FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents), LATERAL unnest(range(1, len(w) - 3)) AS t(i)),
b AS (SELECT DISTINCT item_id, w[i:i + 4] AS g FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark), LATERAL unnest(range(1, len(w) - 3)) AS t(i)),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id)
SELECT doc_id, item_id, n AS item_shingles, count(*) AS shared, round(count(*) / n, 6) AS containment
FROM d JOIN b USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= 0.75 * n
"""

ORACLES["op5_contamination"] = CONTAMINATION

LOW = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _license_sql() -> str:
    values = ", ".join(f"('{t}', '{label}', {str(base).lower()})" for found, base in ((PHRASES, True), (NOTICES, False)) for t, label in found.items())
    return rf"""
WITH t(template, label, base) AS (VALUES {values}),
tp AS (SELECT template, label, base, len(ws) - 1 AS pairs, CASE WHEN len(ws) < 11 THEN len(ws) - 1 ELSE ceil(0.7 * (len(ws) - 1)) END AS least, i - 1 AS place_in, ws[i] AS a, ws[i + 1] AS b
  FROM (SELECT *, string_split(template, ' ') AS ws FROM t), LATERAL unnest(range(1, len(ws))) AS u(i)),
w AS (SELECT doc_id, regexp_extract_all({LOW.format(text="coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
dp AS (SELECT doc_id, i - 1 AS place, ws[i] AS a, ws[i + 1] AS b FROM w, LATERAL unnest(range(1, len(ws))) AS u(i)),
v AS (SELECT doc_id, template, label, base, pairs, least, place - place_in AS diagonal, list(DISTINCT place_in) AS got, min(place) AS lo, max(place) AS hi FROM dp JOIN tp USING (a, b) GROUP BY ALL),
k AS (SELECT * FROM v WHERE CASE WHEN base THEN len(got) = pairs ELSE len(got) >= least(2, pairs) END),
g AS (SELECT *, CASE WHEN base OR diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > 2 THEN 1 ELSE 0 END AS fresh FROM k),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM g),
s AS (SELECT doc_id, template, label, base, pairs, least, len(list_distinct(flatten(list(got)))) AS found, min(lo) AS lo, max(hi) AS hi, min(diagonal) AS start FROM h GROUP BY doc_id, template, label, base, pairs, least, span),
z AS (SELECT * FROM s WHERE found >= least AND hi - lo <= 1.5 * pairs + 2),
o AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(round(least(1.0, found::DOUBLE / pairs), 6)) AS score FROM z GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM w LEFT JOIN o USING (doc_id)
"""


#: Records by payload: the largest page_id of equal payloads is the response; SHA-1 as base32.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT page_id, payload, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', substr(hex, i, 1)) - 1) + 1, 4)), '') AS bits FROM p),
d AS (SELECT page_id, payload, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(substr(bits, 5 * i + 1, 1) AS INT) * 16 + CAST(substr(bits, 5 * i + 2, 1) AS INT) * 8 + CAST(substr(bits, 5 * i + 3, 1) AS INT) * 4 + CAST(substr(bits, 5 * i + 4, 1) AS INT) * 2 + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS digest FROM b),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS top FROM d)
SELECT page_id, strlen(payload) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM m
"""

#: Poisson counts by inversion at a number from an MD5; target shares by the square root of each source's characters.
MIXING = """
WITH s AS (SELECT source, sum(greatest(length(coalesce(text, '')), 1))::DOUBLE AS chars FROM documents GROUP BY source),
r AS (SELECT source, round(sqrt(chars) / sum(sqrt(chars)) OVER () * sum(chars) OVER () / chars, 6) AS rate FROM s),
u AS (SELECT doc_id, rate, greatest(1, ceil(rate / 16))::INT AS draws FROM documents JOIN r ON r.source IS NOT DISTINCT FROM documents.source),
x AS (SELECT doc_id, i, rate / draws AS m, ('0x' || substr(md5(concat_ws(':', doc_id, 7, i)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM u, LATERAL unnest(range(1, draws + 1)) AS t(i)),
c AS (SELECT doc_id, i, u, sum(exp(-m + j * ln(m) - lgamma(j + 1))) OVER (PARTITION BY doc_id, i ORDER BY j) AS cdf FROM x, range(0, 80) AS n(j)),
k AS (SELECT doc_id, count(*) FILTER (cdf <= u) AS copies FROM c GROUP BY doc_id)
SELECT d.*, CAST(copy AS INTEGER) AS copy, rate FROM documents d JOIN k USING (doc_id) JOIN r ON r.source IS NOT DISTINCT FROM d.source, LATERAL unnest(range(1, copies + 1)) AS t(copy)
"""

ORACLES |= {"op4_warc": WARC, "op7_license_scan": _license_sql(), "op9_mixing": MIXING}

#: Words that no window of 35 words covers whose words start in another place too.
REPEATS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s FROM d, LATERAL unnest(range(1, len(w) - 33)) AS t(i)),
again AS (SELECT r, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + k AS i FROM again, range(35) AS u(k)),
x AS (SELECT r, i, w[i] AS word FROM d, LATERAL unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS s FROM x ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

ORACLES["op12_substring_dedup"] = REPEATS
