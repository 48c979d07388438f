"""Queries of the operators that SQL can express, for DuckDB. Brute force: for small tables."""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

REPEATS = """WITH RECURSIVE d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substring(x, CAST(2 * i + 1 AS BIGINT), 100) AS s FROM (SELECT doc_id, x, unnest(range(0, greatest(0, length(x) // 2 - 49))) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS owner FROM w GROUP BY s),
r AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE owner < doc_id),
e AS (SELECT doc_id, i, CASE WHEN i <= 50 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS opens FROM r),
g AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM e),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, span),
cuts AS (SELECT doc_id, a AS stop, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start FROM spans
  UNION ALL SELECT d.doc_id, length(x) // 2, coalesce(max(b), 0) FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id, x),
kept AS (SELECT doc_id, string_agg(substring(x, CAST(2 * start + 1 AS BIGINT), CAST(2 * (stop - start) AS BIGINT)), '' ORDER BY start) AS k FROM cuts JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST((length(x) - length(k)) // 2 AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""

DECONTAMINATION = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM t WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, n FROM places JOIN windows USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id),
tokens AS (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM d),
own AS (SELECT s, n, row_number() OVER () AS k FROM (SELECT DISTINCT s, n FROM windows)),
terms AS (SELECT k, n, unnest(string_split(s, ' ')) AS term, unnest(range(n)) AS nth FROM own),
counts AS (SELECT term, count(*) AS total FROM tokens WHERE term IN (SELECT term FROM terms) GROUP BY term),
rarest AS (SELECT k, n, arg_min(term, total * 100 + nth) AS term FROM terms JOIN counts USING (term) GROUP BY k, n HAVING count(*) = n),
around AS (SELECT k, doc_id, pos AS centre, unnest(range(pos - n - 1, pos + n + 2)) AS pos FROM rarest JOIN tokens USING (term)),
close AS (SELECT DISTINCT k, doc_id FROM (SELECT k, doc_id, centre, count(DISTINCT term) AS have FROM around JOIN tokens USING (doc_id, pos) JOIN terms USING (k, term) GROUP BY 1, 2, 3)
  JOIN (SELECT k, count(DISTINCT term) AS need FROM terms GROUP BY k) USING (k) WHERE have = need),
near AS (SELECT doc_id, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_near_items FROM close JOIN own USING (k) JOIN windows USING (s, n) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)"""

NEAR_DUPLICATES = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

SIMILAR = NEAR_DUPLICATES.replace("75 * (x.n", "80 * (x.n").replace(", doc_id = component_id AS kept", "")

RANKED = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, n_terms, term, count(*) AS tf FROM (SELECT doc_id, row_number() OVER () AS k, len(w) AS n_terms, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, k, n_terms, term),
t AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, n),
r AS (SELECT item_id, doc_id, sum(t.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n_terms * s.n) // s.l))))::BIGINT AS score FROM q JOIN p USING (term) JOIN t USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10"""

SHARDING = "SELECT doc_id, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS text_md5 FROM documents"

ORACLES = {
    "op4_suffix_array_dedup": REPEATS,
    "op8_decontamination": DECONTAMINATION,
    "op9_minhash_near_dedup": NEAR_DUPLICATES,
    "op10_sharding": SHARDING,
    "op11_ngram_join": SIMILAR,
    "op13_ranked_search": RANKED,
}
