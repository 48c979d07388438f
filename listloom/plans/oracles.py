"""The catalogue's queries in SQL that DuckDB runs."""

from __future__ import annotations

from ..functions.classify import CATEGORIES, WHEN_BUILT, WHEN_PARSED
from ..functions.text import SPELLINGS
from .catalogue import MESSAGES_SQL, NAMES, NORMAL, TRIGGERS


def _category(x: str, patterns: dict[str, str] = WHEN_BUILT) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '(?i){p}') THEN '{name}'" for name, p in patterns.items()) + " ELSE 'technical' END"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _named(x: str) -> str:
    return f"CASE WHEN lower({x}) IN ('', 'no subject', '(no subject)') THEN '(no subject)' ELSE {x} END"


_TAG = r"(?i:\[(?:external\s+email|external|list)\])"
_MERGE = r"^(?:(?:Re:|RE:|Fwd:|FW:|Fw:)\s*)+"
_GROUP = rf"^(?:(?:{_TAG}|Re:|RE:|Fwd:|FW:|Fw:|re:)\s*)+"


def _merge_key(x: str) -> str:
    inner = _trim(f"replace({_trim(x)}, '[list]', '')")
    return _named(_trim(f"lower(regexp_replace({inner}, '{_MERGE}', ''))"))


def _without(x: str) -> str:
    return _trim(f"regexp_replace({_trim(x)}, '{_GROUP}', '')")


def _group_key(x: str) -> str:
    out = f"lower({_without(x)})"
    for a, b in SPELLINGS.items():
        out = f"replace({out}, '{a}', '{b}')"
    return _named(out)


def _reply(x: str) -> str:
    bare = _trim(f"regexp_replace({_trim(x)}, '^(?:{_TAG}\\s*)+', '')")
    return rf"regexp_matches({bare}, '(?i)^(?:re|fw|fwd|aw)\s*:')"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


M = f"m0 AS ({MESSAGES_SQL.format(orders='orders')}), m AS (SELECT *, {_category('subject')} AS category, CAST(NULL AS BIGINT) AS thread_id FROM m0)"
_ORDER = "date NULLS FIRST, message_number"
_AUTHORS = "count(DISTINCT from_name) + CAST(coalesce(max(CASE WHEN from_name IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT)"
_SLUG = "CASE WHEN coalesce(from_name, '') = '' THEN 'unknown' ELSE regexp_replace(lower(from_name), '[^a-z0-9]+', '-', 'g') END"


def _gaps(source: str, key: str, out: str, eligible: str = "true") -> str:
    return f"""{source}_g AS (SELECT *, date IS NOT NULL AND {key} IS NOT NULL AND {eligible} AS fits FROM {source}),
{source}_h AS (SELECT *, CASE WHEN fits AND (epoch_us(date) - lag(epoch_us(date)) OVER (PARTITION BY {key}, fits ORDER BY {_ORDER})) // 86400000000 > 60 THEN 1 ELSE 0 END AS gap FROM {source}_g),
{source}_i AS (SELECT *, sum(gap) OVER (PARTITION BY {key}, fits ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS number FROM {source}_h),
{out} AS (SELECT *, CASE WHEN fits AND number > 0 THEN {key} || '#' || CAST(number AS VARCHAR) ELSE {key} END AS split_key FROM {source}_i)"""


_KEY = f"CASE WHEN source IN ('legacy', 'topic') THEN source || ':' || source_url ELSE {_group_key('subject')} END"
_SEQ = f"count(subject) OVER (PARTITION BY year(date), month(date) ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING)"
_BLANKS = "b0 AS (SELECT *, source = 'legacy' AND (count(DISTINCT k) OVER (PARTITION BY source_url) > 1 OR max(CASE WHEN k = '(no subject)' THEN 1 ELSE 0 END) OVER (PARTITION BY source_url) = 1) AS mixed FROM a)"
_BASE = """b AS (SELECT *, CASE WHEN source = 'topic' OR mixed THEN 'page:' || source_url WHEN k = '(no subject)' AND thread_key <> '(no subject)' THEN thread_key
  WHEN k = '(no subject)' THEN 'msg-' || CAST(message_number AS VARCHAR) ELSE k END AS base FROM b0)"""
_DISPLAYED = f"""{M}, a AS (SELECT *, {_SEQ} AS msg_seq, {_KEY} AS thread_key, {_group_key('subject')} AS k FROM m),
{_BLANKS}, {_BASE},
{_gaps('b', 'base', 'c')},
d AS (SELECT *, row_number() OVER (PARTITION BY split_key ORDER BY date IS NULL, date, msg_seq, message_number) AS place FROM c),
e AS (SELECT *, coalesce(place = min(CASE WHEN NOT {_reply('subject')} THEN place END) OVER (PARTITION BY split_key), false) AS first FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY split_key ORDER BY first DESC, place) AS position FROM e)"""
_ROOTS = f"""WITH RECURSIVE {M}, r AS (SELECT message_number AS n, message_number AS cur, [message_number] AS seen, 0 AS d FROM m
UNION ALL SELECT r.n, m.in_reply_to_number, list_append(r.seen, m.in_reply_to_number), r.d + 1 FROM r JOIN m ON m.message_number = r.cur
WHERE m.in_reply_to_number IS NOT NULL AND len(list_distinct(r.seen)) = len(r.seen))"""
_INDEX = r"""parts AS (SELECT message_number, category, 'subject' AS field, list_filter(string_split_regex(lower(coalesce(subject, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS terms FROM m
UNION ALL SELECT message_number, category, 'from_name', list_filter(string_split_regex(lower(coalesce(from_name, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '') FROM m)"""


def _hits(words: list[str], k: int, where: str) -> str:
    match = " OR ".join(f"starts_with(term, '{w}') OR levenshtein(term, '{w}') <= {k}" for w in words)
    return f"""WITH {M}, {_INDEX}, pool AS (SELECT * FROM parts {where}),
sizes AS (SELECT field, count(*) AS docs, avg(len(terms)) AS mean FROM pool GROUP BY field),
flat AS (SELECT message_number, field, len(terms) AS length, unnest(terms) AS term FROM pool),
found AS (SELECT field, term, message_number, length, count(*) AS tf FROM flat WHERE {match} GROUP BY ALL),
frequent AS (SELECT field, term, count(*) AS df FROM found GROUP BY ALL),
hits AS (SELECT message_number, round(sum(CASE field WHEN 'subject' THEN 5.0 ELSE 3.0 END::DOUBLE * ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
  * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)))), 6) AS score
  FROM found JOIN frequent USING (field, term) JOIN sizes USING (field) GROUP BY message_number)"""


def _each(found: dict[str, tuple[list[str], int, str]], select: str) -> str:
    """One SELECT for each query, all rows together."""
    return " UNION ALL ".join(f"SELECT * FROM ({_hits(words, k, where)} {select.format(q=q)})" for q, (words, k, where) in found.items())


_DOCUMENTS = f"""{M}, s AS (SELECT *, {_SEQ} AS msg_seq FROM m), docs AS (SELECT subject, from_name, body_clean AS body, category, coalesce(year(s.date), 0) AS year, coalesce(strftime(s.date, '%Y-%m-%d'), '') AS date,
CASE WHEN s.date IS NULL THEN printf('/undated/%d.html', msg_seq) ELSE printf('/%d/%02d/%d.html', year(s.date), month(s.date), msg_seq) END AS url FROM s)"""
_WS = r"trim(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '=\s+', '', 'g'), '\s+', ' ', 'g'))"
ORACLES = {
    "monthly_volume": f"WITH {M} SELECT strftime(date, '%Y-%m') AS month, category, count(*) AS n FROM m WHERE date IS NOT NULL GROUP BY ALL",
    "event_volume": "SELECT strftime(ts, '%Y-%m') AS month, event_type AS category, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "thread_summary": f"""WITH {M} SELECT {_group_key('subject')} AS thread_key, arg_min(subject, message_number) AS subject, arg_min(category, message_number) AS category,
count(*) AS n_messages, strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date, {_AUTHORS} AS n_participants FROM m GROUP BY 1""",
    "top_contributors": f"WITH {M} SELECT from_name, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, from_name NULLS LAST LIMIT 20",
    "technical_only": f"WITH {M} SELECT message_number, subject FROM m WHERE category = 'technical'",
    "year_category_pivot": f"WITH {M} SELECT year(date) AS year, {', '.join(f'count(*) FILTER (category = {chr(39)}{c}{chr(39)}) AS {c}' for c in CATEGORIES)} FROM m WHERE date IS NOT NULL GROUP BY 1",
    "source_totals": f"WITH {M} SELECT source, count(*) AS n_messages, {_AUTHORS} AS n_authors, count(*) FILTER (category = 'technical') AS n_technical FROM m GROUP BY 1",
    "totals": f"WITH {M} SELECT count(*) AS n_messages, {_AUTHORS} AS n_authors, count(*) FILTER (category = 'technical') AS n_technical, min(year(date)) AS first_year, max(year(date)) AS last_year FROM m",
    "month_counts": f"WITH {M} SELECT year(date) AS year, month(date) AS month, count(*) AS n FROM m WHERE date IS NOT NULL GROUP BY ALL",
    "category_counts": f"WITH {M} SELECT source, category, count(*) AS n FROM m GROUP BY ALL",
    "author_index": f"""WITH {M}, a AS (SELECT {_SLUG} AS author_slug, arg_min(from_name, message_number) AS name, count(*) AS n, min(year(date)) AS first_year, max(year(date)) AS last_year FROM m GROUP BY 1)
SELECT *, round(100.0::DOUBLE * n / max(n) OVER (), 1) AS percent FROM a""",
    "author_timeline": f"WITH {M} SELECT {_SLUG} AS author_slug, count(*) AS n, coalesce(CAST(min(year(date)) AS VARCHAR), '?') AS first_year, coalesce(CAST(max(year(date)) AS VARCHAR), '?') AS last_year FROM m GROUP BY 1",
    "subject_keys": f"""WITH {M} SELECT message_number, {_merge_key('subject')} AS merge_key, {_group_key('subject')} AS group_key,
{_named(_trim("replace(" + _trim('subject') + ", '[list]', '')"))} AS display_subject, {_named(_without('subject'))} AS thread_subject, {_reply('subject')} AS is_reply FROM m""",
    "message_classes": f"""WITH p AS (SELECT p_partkey, p_name || {_list(TRIGGERS)}[p_partkey % {len(TRIGGERS)} + 1] AS s FROM part)
SELECT p_partkey, {_category('s', WHEN_PARSED)} AS parsed, {_category('s')} AS built FROM p""",
    "body_signatures": f"SELECT doc_id, substring(lower({_WS}), 1, 160) AS signature FROM documents",
    "stripped_disclaimers": rf"""WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN regexp_replace(text || chr(10) || '------------  ', '-{{10,}}\s*$', '') ELSE text END AS t FROM documents)
SELECT doc_id, md5({_trim('t')}) AS body_md5, length({_trim('t')}) AS n FROM d""",
    "email_hashes": "SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN sha256(lower(c_name) || '@x.example') END AS hash FROM customer",
    "swapped_fields": rf"""WITH {M}, s AS (SELECT message_number, subject, CASE WHEN message_number % 5 = 0 THEN 'Re: ' || source ELSE from_name END AS name FROM m),
t AS (SELECT *, coalesce(regexp_matches(name, '^(?:Re:|RE:|Fwd?:|FW:|\[list\])') AND NOT regexp_matches(subject, '^(?:Re:|RE:|Fwd?:|FW:|\[list\])'), false) AS swap FROM s)
SELECT message_number, CASE WHEN swap THEN subject ELSE name END AS from_name, CASE WHEN swap THEN name ELSE subject END AS subject FROM t""",
    "source_urls": f"""WITH {M} SELECT message_number, source, coalesce(CASE WHEN message_number % 2 = 0 THEN source_url END, 'http://a.example/' || CASE source
WHEN 'live' THEN printf('msg%05d.html', message_number) WHEN 'pipermail' THEN '2006-May/' || message_number || '_a.html' ELSE '2006-May_' || message_number || '_a.html' END) AS source_url FROM m""",
    "union_sources": """SELECT conv_id AS thread_id, CAST(NULL AS BIGINT) AS message_number, role AS from_name, 'live' AS source, md5(text) AS body_md5 FROM conversations WHERE turn = 0
UNION ALL SELECT conv_id, turn, role, 'legacy', NULL FROM conversations WHERE turn > 0""",
    "dedup_priority": f"""WITH {M}, k AS (SELECT *, {_merge_key('subject')} AS s, CAST(date AS DATE) AS day, CASE source WHEN 'live' THEN 0 WHEN 'pipermail' THEN 1 WHEN 'legacy' THEN 2 ELSE 3 END AS p,
CASE WHEN {_merge_key('subject')} = '(no subject)' THEN substring(lower(coalesce(body_clean, '')), 1, 160) ELSE '' END AS sig FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY s, sig, day, from_name ORDER BY p, {_ORDER}) AS nth, count(*) OVER (PARTITION BY s, sig, day, from_name) AS rows,
count(DISTINCT source_url) OVER (PARTITION BY s, sig, day, from_name) AS urls FROM k), kept AS (SELECT * FROM r WHERE nth = 1),
page AS (SELECT *, row_number() OVER (PARTITION BY source, source_url, subject, date, body_clean, from_name ORDER BY p, {_ORDER}) AS copy FROM r WHERE rows > 1 AND urls = 1 AND day IS NOT NULL AND from_name IS NOT NULL),
back AS (SELECT * FROM page q WHERE copy = 1 AND NOT EXISTS (SELECT 1 FROM kept x WHERE x.source = q.source AND x.source_url = q.source_url AND x.subject = q.subject AND x.date = q.date AND x.body_clean = q.body_clean AND x.from_name = q.from_name))
SELECT message_number, source, source_url, subject, from_name FROM kept UNION ALL SELECT message_number, source, source_url, subject, from_name FROM back""",
    "newest_snapshot": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS url, strftime(ts, '%Y%m%d%H%M%S') AS timestamp, event_id FROM events)
SELECT url, timestamp, event_id FROM e QUALIFY row_number() OVER (PARTITION BY url ORDER BY timestamp DESC, event_id) = 1""",
    "message_sequence": f"""WITH {M}, s AS (SELECT message_number, year(date) AS year, month(date) AS month, {_SEQ} AS msg_seq FROM m)
SELECT *, CASE WHEN year IS NULL THEN printf('/undated/%d.html', msg_seq) ELSE printf('/%d/%02d/%d.html', year, month, msg_seq) END AS url FROM s""",
    "gap_threads": f"WITH {M}, s AS (SELECT *, {_group_key('subject')} AS thread_key FROM m), {_gaps('s', 'thread_key', 't')} SELECT message_number, split_key AS thread_key FROM t",
    "keyed_threads": f"WITH {M} SELECT message_number, {_KEY} AS thread_key FROM m",
    "display_threads": f"WITH {_DISPLAYED} SELECT message_number, split_key AS display_thread_key, position FROM f",
    "thread_meta": f"""WITH {_DISPLAYED} SELECT split_key AS display_thread_key, arg_min(subject, position) AS subject, count(*) AS n_messages, {_AUTHORS} AS n_participants,
strftime(arg_max(date, position) FILTER (date IS NOT NULL), '%Y-%m-%d') AS last_date FROM f GROUP BY 1""",
    "thread_members": f"WITH {_DISPLAYED} SELECT split_key AS display_thread_key, position, message_number FROM f",
    "messages_with_thread": f"""WITH {_DISPLAYED}, t AS (SELECT split_key, arg_min(subject, position) AS s, count(*) AS n, {_AUTHORS} AS p, arg_max(date, position) FILTER (date IS NOT NULL) AS d FROM f GROUP BY 1)
SELECT message_number, s AS thread_subject, n AS thread_n_messages, p AS thread_n_participants, strftime(d, '%Y-%m-%d') AS thread_last_date, n > 1 AS has_context FROM f JOIN t USING (split_key)""",
    "thread_list_tops": f"""WITH {_DISPLAYED}, t AS (SELECT split_key AS display_thread_key, arg_min(subject, position) AS s, count(*) AS n_messages, arg_max(date, position) FILTER (date IS NOT NULL) AS d FROM f GROUP BY 1)
(SELECT 'recent' AS by, display_thread_key, n_messages FROM t ORDER BY d DESC NULLS LAST, display_thread_key LIMIT 20)
UNION ALL (SELECT 'count', display_thread_key, n_messages FROM t ORDER BY n_messages DESC, d DESC NULLS LAST, display_thread_key LIMIT 20)
UNION ALL (SELECT 'subject', display_thread_key, n_messages FROM t ORDER BY lower(s) NULLS FIRST, display_thread_key LIMIT 20)""",
    "author_list_tops": f"""WITH {M}, a AS (SELECT {_SLUG} AS author_slug, arg_min(from_name, message_number) AS name, count(*) AS n, max(year(date)) AS last FROM m GROUP BY 1)
(SELECT 'name' AS by, author_slug, n FROM a ORDER BY lower(name) NULLS FIRST, author_slug LIMIT 5)
UNION ALL (SELECT 'name_desc', author_slug, n FROM a ORDER BY lower(name) DESC NULLS LAST, author_slug LIMIT 5)
UNION ALL (SELECT 'count', author_slug, n FROM a ORDER BY n DESC, author_slug LIMIT 5)
UNION ALL (SELECT 'recent', author_slug, n FROM a ORDER BY last DESC NULLS LAST, n DESC, author_slug LIMIT 5)""",
    "one_thread": f"{_ROOTS}, t AS (SELECT n, arg_max(cur, d) AS root FROM r GROUP BY n) SELECT message_number, strftime(date, '%Y-%m-%d') AS date FROM m JOIN t ON n = message_number WHERE root = 7",
    "archive_span": f"WITH {M} SELECT count(DISTINCT {_group_key('subject')}) AS n_threads, strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date FROM m",
    "enriched_messages": f"""WITH {M}, a0 AS (SELECT *, {_SEQ} AS msg_seq, {_KEY} AS thread_key0, {_group_key('subject')} AS k FROM m),
{_gaps('a0', 'thread_key0', 'a1', "source NOT IN ('legacy', 'topic')")},
a AS (SELECT * EXCLUDE (fits, gap, number, split_key), split_key AS thread_key FROM a1), {_BLANKS}, {_BASE}, {_gaps('b', 'base', 'c')}
SELECT message_number, from_name, {_SLUG} AS author_slug, {_named(_trim("replace(" + _trim('subject') + ", '[list]', '')"))} AS subject, category, thread_key, msg_seq,
CASE WHEN c.date IS NULL THEN printf('/undated/%d.html', msg_seq) ELSE printf('/%d/%02d/%d.html', year(c.date), month(c.date), msg_seq) END AS url, split_key AS display_thread_key FROM c""",
    "search_results": _hits(["17", "topic", "wokshop"], 2, "WHERE category = 'event'") + f""", s AS (SELECT *, {_SEQ} AS msg_seq FROM m),
docs AS (SELECT *, CASE WHEN s.date IS NULL THEN printf('/undated/%d.html', msg_seq) ELSE printf('/%d/%02d/%d.html', year(s.date), month(s.date), msg_seq) END AS url, coalesce(strftime(s.date, '%Y-%m-%d'), '') AS day FROM s)
SELECT url, score, subject, from_name, category, day AS date, coalesce(body_clean, '') AS snippet FROM hits JOIN docs USING (message_number) ORDER BY score DESC, url LIMIT 50""",
    "live_pages": r"""SELECT c_custkey AS message_number, 'm' || c_custkey AS message_id, strftime(make_timestamp(2026, 3, c_custkey % 28 + 1, 17, 20, 38), '%Y-%m-%d %H:%M:%S') AS date, c_name AS from_name, 'Re: ' || c_mktsegment AS subject, 'technical' AS category,
concat_ws(chr(10), 'one', '', 'two', '', 'a b ' || c_nationkey, '', 'é 😀 & more', '', '> quoted', '>', '> > deeper', '> >', '> > as  it', '> >   is', '', 'x  y', '  z', '', 'cell') AS body_raw FROM customer""",
    "legacy_pages": """WITH c AS (SELECT *, c_custkey % 28 + 1 AS d FROM customer)
SELECT c_custkey || '.html' AS source_file, 0 AS place, strftime(make_timestamp(1999, 1, d, 15, 20, 38), '%Y-%m-%d %H:%M:%S') AS date, c_name AS from_name, 'dosing of ' || c_mktsegment AS subject, 'technical' AS category,
concat_ws(chr(10), 'From: ' || c_name || ' <a@x.example>', 'Subject: dosing of ' || c_mktsegment, 'Date: Fri, ' || d || ' Jan 1999 10:20:38 -0500', 'The first body has 50 characters and more, for shorter ones are no messages.', 'indented') AS body_raw FROM c
UNION ALL SELECT c_custkey || '.html', 1, strftime(make_timestamp(1999, 2, d, 0, 0, 0), '%Y-%m-%d %H:%M:%S'), 'Ben Example', 'Re: dosing', 'technical',
concat_ws(chr(10), 'Subject: Re: dosing', 'From: Ben Example', 'Date: ' || d || ' Feb 1999', 'A second body, of ' || c_nationkey || ' and a number of other words, long enough.') FROM c""",
    "monthly_pages": """SELECT '2006-May_' || c_custkey || '.html' AS source_file, '2006-May' AS archive_month, c_custkey AS archive_id, strftime(make_timestamp(2006, 5, c_custkey % 28 + 1, 10, 20, 38), '%Y-%m-%d %H:%M:%S') AS date,
c_name AS from_name, 'Re: ' || c_mktsegment AS subject, 'technical' AS category, concat_ws(chr(10), 'one', 'two ' || c_nationkey || 'three', '', 'fourfive', '', 'six') AS body_raw FROM customer""",
    "topic_pages": """WITH c AS (SELECT *, c_custkey % 28 + 1 AS d FROM customer),
s AS (SELECT c_custkey, 0 AS place, strftime(make_date(1993, 11, d), '%Y-%m-%d') AS date, c_name AS from_name, c_mktsegment, 'The question.' AS body_raw FROM c
UNION ALL SELECT c_custkey, 1, CASE c_custkey WHEN 7 THEN '1994-02-16' WHEN 8 THEN '1994-04-06' END, 'Ben Example', c_mktsegment, 'An answer of ' || c_nationkey || '.' FROM c
UNION ALL SELECT c_custkey, 2, CASE c_custkey WHEN 8 THEN '1994-04-06' WHEN 9 THEN '1994-03-15' END, 'Cleo Example', c_mktsegment, 'A memo.' FROM c
UNION ALL SELECT c_custkey, 3, CASE c_custkey WHEN 8 THEN '1994-04-06' END, 'D Example', c_mktsegment, 'One more.' FROM c)
SELECT c_custkey || '.html' AS source_file, place, date, from_name, 'On ' || c_mktsegment AS subject, body_raw FROM s""",
    "index_pages": """SELECT c_custkey, greatest(12, c_custkey) AS newest, CASE WHEN c_custkey % 2 = 0 THEN '2006-May_' || c_custkey || '.html' ELSE '99apr' || c_custkey || '.html' END AS pipermail_name,
CASE WHEN c_custkey % 2 = 0 THEN c_custkey || '.html' ELSE '99apr' || c_custkey || '.html' END AS legacy_name, CASE WHEN c_custkey % 2 = 0 THEN c_custkey || '.html' ELSE '99apr' || c_custkey || '.html' END AS topic_name FROM customer""",
    "thread_root": f"{_ROOTS} SELECT n AS message_number, arg_max(cur, d) AS thread_id FROM r GROUP BY n",
    "reply_depth": f"""WITH RECURSIVE {M}, r AS (SELECT message_number AS n, message_number AS cur, 0 AS d FROM m
UNION ALL SELECT r.n, p.message_number, r.d + 1 FROM r JOIN m ON m.message_number = r.cur JOIN m p ON p.message_number = m.in_reply_to_number AND p.message_number % 2 = r.n % 2)
SELECT n AS message_number, CAST(max(d) AS BIGINT) AS depth FROM r GROUP BY n""",
    "month_threads": f"""WITH {M}, a AS (SELECT *, year(date) AS y, month(date) AS mo, {_group_key('subject')} AS k FROM m),
b AS (SELECT *, row_number() OVER (PARTITION BY y, mo, k ORDER BY {_ORDER}) AS position, last_value(date) OVER (PARTITION BY y, mo, k ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM a)
SELECT message_number, position, position > 1 AS is_reply, dense_rank() OVER (PARTITION BY y, mo ORDER BY last DESC NULLS LAST, k) AS thread_place FROM b""",
    "previous_next": f"WITH {M}, u AS (SELECT *, '/m/' || message_number AS url FROM m) SELECT message_number, lag(url) OVER (ORDER BY {_ORDER}) AS previous_url, lead(url) OVER (ORDER BY {_ORDER}) AS next_url FROM u",
    "recent_30": f"WITH {M} SELECT message_number, strftime(date, '%Y-%m-%d') AS date FROM m WHERE date IS NOT NULL ORDER BY m.date DESC, message_number DESC LIMIT 30",
    "date_formats": """SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 6 THEN NULL WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00') WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d 14:45:00')
WHEN 7 THEN strftime(o_orderdate, '%Y-%m-%d 15:51:31') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS date FROM orders""",
    "author_normalize": f"SELECT c_custkey, {_list(NORMAL)}[c_custkey % {len(NAMES)} + 1] AS author FROM customer",
    "author_override": f"WITH {M} SELECT message_number, CASE from_name WHEN 'User 1' THEN 'Ann Example' WHEN 'User 2' THEN 'Ben Example' ELSE from_name END AS from_name FROM m",
    "names_from_addresses": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'John Doe ' || c_custkey WHEN 1 THEN 'Unknown' ELSE c_name END AS name FROM customer",
    "reply_split": r"""WITH c AS (SELECT conv_id, turn, 'x😀é😀 ' || regexp_replace(text, '\s+', ' ', 'g') AS head FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN turn % 6 = 3 THEN head || chr(10) || 'On Monday A wrote:' || chr(10) || '> 😀 old' ELSE rtrim(head) END) AS main_md5,
CASE WHEN turn % 6 = 3 THEN NULL WHEN turn % 2 = 0 THEN '-----Original Message-----' || chr(10) || '> 😀 old' ELSE 'On Monday A wrote:' || chr(10) || '> 😀 old' END AS quoted FROM c""",
    "page_links": r"""SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1)) AS link FROM pages""",
    "mime_names": "SELECT c_custkey, 'Jürgen ' || c_name AS name FROM customer",
    "quoted_printable_bodies": "SELECT c_custkey, 'café = ' || c_name || ' and more' AS body FROM customer",
    "search_terms": f"WITH {M}, {_INDEX}, flat AS (SELECT field, message_number, len(terms) AS length, unnest(terms) AS term FROM parts) SELECT field, term, message_number, length, count(*) AS tf FROM flat GROUP BY ALL",
    "search_top50": _hits(["17", "topic", "wokshop"], 2, "WHERE category = 'event'") + " SELECT message_number, score FROM hits ORDER BY score DESC, message_number LIMIT 50",
    "search_hit_count": _hits(["postdok"], 1, "") + " SELECT count(*) AS n_hits FROM hits",
    "stored_search": _each({"topic 17 wokshop": (["17", "topic", "wokshop"], 2, "WHERE category = 'event'"), "postdok": (["postdok"], 1, ""), "user 7": (["7", "user"], 1, "")},
        "SELECT '{q}' AS query, message_number, score FROM hits ORDER BY score DESC, message_number LIMIT 50"),
    "stored_search_counts": _each({"postdok": (["postdok"], 1, ""), "realeased": (["realeased"], 2, ""), "zzzzzz": (["zzzzzz"], 1, ""), "to": (["to"], 0, "")}, "SELECT '{q}' AS query, count(*) AS n_hits FROM hits"),
    "incremental_threads": f"{_ROOTS} SELECT n AS message_number, arg_max(cur, d) AS thread_id FROM r GROUP BY n",
    "page_stream": """WITH RECURSIVE r AS (SELECT s_suppkey AS n, s_suppkey AS cur FROM supplier UNION ALL SELECT n, cur // 3 FROM r WHERE cur >= 3)
SELECT s_suppkey AS message_number, s_name AS from_name, 'Re: ' || s_nationkey AS subject, nullif(s_suppkey // 3, 0) AS in_reply_to_number, min(cur) AS thread_id, CASE WHEN s_suppkey % 2 = 1 THEN 0 ELSE 1 END AS batch
FROM supplier JOIN r ON n = s_suppkey GROUP BY ALL""",
    "gap_sessions_stream": """WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 50 <> 0 THEN epoch_us(ts) END AS t FROM events),
g AS (SELECT *, CASE WHEN (t - lag(t) OVER (PARTITION BY user_id, t IS NULL ORDER BY t, event_id)) // 86400000000 > 1 THEN 1 ELSE 0 END AS gap FROM e)
SELECT user_id, event_id, CASE WHEN t IS NOT NULL AND user_id IS NOT NULL THEN sum(gap) OVER (PARTITION BY user_id, t IS NULL ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT END AS session FROM g""",
    "yearly_files": f"""WITH {M} SELECT 'live by year' AS source, year(date) AS year, count(*) AS n FROM m WHERE source = 'live' GROUP BY 2
UNION ALL SELECT source, year(date), count(*) FROM m WHERE source IN ('live', 'topic') GROUP BY ALL""",
    "alias_file": """SELECT s_suppkey, 'Firm "' || s_nationkey || '"' AS canonical FROM supplier""",
    "snapshot_manifest": """WITH c AS (SELECT c_custkey AS k, '2006' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || '01000000' AS stamp FROM customer),
listed AS (SELECT stamp, 'http://a.example/list/' || k % 500 || '.html' AS url FROM c WHERE k % 10 <> 0 AND k % 7 <> 0),
links AS (SELECT min(stamp) AS stamp, url FROM (SELECT stamp, 'http://a.example/new/' || k % 300 || '.html' AS url FROM c UNION ALL SELECT stamp, 'http://a.example/list/' || k % 500 || '.html' FROM c) GROUP BY url)
SELECT max(stamp) AS timestamp, url FROM (FROM listed UNION ALL FROM links) GROUP BY url""",
    "clustered_threads": f"""WITH {M}, t AS (SELECT {_group_key('subject')} AS thread, date, min(date) OVER (PARTITION BY {_group_key('subject')}) AS first FROM m)
SELECT thread, count(*) AS n, count(*) FILTER (date > CAST(CAST(first AS DATE) + 365 AS TIMESTAMP)) AS n_late FROM t GROUP BY thread""",
    "number_from_footers": f"WITH {M} SELECT max(message_number) + 1 AS next_number FROM m",
    "transliterated_slugs": """SELECT c_custkey, ['zhanna-shchukina', 'elene-psarrou', 'lukasz-zolc', 'dang-thuy', 'iuliia-yizhak', 'plain'][CAST(c_custkey % 6 + 1 AS BIGINT)] || '-' || c_custkey AS slug FROM customer""",
    "quoted_blocks": r"""WITH c AS (SELECT *, conv_id % 6 AS k, 'new ' || regexp_replace(text, '[\s>@<:]+', ' ', 'g') || ' end' AS main FROM conversations),
b AS (SELECT *, [E'From: Ann\nExample <a@x.example>\nSent: Monday\nTo: B\nSubject: x\n\nold', E'Van: Ann\nVerzonden: maandag\nAan: B\nOnderwerp: x\n\nold', E'De : Ann\nEnvoyé : lundi\nÀ : B\nObjet : x\n\nold',
  E'2020-01-02 10:00 GMT Ann\n<a@x.example>\n> one\n> two\n> three', E'From: Ann\nTo: B\n\nno block', E'12 May 2020\n> one\n> two'][CAST(k + 1 AS BIGINT)] AS block FROM c)
SELECT conv_id, turn, md5(CASE WHEN k < 4 THEN main ELSE main || E'\n\n' || block END) AS main_md5, CASE WHEN k < 4 THEN block END AS quoted FROM b""",
    "incremental_upsert": f"{_ROOTS} SELECT n AS message_number, arg_max(cur, d) AS thread_id, any_value(m.subject) AS subject FROM r JOIN m ON m.message_number = r.n GROUP BY n",
    "daily_volume_stream": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "subjects_containing": f"WITH {M} SELECT message_number FROM m WHERE contains(lower(subject), 'workshop')",
    "fetch_status": """WITH s AS (SELECT event_id % 10 AS batch, ['downloaded', 'cached', 'not_found', 'error'][user_id % 4 + 1] AS status FROM events),
c AS (SELECT batch, count(*) FILTER (status = 'downloaded') AS downloaded, count(*) FILTER (status = 'cached') AS cached, count(*) FILTER (status IN ('not_found', 'error')) AS failed FROM s GROUP BY 1)
SELECT *, CAST(sum(downloaded) OVER w AS BIGINT) AS total_downloaded, CAST(sum(cached) OVER w AS BIGINT) AS total_cached, CAST(sum(failed) OVER w AS BIGINT) AS total_failed FROM c WINDOW w AS (ORDER BY batch ROWS UNBOUNDED PRECEDING)""",
    "page_subjects": f"WITH {M} SELECT source_url, count(DISTINCT {_group_key('subject')}) AS n_subjects, bool_or({_group_key('subject')} = '(no subject)') AS has_blank FROM m GROUP BY 1",
    "years": f"WITH {M} SELECT DISTINCT year(date) AS year FROM m WHERE date IS NOT NULL",
    "home_feed": f"""WITH {M} SELECT message_number, subject, from_name, category, year(m.date) AS year, strftime(m.date, '%b %d, %Y') AS date FROM m
WHERE m.date IS NOT NULL ORDER BY m.date DESC, message_number DESC LIMIT 30""",
    "search_documents": f"WITH {_DOCUMENTS} SELECT * FROM docs",
    "search_snippets": f"WITH {_DOCUMENTS} SELECT url, substring(arg_max(coalesce(body, ''), (date, body)), 1, 500) AS snippet FROM docs GROUP BY 1",
    "thread_urls": f"""WITH {M}, s AS (SELECT *, {_SEQ} AS msg_seq, {_named(_without('subject'))} AS bare FROM m)
SELECT message_number, '/threads/' || regexp_replace(regexp_replace(lower(bare), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || CASE WHEN message_number = 0 THEN 'undated-' || msg_seq ELSE CAST(message_number AS VARCHAR) END || '/' AS url,
CASE WHEN year(date) = 1995 AND month(date) = 1 AND msg_seq = 3 THEN 'current' END AS marker, format('{{:,}}', message_number) AS shown,
CASE source WHEN 'live' THEN 'Mail archive' WHEN 'topic' THEN 'Topics' ELSE source END AS label FROM s""",
    "event_gaps": """WITH e AS (SELECT *, CASE WHEN (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 86400000000 > 1 THEN 1 ELSE 0 END AS gap FROM events),
n AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS number FROM e)
SELECT event_id, CASE WHEN number > 0 THEN user_id || '#' || number ELSE CAST(user_id AS VARCHAR) END AS key FROM n""",
    "next_number": "SELECT coalesce(max(o_orderkey), 0) + 1 AS next_number FROM orders",
}
ORACLES["feed_files"] = f"""WITH {_DOCUMENTS} SELECT 'docs' AS file, year, count(*) AS n FROM docs GROUP BY year
UNION ALL SELECT 'feed', year, count(*) FROM ({ORACLES["home_feed"]}) GROUP BY year"""
