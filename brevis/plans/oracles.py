"""SQL of the registered queries for DuckDB, written from the rules and not from the plans."""

from __future__ import annotations

from brevis.functions.rewriting import STOPWORDS
from brevis.plans.queries import CUSTOMER_TABLES, EVENT_LOGS, EVERY, KEEP

#: Fixed value: white space of the text rules, for RE2.
_S = r"\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: Patterns of the log rules, for RE2 (alternatives in full).
_ALARM = r"(?i)\b(error|err|fatal|critical|crit|exception|traceback|panic|fail|failed|failure|warn|warning|assert|assertion)\b"
_STACK = rf"^[{_S}]+at[{_S}]|^[{_S}]+File[{_S}]\"|^Traceback|^[{_S}]+\.\.\."
_TIME = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9:.,]+Z?"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{_S}]+|[{_S}]+$', '', 'g')"


def _tokens(x: str) -> str:
    return f"CAST(ceil(length({_trim(x)}) / 4.0) AS BIGINT)"


def _saved(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 THEN sign(1 - {b} / {a}) * floor(abs(1 - {b} / {a}) * 1000 + 0.5) / 1000 ELSE 0 END"


def _detect(table: str, key: str, text: str) -> str:
    """``key, type`` of a table's texts."""
    count = lambda p: f"len(regexp_extract_all(t, '{p}'))"
    delimiter = " OR ".join(
        f"(len({d}) >= greatest(2, 0.6 * len(f)) AND list_max(list_transform(list_distinct({d}), lambda v: len(list_filter({d}, lambda w: w = v)))) >= 0.6 * len({d}))" for d in ("d1", "d2", "d3"))
    counts = ", ".join(f"list_filter(list_transform(r, lambda x: length(x) - length(replace(x, {m}, ''))), lambda n: n > 0) AS {d}" for d, m in (("d1", "chr(9)"), ("d2", "'|'"), ("d3", "','")))
    logged = rf"(?i)\b(error|warn|warning|info|debug|trace|fatal|critical)\b"  # noqa: F541
    hits = f"len(list_filter(every, lambda x: regexp_matches(x, '{logged}') OR regexp_matches(x, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[ T][0-9]') OR regexp_matches(x, '^[{_S}]+at[{_S}]') OR regexp_matches(x, '^\\[[0-9]')))"
    frames = count(rf"(?m)^[{_S}]*at[{_S}]+.+:[0-9]+:[0-9]+")
    files = count(rf"(?m)^[{_S}]*File \".*\", line [0-9]+")
    tests = count(r"✗|✕|✘|✖|✓|✔|\bPASS\b|\bFAIL(?:ED)?\b|\bnot ok [0-9]+|\b[0-9]+ (?:passing|failing|passed|failed)\b")
    codes = count(r"[{}();]|=>|\b(?:function|const|let|def|class|import|export|return|public|private|fn|func)\b")
    return f"""(WITH a AS (SELECT {key}, {_trim(f"coalesce({text}, '')")} AS t FROM {table}),
b AS (SELECT *, regexp_split_to_array(t, '\\r?\\n') AS every FROM a),
c AS (SELECT *, list_filter(every, lambda x: regexp_matches(x, '[^{_S}]')) AS f FROM b),
d AS (SELECT *, list_filter(f, lambda x: NOT regexp_matches(x, '^[{_S}|:.-]*-[{_S}|:.-]*$')) AS r FROM c),
e AS (SELECT *, {counts} FROM d)
SELECT {key}, CASE WHEN ((starts_with(t, '{{') AND ends_with(t, '}}')) OR (starts_with(t, '[') AND ends_with(t, ']'))) AND json_valid(t) AND NOT regexp_matches(t, '\\b(NaN|Infinity)\\b') THEN 'json'
WHEN {frames} >= 2 OR {files} >= 2 OR contains(t, 'Traceback (most recent call last)') OR {tests} >= 3 THEN 'trace'
WHEN len(f) >= 3 AND ({delimiter}) THEN 'table'
WHEN len(every) >= 4 AND {hits} / len(every) >= 0.3 THEN 'log'
WHEN {codes} >= greatest(8, length(t) / 80) THEN 'code' ELSE 'prose' END AS type FROM e)"""


def _prose(source: str, key: str, keep: float) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS.split())
    return f"""
WITH s AS ({source}),
w AS (SELECT {key}, word, pos FROM (SELECT {key}, regexp_extract_all(text, '[^{_S}]+') AS ws FROM s), unnest(ws) WITH ORDINALITY AS u(word, pos)),
p AS (SELECT *, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS plain FROM w),
f AS (SELECT {key}, plain, count(*) AS times FROM p WHERE plain <> '' GROUP BY ALL),
m AS (SELECT {key}, max(times) AS most FROM f GROUP BY ALL),
v AS (SELECT p.*, CAST(count(*) OVER (PARTITION BY p.{key}) AS BIGINT) AS n, CASE WHEN p.plain = '' THEN CAST(0.05 AS DOUBLE) ELSE
 CAST(1 AS DOUBLE) + CASE WHEN p.plain IN ({stop}) THEN CAST(-0.85 AS DOUBLE) ELSE 0 END + CASE WHEN regexp_matches(word, '[0-9]') THEN CAST(1.5 AS DOUBLE) ELSE 0 END
 + CASE WHEN regexp_matches(word, '^[A-Z]') THEN CAST(0.6 AS DOUBLE) ELSE 0 END + CASE WHEN regexp_matches(word, '[_/.\\\\{{}}()=<>:#@\\[\\]]') THEN CAST(0.8 AS DOUBLE) ELSE 0 END
 + least(CAST(length(p.plain) AS DOUBLE) / 8, CAST(0.8 AS DOUBLE)) - CAST(0.4 AS DOUBLE) * (CAST(times AS DOUBLE) / most) END AS worth
 FROM p LEFT JOIN f ON p.{key} = f.{key} AND p.plain = f.plain LEFT JOIN m ON p.{key} = m.{key}),
r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY worth DESC, pos) AS place FROM v),
c AS (SELECT {key}, string_agg(word, ' ' ORDER BY pos) AS kept FROM r WHERE place <= greatest(1, floor(n * CAST({keep} AS DOUBLE) + 0.5)) GROUP BY {key}),
z AS (SELECT {key}, count(*) AS n FROM w GROUP BY {key}),
o AS (SELECT s.{key}, s.text, CASE WHEN coalesce(z.n, 0) <= 3 THEN s.text ELSE kept END AS compressed FROM s LEFT JOIN z ON s.{key} = z.{key} LEFT JOIN c ON s.{key} = c.{key})
SELECT {key}, 'prose' AS type, compressed, {_tokens("text")} AS original_tokens, {_tokens("compressed")} AS compressed_tokens FROM o"""


def _routes() -> str:
    """Types, tokens in and out of the documents; types but prose and table are refused, as their rules are not said here."""
    odd = rf"(?i)\b(error|null|nan|none|missing|undefined|fail|failed|invalid|timeout)\b|,,|\|[{_S}]*\||^[{_S}]*,|,[{_S}]*$"
    rule = f"^[{_S}|:.-]*-[{_S}|:.-]*$"
    return f"""WITH k AS {_detect("documents", "doc_id", "text")},
d AS (SELECT d.doc_id, coalesce(text, '') AS text, CASE WHEN type IN ('prose', 'table') THEN type ELSE error('no SQL for documents of type ' || type) END AS type FROM documents d JOIN k ON k.doc_id = d.doc_id),
b AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\r?\\n'), lambda x: regexp_matches(x, '[^{_S}]') AND NOT regexp_matches(x, '{rule}')) AS r FROM d WHERE type = 'table'),
x AS (SELECT *, list_filter(r[5:], lambda x: regexp_matches(x, '{odd}'))[:3] AS o FROM b),
t AS (SELECT doc_id, 'table' AS type, CASE WHEN len(r) < 3 THEN text ELSE array_to_string(list_concat(r[:4], o, CASE WHEN len(r) > least(len(r), 4) + len(o) THEN ['… ' || (len(r) - least(len(r), 4) - len(o)) || ' more rows …'] ELSE CAST([] AS VARCHAR[]) END), chr(10)) END AS compressed, text FROM x),
p AS ({_prose("SELECT doc_id, text FROM d WHERE type = 'prose'", "doc_id", 0.5)}),
e AS (SELECT type, original_tokens AS a, compressed_tokens AS b FROM p UNION ALL SELECT type, {_tokens("text")}, {_tokens("compressed")} FROM t)
SELECT type, count(*) AS n, CAST(sum(a) AS BIGINT) AS tokens_in, CAST(sum(b) AS BIGINT) AS tokens_out, {_saved("sum(a)", "sum(b)")} AS saved FROM e GROUP BY type"""


def _logs(aggressive: bool) -> str:
    alarm = f"(regexp_matches(line, '{_ALARM}') OR regexp_matches(line, '{_STACK}'))"
    number = r"\b[0-9]+(\.[0-9]+)?\b"
    template = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '{_TIME}', '<ts>', 'g'), '{number}', '<n>', 'g'), '0x[0-9a-fA-F]+', '<hex>', 'g'), '(?i)\\b[0-9a-f]{{8,}}\\b', '<hash>', 'g')"
    general = f"regexp_replace(regexp_replace(line, '^[{_S}]*{_TIME}[{_S}]*', ''), '{number}', '#', 'g')"
    base = f"""WITH s AS ({EVENT_LOGS}),
l AS (SELECT user_id, line, pos FROM (SELECT user_id, regexp_split_to_array(text, '\\r?\\n') AS ls FROM s), unnest(ls) WITH ORDINALITY AS u(line, pos)),
k AS (SELECT *, {alarm} AS telling, regexp_matches(line, '[^{_S}]') AS filled FROM l)"""
    if aggressive:
        rest = """, c AS (SELECT user_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE telling) AS kept, count(*) FILTER (WHERE NOT telling AND filled) AS n FROM k GROUP BY user_id),
o AS (SELECT user_id, concat_ws(chr(10), kept, CASE WHEN n > 0 THEN '(' || n || ' routine log lines omitted)' END) AS compressed FROM c)"""
    else:
        rest = f""", g AS (SELECT user_id, min(pos) AS pos, CASE WHEN count(*) > 1 THEN count(*) || '× ' || arg_min({general}, pos) ELSE min(line) END AS line FROM k WHERE NOT telling AND filled GROUP BY user_id, {template}),
a AS (SELECT user_id, pos, line FROM k WHERE telling UNION ALL SELECT user_id, pos, line FROM g),
o AS (SELECT user_id, string_agg(line, chr(10) ORDER BY pos) AS compressed FROM a GROUP BY user_id)"""
    return f"{base}{rest} SELECT o.user_id, 'log' AS type, compressed, {_tokens('text')} AS original_tokens, {_tokens('compressed')} AS compressed_tokens FROM o JOIN s ON o.user_id = s.user_id"


def _templates() -> str:
    number = r"\b[0-9]+(\.[0-9]+)?\b"
    template = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '{_TIME}', '<ts>', 'g'), '{number}', '<n>', 'g'), '0x[0-9a-fA-F]+', '<hex>', 'g'), '(?i)\\b[0-9a-f]{{8,}}\\b', '<hash>', 'g')"
    return f"SELECT user_id, {template} AS template, count(*) AS n FROM (SELECT user_id, unnest(string_split(text, chr(10))) AS line FROM ({EVENT_LOGS})) GROUP BY ALL"


def _delimiters() -> str:
    marks = (("d1", "chr(9)"), ("d2", "'|'"), ("d3", "','"))
    counts = ", ".join(f"list_filter(list_transform(r, lambda x: length(x) - length(replace(x, {m}, ''))), lambda n: n > 0) AS {d}" for d, m in marks)
    fits = lambda d: f"len({d}) >= greatest(2, 0.6 * len(f)) AND len(list_filter({d}, lambda n: n = list_aggregate({d}, 'mode'))) >= 0.6 * len({d})"
    return f"""WITH c AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\r?\\n'), lambda x: regexp_matches(x, '[^{_S}]')) AS f FROM documents),
d AS (SELECT *, list_filter(f, lambda x: NOT regexp_matches(x, '^[{_S}|:.-]*-[{_S}|:.-]*$')) AS r FROM c), e AS (SELECT *, {counts} FROM d)
SELECT doc_id, CASE {" ".join(f"WHEN {fits(d)} THEN {m}" for d, m in marks)} ELSE 'none' END AS delimiter,
 CAST(CASE {" ".join(f"WHEN {fits(d)} THEN list_aggregate({d}, 'mode') + 1" for d, _ in marks)} ELSE 0 END AS INTEGER) AS n_columns FROM e"""


def _json(aggressive: bool) -> str:
    """Arrays of more than a sample and one: the sample, up to three odd items of the rest and a note."""
    sample = 0 if aggressive else 2
    similar = "'\"…(' || hidden || ' more similar items)\"'"
    note = f"CASE WHEN hidden > 0 THEN '\"…(' || hidden || '× {{event_id,event_type,value}})\"' ELSE {similar} END" if aggressive else similar
    item = lambda value: f"'{{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"value\":' || {value} || '}}'"
    whole = r"regexp_replace(CAST(value AS VARCHAR), '\.0$', '')"
    return f"""WITH i AS (SELECT user_id, event_id, {item("CAST(value AS VARCHAR)")} AS given, {item(whole)} AS item FROM events),
l AS (SELECT user_id, '[' || string_agg(given, ',' ORDER BY event_id) || ']' AS text, list(item ORDER BY event_id) AS items FROM i GROUP BY user_id),
o AS (SELECT *, list_filter(items[{sample + 1}:], lambda x: regexp_matches(x, '(?i)error|fail|exception|warn|null|missing|invalid'))[:3] AS odd FROM l),
h AS (SELECT *, len(items) - {sample} - len(odd) AS hidden FROM o),
c AS (SELECT user_id, text, '[' || array_to_string(CASE WHEN len(items) <= {sample + 1} THEN items ELSE list_concat(items[:{sample}], odd, [{note}]) END, ',') || ']' AS compressed FROM h)
SELECT user_id, 'json' AS type, compressed, {_tokens("text")} AS original_tokens, {_tokens("compressed")} AS compressed_tokens FROM c"""


def _json_counts() -> str:
    """Two items, up to three odd ones of the rest; arrays of three items or fewer are shown whole."""
    return """WITH i AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, regexp_matches(event_type, '(?i)error|fail|exception|warn|null|missing|invalid') AS odd FROM events),
c AS (SELECT user_id, count(*) AS n, least(3, count(*) FILTER (WHERE odd AND pos > 2)) AS extra FROM i GROUP BY user_id)
SELECT user_id, CASE WHEN n <= 3 THEN n ELSE 2 + extra END AS n_shown, CASE WHEN n <= 3 THEN 0 ELSE n - 2 - extra END AS n_hidden FROM c"""


def _tables(shown: int) -> str:
    odd = rf"(?i)\b(error|null|nan|none|missing|undefined|fail|failed|invalid|timeout)\b|,,|\|[{_S}]*\||^[{_S}]*,|,[{_S}]*$"
    return f"""WITH s AS ({CUSTOMER_TABLES}),
l AS (SELECT c_nationkey, line, pos - 1 AS pos FROM (SELECT c_nationkey, string_split(text, chr(10)) AS ls FROM s), unnest(ls) WITH ORDINALITY AS u(line, pos)),
n AS (SELECT c_nationkey, count(*) - 1 AS n FROM l GROUP BY c_nationkey),
a AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY pos) AS place FROM l WHERE pos > {shown} AND regexp_matches(line, '{odd}')),
k AS (SELECT c_nationkey, pos, line FROM l WHERE pos <= {shown} UNION ALL SELECT c_nationkey, pos, line FROM a WHERE place <= 3),
c AS (SELECT k.c_nationkey, string_agg(line, chr(10) ORDER BY pos) || CASE WHEN any_value(n.n) + 1 > count(*) THEN chr(10) || '… ' || (any_value(n.n) + 1 - count(*)) || ' more rows …' ELSE '' END AS compressed, any_value(n.n) AS n FROM k JOIN n ON k.c_nationkey = n.c_nationkey GROUP BY k.c_nationkey),
o AS (SELECT s.c_nationkey, text, CASE WHEN n < 2 THEN text ELSE compressed END AS compressed FROM s JOIN c ON s.c_nationkey = c.c_nationkey)
SELECT c_nationkey, 'table' AS type, compressed, {_tokens("text")} AS original_tokens, {_tokens("compressed")} AS compressed_tokens FROM o"""


def _traces() -> str:
    """Counts stand before the line that ends their run: library frames before any other line,
    passed tests before the next failure; what is left comes last, frames first."""
    n = "CAST(event_id AS VARCHAR)"
    line = f"CASE event_type WHEN 'error' THEN 'FAIL suite ' || {n} WHEN 'click' THEN '    at lib (node_modules/x/' || {n} || '.js:1:2)' WHEN 'signup' THEN '    at own (src/' || {n} || '.js:1:2)' ELSE 'PASS suite ' || {n} END"
    return f"""WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'news' WHEN 'click' THEN 'lib' WHEN 'signup' THEN 'own' ELSE 'pass' END AS kind, {line} AS line,
 row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events),
s AS (SELECT user_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM e GROUP BY user_id),
x AS (SELECT *, min(CASE WHEN kind <> 'lib' THEN pos END) OVER w AS next_line, min(CASE WHEN kind = 'news' THEN pos END) OVER w AS next_news FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
o AS (SELECT user_id, pos, 3 AS part, line FROM x WHERE kind IN ('news', 'own')
 UNION ALL SELECT user_id, coalesce(next_line, 1000000000), 1, '    … ' || count(*) || ' library frame' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || ' …' FROM x WHERE kind = 'lib' GROUP BY user_id, next_line
 UNION ALL SELECT user_id, coalesce(next_news, 1000000000), 2, '(' || count(*) || ' passing test' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || ')' FROM x WHERE kind = 'pass' GROUP BY user_id, next_news),
c AS (SELECT user_id, string_agg(line, chr(10) ORDER BY pos, part) AS compressed FROM o GROUP BY user_id)
SELECT s.user_id, 'trace' AS type, compressed, {_tokens("text")} AS original_tokens, {_tokens("compressed")} AS compressed_tokens FROM s JOIN c ON s.user_id = c.user_id"""


_SCHEDULE = f"""SELECT *, CASE WHEN position // {EVERY + 1} < greatest(0, (n - {KEEP}) // {EVERY + 1}) THEN CAST(position // {EVERY + 1} AS BIGINT) END AS block
 FROM (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS position, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"""


def _facts() -> str:
    signal = r"(?i)\b(want|need|prefer|must|should|decided|use|is|are|named|called|because|so that|goal)\b"
    return f"""WITH p AS ({_SCHEDULE}),
b AS (SELECT conv_id, block, string_agg(role || ': ' || text, chr(10) ORDER BY position) AS t, min(position) AS start, max(position) + 1 AS stop FROM p WHERE block IS NOT NULL GROUP BY conv_id, block),
y AS (SELECT conv_id, block, start, stop, {_trim("part")} AS x, pos FROM (SELECT *, string_split(regexp_replace(t, '([.!?])[{_S}]+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM b), unnest(parts) WITH ORDINALITY AS u(part, pos)),
z AS (SELECT *, count(*) OVER (PARTITION BY conv_id, block) AS n, row_number() OVER (PARTITION BY conv_id, block ORDER BY CASE WHEN regexp_matches(x, '{signal}') THEN 5 ELSE 0 END + least(length(x) / CAST(40 AS DOUBLE), 4) DESC, pos) AS place FROM y WHERE x <> ''),
f AS (SELECT *, {_trim(f"regexp_replace(x, '(?i)^(user|assistant)[{_S}]*:[{_S}]*', '')")} AS fact FROM z WHERE place <= greatest(1, ceil(n / 4.0)))
SELECT conv_id, block, start, stop, coalesce(string_agg(fact, chr(10) ORDER BY place) FILTER (WHERE fact <> ''), '') AS facts FROM f GROUP BY conv_id, block, start, stop"""


#: Texts ``fact`` of ``source`` in order ``i`` from 1 in each conversation, folded: ``keep`` and all words kept.
def _greedy_unlike(source: str) -> str:
    like = "len(list_intersect(k, w.ws)) > 0 AND CAST(len(list_intersect(k, w.ws)) AS DOUBLE) / (len(k) + len(w.ws) - len(list_intersect(k, w.ws))) >= CAST(0.8 AS DOUBLE)"
    return f"""l AS ({source}),
w AS (SELECT *, list_distinct(regexp_extract_all(lower(fact), '[a-z0-9_]+')) AS ws FROM l),
g AS (SELECT conv_id, i, fact, [ws] AS held, true AS keep FROM w WHERE i = 1
 UNION ALL SELECT conv_id, i, fact, CASE WHEN alike THEN held ELSE list_append(held, ws) END, NOT alike FROM (
 SELECT w.conv_id, w.i, w.fact, w.ws, g.held, len(list_filter(g.held, lambda k: {like})) > 0 AS alike FROM g JOIN w ON w.conv_id = g.conv_id AND w.i = g.i + 1))"""


_MEMORY_FACTS = "SELECT conv_id, fact, row_number() OVER (PARTITION BY conv_id ORDER BY block, pos) AS i FROM (SELECT conv_id, block, string_split(facts, chr(10)) AS fs FROM b WHERE facts <> ''), unnest(fs) WITH ORDINALITY AS u(fact, pos)"


def _memory() -> str:
    return f"""WITH RECURSIVE b AS ({_facts()}), {_greedy_unlike(_MEMORY_FACTS)},
k AS (SELECT conv_id, string_agg(fact, '|' ORDER BY i) AS facts FROM g WHERE keep GROUP BY conv_id)
SELECT p.conv_id, CAST(count(*) FILTER (WHERE block IS NULL) AS INTEGER) AS n_recent, coalesce(any_value(k.facts), '') AS facts, CAST(sum({_tokens("text")}) AS BIGINT) AS raw_tokens, count(*) AS ingested
FROM ({_SCHEDULE}) p LEFT JOIN k ON k.conv_id = p.conv_id GROUP BY p.conv_id"""


def _context(budget: int, system: str = "", query: str = "") -> str:
    """With a query, facts are taken in the order of their likeness to it."""
    own = -(-len(system) // 4)
    fold = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(word, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
    dims = f"CAST((CASE WHEN {fold} < 2147483648 THEN {fold} ELSE 4294967296 - {fold} END) % 64 AS INTEGER)"
    hashed = f"""SELECT conv_id, i, {dims} AS dim, count(*) AS n FROM (SELECT conv_id, i, unnest(regexp_extract_all(lower(fact), '[a-z0-9_]+')) AS word FROM g WHERE keep) GROUP BY ALL"""
    asked = f"SELECT {dims} AS dim, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower('{query}'), '[a-z0-9_]+')) AS word) GROUP BY ALL"
    like = f"""SELECT h.conv_id, h.i, sum(h.n * coalesce(q.n, 0)) / (sqrt(sum(h.n * h.n)) * (SELECT sqrt(sum(n * n)) FROM ({asked}))) AS score FROM ({hashed}) h LEFT JOIN ({asked}) q ON q.dim = h.dim GROUP BY h.conv_id, h.i"""
    likes = like if query else "SELECT conv_id, i, 0 AS score FROM g"
    return f"""WITH RECURSIVE b AS ({_facts()}), {_greedy_unlike(_MEMORY_FACTS)},
s AS ({_SCHEDULE}),
m AS (SELECT conv_id, role, text, {_tokens("text")} AS cost, position, row_number() OVER (PARTITION BY conv_id ORDER BY position DESC) AS j FROM s WHERE block IS NULL),
r AS (SELECT conv_id, CAST(0 AS BIGINT) AS j, CAST({budget - own} AS BIGINT) AS room FROM (SELECT DISTINCT conv_id FROM s)
 UNION ALL SELECT r.conv_id, r.j + 1, CASE WHEN cost <= room THEN room - cost ELSE room END FROM r JOIN m ON m.conv_id = r.conv_id AND m.j = r.j + 1),
t AS (SELECT m.*, old.room AS room FROM m JOIN r old ON old.conv_id = m.conv_id AND old.j = m.j - 1 WHERE cost <= old.room),
e AS (SELECT conv_id, min(room) AS room FROM r GROUP BY conv_id),
v AS ({likes}),
n AS (SELECT g.conv_id, fact, {_tokens("fact")} + 2 AS cost, row_number() OVER (PARTITION BY g.conv_id ORDER BY coalesce(score, 0) DESC, g.i) AS i FROM g LEFT JOIN v ON v.conv_id = g.conv_id AND v.i = g.i WHERE keep),
f AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, room, CAST([] AS VARCHAR[]) AS taken FROM e
 UNION ALL SELECT f.conv_id, f.i + 1, CASE WHEN cost <= room THEN room - cost ELSE room END, CASE WHEN cost <= room THEN list_append(taken, fact) ELSE taken END FROM f JOIN n ON n.conv_id = f.conv_id AND n.i = f.i + 1),
z AS (SELECT conv_id, arg_max(taken, i) AS taken FROM f GROUP BY conv_id),
y AS (SELECT conv_id, taken, 'Relevant memory:' || chr(10) || '- ' || array_to_string(taken, chr(10) || '- ') AS block FROM z),
c AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY position) AS talk, sum(cost) AS cost, count(*) AS n FROM t GROUP BY conv_id),
a AS (SELECT conv_id, sum({_tokens("text")}) AS raw_tokens, count(*) FILTER (WHERE block IS NULL) AS raw_messages FROM s GROUP BY conv_id),
o AS (SELECT y.conv_id, concat_ws(chr(10), CASE WHEN len(taken) > 0 THEN 'system: ' || y.block END, {f"'system: {system}'" if system else "NULL"}, talk) AS messages, CAST(raw_tokens AS BIGINT) AS raw_tokens,
 CAST({own} + coalesce(c.cost, 0) + CASE WHEN len(taken) > 0 THEN {_tokens("y.block")} ELSE 0 END AS BIGINT) AS packed_tokens, CAST(raw_messages AS INTEGER) AS raw_messages,
 CAST({int(bool(system))} + coalesce(c.n, 0) + CASE WHEN len(taken) > 0 THEN 1 ELSE 0 END AS INTEGER) AS packed_messages, CAST(len(taken) AS INTEGER) AS memories_used FROM y JOIN a ON a.conv_id = y.conv_id LEFT JOIN c ON c.conv_id = y.conv_id)
SELECT *, CASE WHEN packed_tokens > 0 THEN floor(raw_tokens / CAST(packed_tokens AS DOUBLE) * 100 + 0.5) / 100 ELSE 1 END AS ratio FROM o"""


def _complete() -> str:
    signal = r"(?i)\b(want|need|prefer|must|should|decided|use|is|are|named|called|because|so that|goal)\b"
    return f"""WITH b AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '(?s)^.*---', '') AS t FROM conversations),
y AS (SELECT conv_id, turn, {_trim("part")} AS x, pos FROM (SELECT *, string_split(regexp_replace(t, '([.!?])[{_S}]+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM b), unnest(parts) WITH ORDINALITY AS u(part, pos)),
z AS (SELECT *, count(*) OVER (PARTITION BY conv_id, turn) AS n, row_number() OVER (PARTITION BY conv_id, turn ORDER BY CASE WHEN regexp_matches(x, '{signal}') THEN 5 ELSE 0 END + least(length(x) / CAST(40 AS DOUBLE), 4) DESC, pos) AS place FROM y WHERE x <> ''),
f AS (SELECT conv_id, turn, string_agg('- ' || regexp_replace(x, '(?i)^(user|assistant)[{_S}]*:[{_S}]*', ''), chr(10) ORDER BY place) AS completion FROM z WHERE place <= greatest(1, ceil(n / 4.0)) GROUP BY conv_id, turn)
SELECT b.conv_id, b.turn, coalesce(completion, '') AS completion FROM b LEFT JOIN f ON f.conv_id = b.conv_id AND f.turn = b.turn"""


def _recent(budget: int) -> str:
    return f"""WITH RECURSIVE m AS (SELECT conv_id, {_tokens("text")} AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM conversations),
f AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST({budget} AS BIGINT) AS room, 0 AS taken FROM (SELECT DISTINCT conv_id FROM m)
 UNION ALL SELECT f.conv_id, f.i + 1, CASE WHEN cost <= room THEN room - cost ELSE room END, taken + CASE WHEN cost <= room THEN 1 ELSE 0 END FROM f JOIN m ON m.conv_id = f.conv_id AND m.i = f.i + 1),
t AS (SELECT conv_id, CAST(sum(cost) AS BIGINT) AS raw_tokens, CAST(count(*) AS INTEGER) AS raw_messages FROM m GROUP BY conv_id)
SELECT t.conv_id, raw_tokens, {budget} - room AS packed_tokens, CASE WHEN room < {budget} THEN floor(raw_tokens / CAST({budget} - room AS DOUBLE) * 100 + 0.5) / 100 ELSE 1 END AS ratio, raw_messages, taken AS packed_messages
FROM t JOIN f ON f.conv_id = t.conv_id AND f.i = t.raw_messages"""


def _embed() -> str:
    fold = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(word, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
    return f"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM conversations),
h AS (SELECT conv_id, turn, {fold} AS h FROM w),
b AS (SELECT conv_id, turn, CAST((CASE WHEN h < 2147483648 THEN h ELSE 4294967296 - h END) % 64 AS INTEGER) AS dim, count(*) AS n FROM h GROUP BY ALL)
SELECT conv_id, turn, dim, CAST(floor(n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, turn)) * 1e6 + 0.5) AS BIGINT) AS x FROM b"""


def _aggressive_code(text: str) -> str:
    for pattern, by in [("/\\*[\\s\\S]*?\\*/", ""), ("([^:\"''`])//[^\\n]*", "\\1"), (f"(?m)^[{_S}]*#[^\\n]*$", ""), ("(?m)[ \\t]+$", ""), (f"(?m)^[{_S}]*\\n", "")]:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    half = "repeat(' ', CAST(ceil((length(x) - length(ltrim(x, ' ' || chr(9)))) / 2.0) AS INTEGER)) || ltrim(x, ' ' || chr(9))"
    return _trim(f"array_to_string(list_transform(string_split({text}, chr(10)), lambda x: {half}), chr(10))")


def _code(text: str) -> str:
    steps = [("/\\*[\\s\\S]*?\\*/", ""), ("([^:\"''`])//[^\\n]*", "\\1"), (f"(?m)^[{_S}]*#[^\\n]*$", ""), ("(?m)[ \\t]+$", ""), ("\\n{3,}", "\n\n"), (f"^[{_S}]+|[{_S}]+$", "")]
    for pattern, by in steps:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


_HANDLE = "'ccr_' || lower(CASE WHEN k = 0 THEN '0' ELSE ltrim(" + " || ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(k // {36**p} % 36 AS INTEGER) + 1, 1)" for p in range(6, -1, -1)) + ", '0') END)"
_V = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1] * p[2]))"


def _top(score: str, k: int) -> str:
    """The best vectors of every hundredth one; ``score`` reads q.v and e.v."""
    return f"""WITH e AS (SELECT vec_id, {_V} AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, {score} AS score FROM e q, e WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, CAST(floor(score * 1e6 + 0.5) AS BIGINT) AS score FROM r WHERE rank <= {k}"""


_COSINE = _DOT.format("q.v", "e.v") + " / (sqrt(" + _DOT.format("q.v", "q.v") + ") * sqrt(" + _DOT.format("e.v", "e.v") + "))"
_INT8 = "list_transform({0}, lambda x: floor(greatest(-1, least(1, x)) * 127 + 0.5))"
_SIGNS = "list_transform({0}, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END)"
_AGREE = "len(list_filter(list_zip(" + _SIGNS.format("q.v") + ", " + _SIGNS.format("e.v") + "), lambda p: p[1] = p[2])) / 64.0"
_SCORES = f"""WITH e AS (SELECT vec_id, label, {_V} AS v FROM embeddings), f AS (SELECT label, arg_min(v, vec_id) AS q FROM e GROUP BY label),
s AS (SELECT e.label, vec_id, {_DOT.format("f.q", "e.v")} AS score FROM e JOIN f ON e.label = f.label)"""


def _rerank(score: str, shortlist: int, k: int) -> str:
    return f"""WITH e AS (SELECT vec_id, {_V} AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, {score} AS approx, {_COSINE} AS score FROM e q, e WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY approx DESC, vec_id) AS place FROM s),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS INTEGER) AS rank FROM r WHERE place <= {shortlist})
SELECT query_id, rank, vec_id, CAST(floor(score * 1e6 + 0.5) AS BIGINT) AS score FROM t WHERE rank <= {k}"""


_INT8_SCORE = _DOT.format("q.v", "list_transform(" + _INT8.format("e.v") + ", lambda y: y / 127)")
#: Scores of every label's vectors against its first, exact and with 8-bit codes, and the codes' values.
_ATTENTION = f"""WITH e AS (SELECT vec_id, label, {_V} AS v FROM embeddings), f AS (SELECT label, arg_min(v, vec_id) AS q FROM e GROUP BY label),
c AS (SELECT e.label, vec_id, v, list_transform({_INT8.format("v")}, lambda y: CAST(y AS DOUBLE) / 127) AS u, f.q FROM e JOIN f ON e.label = f.label),
s AS (SELECT label, vec_id, v, u, {_DOT.format("q", "v")} AS a, {_DOT.format("q", "u")} AS b FROM c),
w AS (SELECT label, v, u, exp(a) / sum(exp(a)) OVER (PARTITION BY label) AS p, exp(b) / sum(exp(b)) OVER (PARTITION BY label) AS r FROM s),
o AS (SELECT label, CAST(dim - 1 AS INTEGER) AS dim, sum(p * x) AS x, sum(r * u[dim]) AS y FROM (SELECT label, p, r, u, x, dim FROM w, unnest(v) WITH ORDINALITY AS t(x, dim)) GROUP BY label, dim)"""


def _parts_sql() -> str:
    """``query_id, vec_id, place`` for the exact and two approximate scores."""
    every = ", ".join(f"row_number() OVER (PARTITION BY query_id ORDER BY s_{c} DESC, vec_id) AS r_{c}" for c in ("exact", "int8", "binary"))
    shares = " UNION ALL ".join(f"SELECT '{c}' AS quantizer, CAST(floor(avg(hits) * 1e5 + 0.5) AS BIGINT) AS recall FROM (SELECT query_id, count(*) FILTER (WHERE r_{c} <= 10) AS hits FROM r WHERE r_exact <= 10 GROUP BY query_id)" for c in ("int8", "binary"))
    return f"""WITH e AS (SELECT vec_id, {_V} AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, {_COSINE} AS s_exact, {_INT8_SCORE} AS s_int8, {_AGREE} AS s_binary FROM e q, e WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, vec_id, {every} FROM s) {shares}"""


def oracle_sql() -> dict[str, str]:
    docs_type = _detect("documents", "doc_id", "text")
    size = EVERY + 1
    every = " UNION ALL ".join(f"SELECT '{t}' AS table_name, type FROM {_detect(t, k, c)}" for t, k, c in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text")))
    return {
        "tokens_by_lang": f"SELECT lang, count(*) AS n, CAST(sum({_tokens('text')}) AS BIGINT) AS tokens FROM documents GROUP BY lang",
        "detect_type_docs": f"SELECT doc_id, type FROM {docs_type}",
        "detect_type_counts": f"SELECT table_name, type, count(*) AS n FROM ({every}) GROUP BY ALL",
        "prose_prune_safe": _prose("SELECT doc_id, text FROM documents", "doc_id", 0.5),
        "prose_prune_aggr": _prose("SELECT conv_id || '-' || turn AS id, text FROM conversations", "id", 0.3),
        "log_compress_safe": _logs(False),
        "log_compress_aggr": _logs(True),
        "table_compress_safe": _tables(3),
        "table_compress_aggr": _tables(1),
        "trace_compress_safe": _traces(),
        "hash_embed": _embed(),
        "distill_facts": _facts(),
        "pack_recent": _recent(100),
        "code_compress": f"SELECT page_id, 'code' AS type, compressed, {_tokens('html')} AS original_tokens, {_tokens('compressed')} AS compressed_tokens FROM (SELECT page_id, html, {_code('html')} AS compressed FROM pages)",
        "ccr_roundtrip": f"SELECT doc_id, {_HANDLE} AS handle, md5(text) AS digest, CAST(length(text) AS INTEGER) AS length FROM (SELECT *, doc_id AS k FROM documents)",
        "ccr_retrieve_all": f"WITH p AS (SELECT doc_id, doc_id AS k FROM documents UNION ALL SELECT doc_id, doc_id + 1 FROM documents) SELECT p.doc_id, {_HANDLE} AS handle, md5(d.text) AS digest FROM p JOIN documents d ON d.doc_id = p.k",
        "retrieve_truncated": f"SELECT p.doc_id, {_HANDLE} AS handle, coalesce(CAST(length(d.text) AS INTEGER), -1) AS length, coalesce(length(d.text) > 2000, false) AS truncated, coalesce(CAST(CASE WHEN length(d.text) > 2000 THEN length(substr(d.text, 1, 2000) || chr(10) || '… truncated, ' || length(d.text) || ' characters in all') ELSE length(d.text) END AS INTEGER), -1) AS returned FROM (SELECT doc_id, doc_id + 1 AS k FROM documents) p LEFT JOIN documents d ON d.doc_id = p.k",
        "session_stats": f"WITH c AS (SELECT {_tokens('x')} AS a, {_tokens(_code('x'))} AS b FROM (SELECT coalesce(text, '') AS x FROM documents)), t AS (SELECT count(*) AS calls, CAST(sum(a) AS BIGINT) AS tokens_in, CAST(sum(b) AS BIGINT) AS tokens_out FROM c) SELECT *, tokens_in - tokens_out AS tokens_saved, {_saved('tokens_in', 'tokens_out')} AS saved, (SELECT count(*) FROM documents) AS stored FROM t",
        "memory_flush_schedule": f"WITH p AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS position, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, position, CASE WHEN position // {size} < greatest(0, (n - {KEEP}) // {size}) THEN CAST(position // {size} AS BIGINT) ELSE -1 END AS block FROM p",
        "memory_state": _memory(),
        "memory_in_parts": _memory(),
        "stream_ingest": _memory(),
        "pack_context": _context(120, "Answer briefly."),
        "pack_ranked": _context(120, query="What must the next release use?"),
        "route_and_report": _routes(),
        "offline_complete": _complete(),
        "dedupe_facts": f"WITH RECURSIVE {_greedy_unlike('SELECT conv_id, turn, text AS fact, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations')} SELECT l.conv_id, l.turn FROM g JOIN l ON l.conv_id = g.conv_id AND l.i = g.i WHERE keep",
        "trace_compress_aggr": _traces(),
        "code_compress_aggr": f"SELECT page_id, 'code' AS type, compressed, {_tokens('html')} AS original_tokens, {_tokens('compressed')} AS compressed_tokens FROM (SELECT page_id, html, {_aggressive_code('html')} AS compressed FROM pages)",
        "log_templates": _templates(),
        "pick_delimiter": _delimiters(),
        "signal_recall": "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n_markers, count(*) FILTER (WHERE event_type = 'error') AS n_surviving FROM events GROUP BY user_id",
        "json_counts": _json_counts(),
        "json_compress_safe": _json(False),
        "json_compress_aggr": _json(True),
        "stream_stats": f"SELECT count(*) AS calls, CAST(sum({_tokens('text')}) AS BIGINT) AS tokens_in, CAST(sum({_tokens(_code('text'))}) AS BIGINT) AS tokens_out FROM conversations",
        "rerank_binary": _rerank(_AGREE, 64, 10),
        "recall_int8_binary": _parts_sql(),
        "attention_output": f"{_ATTENTION} SELECT label, dim, CAST(floor(x * 1e6 + 0.5) AS BIGINT) AS x FROM o",
        "attention_error": f"{_ATTENTION} SELECT label, CAST(floor(sqrt(sum((y - x) * (y - x))) / sqrt(sum(x * x)) * 1e6 + 0.5) AS BIGINT) AS error, CAST(floor(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) * 1e6 + 0.5) AS BIGINT) AS cosine FROM o GROUP BY label",
        "cosine_topk": _top(_COSINE, 5),
        "int8_encode": f"SELECT vec_id, array_to_string(list_transform({_INT8.format(_V)}, lambda x: CAST(x AS INTEGER)), ',') AS codes FROM embeddings",
        "binary_encode": f"SELECT vec_id, array_to_string({_SIGNS.format(_V)}, '') AS bits FROM embeddings",
        "int8_topk": _top(_DOT.format("q.v", "list_transform(" + _INT8.format("e.v") + ", lambda y: y / 127)"), 10),
        "binary_topk": _top(_AGREE, 10),
        "attention_softmax": f"{_SCORES} SELECT label, vec_id, CAST(floor(exp(score - max(score) OVER w) / sum(exp(score - m)) OVER w * 1e6 + 0.5) AS BIGINT) AS p FROM (SELECT *, max(score) OVER (PARTITION BY label) AS m FROM s) WINDOW w AS (PARTITION BY label)",
        "kl_divergence": f"{_SCORES}, t AS (SELECT label, exp(score) / sum(exp(score)) OVER w AS p, exp(floor(score * 10 + 0.5) / 10) / sum(exp(floor(score * 10 + 0.5) / 10)) OVER w AS q FROM s WINDOW w AS (PARTITION BY label)) SELECT label, CAST(floor(sum(p * ln(p / greatest(q, 1e-12))) * 1e6 + 0.5) AS BIGINT) AS kl FROM t GROUP BY label",
    }
