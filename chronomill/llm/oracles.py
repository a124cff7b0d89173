"""SQL for the queries that it can express, written on its own, without hashes or buckets."""

from __future__ import annotations

from .licenses import BASE, templates
from .mixing import BITS, LEAST_SLOTS

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _phrase(phrase: str, label: str) -> str:
    test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
    return f"SELECT r, i - 1 AS start, '{label}' AS label FROM p WHERE {test}"


def _pairs() -> str:
    rows = []
    for label, w in templates():
        rows += [f"('{label}', {len(w) - 1}, {min(8, max(1, len(w) // 4))}, {j}, '{a}', '{b}')" for j, (a, b) in enumerate(zip(w, w[1:]))]
    return ", ".join(rows)


OP1 = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
base AS ({" UNION ALL ".join(_phrase(*x) for x in BASE.items())}),
t(label, pairs, drift, j, a, b) AS (VALUES {_pairs()}),
votes AS (SELECT DISTINCT p.r, t.label, t.pairs, t.drift, p.i - 1 - t.j AS diagonal, t.j FROM p JOIN t ON w[i] = t.a AND w[i + 1] = t.b),
enough AS (SELECT r, label FROM votes GROUP BY r, label, pairs HAVING count(DISTINCT j) >= 0.75 * pairs),
starts AS (SELECT DISTINCT r, label, diagonal FROM votes SEMI JOIN enough USING (r, label)),
held AS (SELECT s.r, s.label, s.diagonal, any_value(v.pairs) AS pairs, count(DISTINCT v.j) AS n, list([-v.j] ORDER BY v.diagonal + v.j, -v.j) AS js
         FROM starts s JOIN votes v ON v.r = s.r AND v.label = s.label AND v.diagonal BETWEEN s.diagonal AND s.diagonal + v.drift GROUP BY s.r, s.label, s.diagonal),
found AS (SELECT r, label, len(list_reduce(list_concat([CAST([] AS BIGINT[])], js), lambda a, x: list_concat(list_concat(list_filter(a, lambda y: y < -x[1]), [-x[1]]), a[len(list_filter(a, lambda y: y < -x[1])) + 2:]))) / CAST(pairs AS DOUBLE) AS coverage
          FROM held WHERE n >= 0.75 * pairs),
kept AS (SELECT * FROM found WHERE coverage >= 0.75),
b AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM (SELECT r, label, 1.0::DOUBLE AS coverage FROM base UNION ALL SELECT * FROM kept) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN b ON b.r = d.r LEFT JOIN every e ON e.r = d.r"""

OP2 = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, len(regexp_extract_all(text, '[<\[]\\*(?:/?s>|\|[A-Za-z0-9_]+\|>|</?SYS>>|/?INST\])')) AS escapes, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text) AS l, CAST(sum(12 + length(role) + 1 + length(text) + escapes + 10 + 1) AS BIGINT) AS formatted_chars FROM n GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(l) AS BIGINT) AS loss_chars, sha256(l) AS loss_sha256, formatted_chars FROM g"""

_ESCAPED = r"regexp_replace({}, '([<\[]\\*)(/?s>|\|[A-Za-z0-9_]+\|>|</?SYS>>|/?INST\])', '\1\\\2', 'g')"

PARTS = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, greatest(instr(coalesce(text, ''), ' ') - 1, 0) AS cut,
['image', 'audio', 'document', 'im_end'][CAST(turn % 4 AS INTEGER) + 1] AS kind FROM conversations),
p AS (SELECT *, {_ESCAPED.format("substr(text, 1, CAST(cut AS BIGINT))")} || CASE kind WHEN 'im_end' THEN '<|attachment|>' ELSE '<|' || kind || '|>' END || {_ESCAPED.format("substr(text, CAST(cut AS BIGINT) + 1)")} AS body FROM c),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, body) - 1 AS message FROM p)
SELECT conv_id, sha256(string_agg('<|im_start|>' || role || chr(10) || body || '<|im_end|>' || chr(10), '' ORDER BY message)) AS formatted_sha256, count(*) AS n_attachments,
string_agg(message || ':1:' || kind || ':' || conv_id || '/' || turn, ',' ORDER BY message) AS refs, CAST(sum(length(text)) AS BIGINT) AS expanded_tokens FROM m GROUP BY conv_id"""

OP3 = r"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, CAST(n AS DOUBLE) * 2 AS cap, CAST(sum(n) OVER () AS DOUBLE) * 1.5::DOUBLE AS total FROM s),
f AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, CAST(n AS BIGINT) AS source_size, CASE WHEN cap / weight <= level THEN cap ELSE weight * first_value(level) OVER (ORDER BY cap / weight <= level, cap / weight, k) END AS target FROM f),
k AS (SELECT *, CAST(round(target) AS BIGINT) AS goal, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM t),
c AS (SELECT *, CAST(sum(goal) OVER (ORDER BY no) AS BIGINT) - goal AS before, CAST(sum(goal) OVER () AS BIGINT) AS words FROM k),
l AS (SELECT *, list_filter(range(BITS, 63), lambda b: CAST(goal AS HUGEINT) * (CAST(1 AS HUGEINT) << b) >= LEAST * words OR (CAST(1 AS HUGEINT) << b) >= words)[1] AS level FROM c WHERE goal > 0),
g AS (SELECT *, CAST(1 AS HUGEINT) << level AS n FROM l),
p AS (SELECT no, words, level, n, unnest(range(CAST((before * n + words - 1) // words AS BIGINT), CAST(((before + goal) * n + words - 1) // words AS BIGINT))) AS point FROM g),
q AS (SELECT *, CAST(list_sum(list_transform(range(level), lambda i: ((point >> i) & 1) << (level - 1 - i))) AS BIGINT) AS fine FROM p),
r AS (SELECT no, fine >> (level - BITS) AS slot, row_number() OVER (PARTITION BY no ORDER BY fine) - 1 AS rank, words, n FROM q),
b AS (SELECT no, slot, CAST(rank * words // n AS BIGINT) AS first, CAST((rank + 1) * words // n AS BIGINT) AS stop FROM r),
o AS (SELECT d.*, c.no, c.source_size, c.target, row_number() OVER () AS i, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY size = 0, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
      FROM d JOIN c ON c.source IS NOT DISTINCT FROM d.source),
e AS (SELECT o.*, epoch * source_size + place AS lo, epoch * source_size + place + size AS hi FROM o, range(2) AS y(epoch)),
m AS (SELECT i, sum(least(hi, stop) - greatest(lo, first)) AS taken, min(slot) AS first_slot, max(slot) AS last_slot FROM e JOIN b ON b.no = e.no AND b.first < e.hi AND b.stop > e.lo WHERE least(hi, stop) > greatest(lo, first) GROUP BY i)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, first_slot, last_slot FROM o LEFT JOIN m USING (i)""".replace("LEAST ", f"{LEAST_SLOTS} ").replace("BITS", str(BITS))

OP4 = """WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x) AS score FROM v q JOIN v ON len(v.x) = len(q.x) AND v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""

# Forward over rows, all cheapest (state, cost, audit) per step; audits are compared as strings.
OP13 = r"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT *, CAST(xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::UBIGINT)),
  lambda h, b: list_reduce(list_concat([xor(h, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % 20 AS INTEGER) AS d FROM k),
m AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE d <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS z FROM o),
f AS (SELECT *, CASE WHEN z = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN z NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
g AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
moves(was, now, ins) AS (VALUES ('', 'u', ''), ('', 'a', 'user'), ('', 's', ''), ('s', 'u', ''), ('s', 'a', 'user'), ('u', 'u', 'assistant'), ('u', 'a', ''), ('a', 'u', ''), ('a', 'a', 'user')),
edits AS (SELECT conv_id, i, was, was AS now, 4 AS price, 'D' AS letters, '' AS lines FROM f, (VALUES (''), ('s'), ('u'), ('a')) AS s(was)
  UNION ALL SELECT conv_id, i, was, now, CASE WHEN substr(role, 1, 1) = now THEN 0 ELSE 3 END + CASE WHEN ins = '' THEN 0 ELSE 3 END + CASE WHEN fault = 't' THEN 3 ELSE 0 END, CASE WHEN ins = '' THEN '' ELSE 'I' END || CASE WHEN substr(role, 1, 1) = now THEN 'K' ELSE 'R' END,
  CASE WHEN ins = '' THEN '' ELSE ins || ':' || chr(10) END || CASE WHEN substr(role, 1, 1) = now THEN role WHEN now = 'u' THEN 'user' ELSE 'assistant' END || ':' || text || chr(10) FROM f, moves WHERE fault NOT IN ('b', 'd') AND (now <> 's' OR substr(role, 1, 1) = 's')),
p AS (SELECT conv_id, 0::BIGINT AS i, '' AS state, 0 AS cost, '' AS audit, '' AS lines FROM g
  UNION ALL SELECT conv_id, i, state, cost, audit, lines FROM (SELECT p.conv_id, e.i, e.now AS state, p.cost + e.price AS cost, p.audit || e.letters AS audit, p.lines || e.lines AS lines,
    row_number() OVER (PARTITION BY p.conv_id, e.now ORDER BY p.cost + e.price, p.audit || e.letters) AS place FROM p JOIN edits e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.i = p.i + 1 AND e.was = p.state) AS x WHERE place = 1),
e AS (SELECT p.conv_id, cost + price AS cost, audit || letters AS audit, p.lines || z.lines AS lines FROM p JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.n = p.i JOIN (VALUES ('', 0, '', ''), ('a', 0, '', ''), ('u', 3, 'I', 'assistant:' || chr(10)), ('s', 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))) AS z(state, price, letters, lines) ON z.state = p.state),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS place FROM e) AS x WHERE place = 1)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(CASE WHEN coalesce(lines, '') = '' THEN '' ELSE left(lines, length(lines) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id"""

SQL = {"op13_conversation_repair": OP13, "op1_license_scan": OP1, "op2_chat_format": OP2, "chat_typed_parts": PARTS, "op3_source_mix": OP3, "op4_nearest_neighbours": OP4}
