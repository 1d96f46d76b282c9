"""The registered queries of the operators and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from severa.llm import chat, decontaminate, langid, mixing, pii, quality, simhash, tokens, urls, warc
from severa.llm.common import table


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fingerprint").alias("fingerprint"), "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(*warc.archive(table(spark, sf_dir, "pages"))).drop("payload")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("score")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(table(spark, sf_dir, "conversations")).withColumn("faults", F.array_join("faults", "; "))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash, op2_mixing, op3_language, op4_warc, op5_urls, op6_pii, op7_quality, op8_chat, op9_tokens, op10_decontamination)}


OP10 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP4 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
m AS (SELECT b, max(page_id) AS top, count(*) AS n FROM p WHERE octet_length(b) >= 1000 GROUP BY b)
SELECT p.page_id, CAST(octet_length(p.b) AS BIGINT) AS payload_bytes, sha1(p.b) AS payload_digest,
       CASE WHEN n > 1 AND top IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND top IS DISTINCT FROM page_id THEN top END AS refers_to
FROM p LEFT JOIN m ON p.b = m.b
"""


OP2 = r"""
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS drawn
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM s GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM src),
weighed AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS w FROM ranked),
step AS (
  SELECT *, sum(ss) OVER () AS total, sum(w) OVER () AS ws,
    coalesce(sum(ss) OVER (ORDER BY ss / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_size,
    coalesce(sum(w) OVER (ORDER BY ss / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_weight
  FROM weighed),
each_ AS (SELECT *, CAST(total - 3 * full_size AS DOUBLE) / CAST(ws - full_weight AS DOUBLE) AS each FROM step),
lvl AS (SELECT each AS level FROM each_ WHERE each * w <= 3 * ss ORDER BY ss / w, rank LIMIT 1),
t AS (
  SELECT source, ss, rank, coalesce(least(level * w, CAST(3 * ss AS DOUBLE)), 0.0) AS target,
    CAST('0x' || substr(md5('mix:source:' || coalesce(source, 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM each_ LEFT JOIN lvl ON true),
placed AS (
  SELECT s.doc_id, s.size, t.ss, t.target, t.u, CASE WHEN t.ss > 0 THEN t.target / CAST(t.ss AS DOUBLE) ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY t.rank ORDER BY CASE WHEN s.size < 16 THEN s.size ELSE length(bin(s.size)) * 8 + (s.size >> CAST(length(bin(s.size)) - 4 AS BIGINT)) % 8 END, s.drawn) AS place
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, ss AS source_size, target,
  size * CAST(floor(rate * CAST(place AS DOUBLE) + u) - floor(rate * CAST(place - 1 AS DOUBLE) + u) AS BIGINT) AS taken
FROM placed
"""


_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
)
OP6 = (
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS id FROM documents), m AS ("
    + " UNION ALL ".join(f"SELECT id, t, '{kind}' AS kind, {i} AS ord, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS ps FROM t" for i, (kind, p) in enumerate(_KINDS))
    + r"""),
x AS (
  SELECT id, t, kind, ord, ms[i] AS x, CAST(list_sum([length(p) for p in ps[1:i]]) + coalesce(list_sum([length(y) for y in ms[1:i - 1]]), 0) AS BIGINT) AS st
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0)),
d AS (SELECT *, st + length(x) AS en, regexp_replace(x, '[^0-9]', '', 'g') AS digits, CASE WHEN st > 0 THEN substr(t, st, 1) ELSE '' END AS before, substr(t, st + length(x) + 1, 1) AS after,
    lower(substr(t, greatest(st - 40, 0) + 1, st - greatest(st - 40, 0)) || ' ' || substr(t, st + length(x) + 1, 40)) AS near FROM x),
ok AS (SELECT * FROM d WHERE CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN NOT list_contains([length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(substr(ltrim(p, '0'), 1, 3) AS INT), 0) <= 255 for p in string_split(x, '.')], false)
  WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND list_sum([
    CASE WHEN (length(digits) - k) % 2 = 0 THEN CAST(substr(digits, k, 1) AS INT) WHEN CAST(substr(digits, k, 1) AS INT) > 4 THEN CAST(substr(digits, k, 1) AS INT) * 2 - 9 ELSE CAST(substr(digits, k, 1) AS INT) * 2 END
    for k in range(1, length(digits) + 1)]) % 10 = 0
  WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
  WHEN 'iban' THEN NOT regexp_matches(before || after, '[A-Za-z0-9]') AND list_reduce([CAST(CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END AS BIGINT) for c in string_split(substr(x, 5) || substr(x, 1, 4), '')],
    lambda a, v: (a * (CASE WHEN v > 9 THEN 100 ELSE 10 END) + v) % 97) = 1
  ELSE NOT regexp_matches(before || after, '[0-9-]') AND regexp_matches(near, '(?:^|[^a-z])(?:ssn|social security|tax id)') END),
g AS (
  SELECT id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, ord) FILTER (ord < 4) AS base, string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, ord) AS spans
  FROM ok GROUP BY id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (id)
"""
)


#: The tables hold no explicit tool calls, so these are messages, and requests with their replies.
OP8 = """
SELECT conv_id, turn, 'message' AS kind, NULL::VARCHAR AS call, true AS linked, 0 AS level, false AS cyclic, '' AS faults, CAST(to_json({'content': text, 'role': role}) AS VARCHAR) AS json FROM conversations
UNION ALL
SELECT conv_id, turn, 'call', 'turn:' || turn, EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = c.conv_id AND a.role = 'assistant' AND a.turn = c.turn + 1), 0, false, '',
       CAST(to_json({'arguments': CAST(to_json({'prompt': text}) AS VARCHAR), 'id': 'turn:' || turn, 'name': 'reply'}) AS VARCHAR) FROM conversations c WHERE role = 'user'
UNION ALL
SELECT conv_id, turn, 'result', 'turn:' || (turn - 1), EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = c.conv_id AND a.role = 'user' AND a.turn = c.turn - 1),
       CASE WHEN EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = c.conv_id AND a.role = 'user' AND a.turn = c.turn - 1) THEN 0 END, false, '',
       CAST(to_json({'content': text, 'tool_call_id': 'turn:' || (turn - 1)}) AS VARCHAR) FROM conversations c WHERE role = 'assistant'
"""


_HOST, _PATH = (f"translate(regexp_extract({{0}}, '^.*?://([^/?#]*)([^?#]*)', {k}, 's'), {{1}})" for k in (1, 2))
_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_LONGEST = sorted(((r, v, *r.partition("/")) for v, r in RULES), key=lambda x: (-len(x[0]), x))
_RULE = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{r}'" for r, _, h, _, p in _LONGEST) + " END"
_SAYS = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v, *_ in _LONGEST) + " END"
_NODE = "regexp_replace(host, '^.*@|:[0-9]*$', '', 'gs')"
#: The walk's mass, step by step, adds up to the ranks; it ends when none of it counts any more.
OP5 = rf"""
WITH RECURSIVE p AS MATERIALIZED (
  SELECT *, {_NODE} AS node, {_SAYS} AS says FROM (
    SELECT *, {_RULE} AS rule FROM (SELECT page_id, coalesce(html, '') AS html, {_HOST.format("coalesce(url, '')", _LOW)} AS host, {_PATH.format("coalesce(url, '')", "'', ''")} AS path FROM pages))),
found AS (SELECT node AS src, unnest(list_distinct(regexp_extract_all(html, '//[^\x00-\x20"''<>\\]+'))) AS u FROM p WHERE host <> ''),
linked AS (SELECT DISTINCT src, 'http:' || u AS u FROM found),
judged AS MATERIALIZED (
  SELECT src, dst, {_SAYS} AS says FROM (
    SELECT src, {_NODE} AS dst, {_RULE} AS rule FROM (SELECT src, {_HOST.format("u", _LOW)} AS host, {_PATH.format("u", "'', ''")} AS path FROM linked) WHERE host <> '')
  WHERE dst <> '' AND dst <> src),
names AS (SELECT node AS src, translate(unnest(list_distinct([regexp_extract(x, '^[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') for x in regexp_extract_all(html, '[A-Za-z0-9._@-]+')])), {_LOW}) AS dst FROM p WHERE host <> ''),
edges AS MATERIALIZED (
  SELECT DISTINCT src, dst FROM judged
  UNION SELECT src, dst FROM names WHERE dst <> src AND dst IN (SELECT node FROM p WHERE host <> '')),
seeds AS (
  SELECT host, avg(CASE WHEN says = 'allow' THEN 1.0 ELSE 0.0 END) AS allowed, avg(CASE WHEN says = 'block' THEN 1.0 ELSE 0.0 END) AS blocked
  FROM (SELECT node AS host, says FROM p WHERE host <> '' UNION ALL SELECT dst, says FROM judged) GROUP BY host),
both_ways AS (SELECT 'trust' AS kind, src AS a, dst AS b FROM edges UNION ALL SELECT 'distrust', dst, src FROM edges),
ways AS MATERIALIZED (SELECT kind, a, b, 0.85 / count(*) OVER (PARTITION BY kind, a) AS share FROM both_ways),
mass(kind, host, score, k) AS (
  SELECT 'trust', host, CAST(0.15 * allowed AS DOUBLE), 0 FROM seeds WHERE allowed > 0
  UNION ALL SELECT 'distrust', host, CAST(0.15 * blocked AS DOUBLE), 0 FROM seeds WHERE blocked > 0
  UNION ALL SELECT * FROM (SELECT w.kind, w.b, sum(m.score * w.share) AS score, max(k) + 1 AS k FROM mass m JOIN ways w ON w.kind = m.kind AND w.a = m.host GROUP BY w.kind, w.b) WHERE score > 1e-9 AND k < 300),
ranks AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust FROM mass GROUP BY host)
SELECT page_id, p.host, path, rule, coalesce(says, CASE WHEN p.host <> '' AND distrust > trust AND distrust > 1e-4 THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN ranks r ON p.node = r.host
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_urls": OP5, "op2_mixing": OP2, "op6_pii": OP6, "op8_chat": OP8, "op4_warc": OP4, "op10_decontamination": OP10}
