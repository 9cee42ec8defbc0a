"""One query per operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kairograph.llm import byte_bpe, conversation_repair, decontaminate, language_id, licenses, near_dedup, permutation_index, prefix_trie, secrets, substring_dedup, token_binary, token_count, toxicity
from kairograph.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = token_binary.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)
    return token_binary.read_tokens(spark, folder)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digest(table(spark, sf_dir, "documents"), window=50)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=3, threshold=0.85)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.neighbours(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontaminate, op2_token_binary, op3_toxicity, op4_secrets, op5_substrings, op6_licenses, op7_near_dedup, op8_byte_bpe, op9_token_counts, op10_neighbours, op11_conversation_repair, op12_prefix_trie, op13_language_id)}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_decontaminate"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
d AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE len(ws) >= n)),
m AS (SELECT d.doc_id, d.i, d.n, p.item_id FROM d JOIN p USING (g, n)),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
_GROUP = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: str, expression: str, keep: str) -> str:
    """Matches and the pieces between them give the places of all matches of one kind."""
    quoted = expression.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, pos AS s, pos + length(m) AS e
  FROM (SELECT doc_id, m, k, sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
        FROM (SELECT doc_id, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS k, unnest(gs[1:len(ms)]) AS g
              FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}') AS ms, string_split_regex(text, '{quoted}') AS gs FROM documents WHERE text IS NOT NULL))
        WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING))
  WHERE {keep}"""


# Tokens with a checksum of their own need a CRC over candidate strings, which SQL
# folds bit by bit; the base kinds are plain expressions.
_CRC = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, 31), lambda i: ascii(substr(m, o + i, 1))::UBIGINT)), lambda c, b: {fold})"


def _crc_fold() -> str:
    step = "xor(c, b)"
    out = step
    for _ in range(8):
        out = f"list_transform([{out}], lambda v: xor(v >> 1, (v & 1) * 3988292384::UBIGINT))[1]"
    return out


def _base62() -> str:
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    return " || ".join(f"substr('{alphabet}', CAST((x // {62**k}) % 62 AS BIGINT) + 1, 1)" for k in range(5, -1, -1))


def _checked(kind: str, head: str) -> str:
    body = _spans(kind, head + "[A-Za-z0-9]{36}", "true").replace("AS e\n", "AS e, m\n")
    crc = _CRC.format(fold=_crc_fold()).replace("o + i", "4 + i")
    return f"""
  SELECT doc_id, kind, s, e FROM (
    SELECT doc_id, kind, s, e, m, xor({crc}, 4294967295::UBIGINT) AS x FROM ({body}))
  WHERE substr(m, 35, 6) = {_base62()}"""


ORACLE_SQL["op4_secrets"] = f"""
WITH base AS ({_spans("assign", _ASSIGN, f"length(regexp_extract(m, '{_GROUP.replace("'", "''")}', 1)) >= 6")}
  UNION ALL {_spans("access", "AKIA[A-Z0-9]+", "length(m) >= 20")}
  UNION ALL {_spans("hex", "[0-9a-f]+", "length(m) >= 24")}),
every AS (SELECT * FROM base UNION ALL {_checked("github", "gh[pousr]_")} UNION ALL {_checked("npm", "npm_")}),
o AS (SELECT *, CASE kind WHEN 'assign' THEN 1 WHEN 'access' THEN 2 WHEN 'hex' THEN 3 WHEN 'github' THEN 4 ELSE 5 END AS r FROM every),
a AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, r) FILTER (r <= 3), '') AS base,
         string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, r) AS spans
  FROM o GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a USING (doc_id)
"""

ORACLE_SQL["op7_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT DISTINCT x AS doc_id, x AS c FROM e UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id, coalesce(m.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

ORACLE_SQL["op10_neighbours"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""

ORACLE_SQL["op5_substrings"] = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, i, b[i:i + 49] AS g FROM (SELECT doc_id, b, unnest(range(1, n - 48)) AS i FROM d WHERE n >= 50)),
f AS (SELECT g, min(doc_id) AS low FROM p GROUP BY g HAVING min(doc_id) <> max(doc_id)),
h AS (SELECT p.doc_id, p.i FROM p JOIN f USING (g) WHERE low < p.doc_id),
r AS (
  SELECT doc_id, min(i) AS a, max(i) + 49 AS z
  FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k
        FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM h))
  GROUP BY doc_id, k),
k AS (
  SELECT doc_id, count(*) AS n_spans, sum(z - a + 1) AS n_removed FROM r GROUP BY doc_id),
g AS (SELECT doc_id, z + 1 AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1000000000) - 1 AS z FROM (SELECT doc_id, a, z FROM r UNION ALL SELECT doc_id, 0, 0 FROM d)),
t AS (SELECT d.doc_id, string_agg(CASE WHEN g.a > g.z THEN '' ELSE hex(b[g.a:g.z]) END, '' ORDER BY g.a) AS kept FROM d JOIN g USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""

_TEXT_CRC = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::UBIGINT)), lambda c, b: {_crc_fold()}), 4294967295::UBIGINT)"

# Costs before each row from those after it; then one edit at a time from the first row.
ORACLE_SQL["op11_conversation_repair"] = rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
m AS (SELECT *, {_TEXT_CRC} % 20 AS m FROM k),
d AS (
  SELECT conv_id, turn, CASE m WHEN 4 THEN 'user' ELSE r END AS r, CASE m WHEN 1 THEN '' WHEN 2 THEN translate(x, '.!?', '') ELSE x END AS x,
         unnest(range(CASE m WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x)) AS i FROM d),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, r, x ORDER BY i) AS q, regexp_replace(x, '[\x20\x09-\x0D]+$', '') AS b, lag(left(r, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(r, 1) AS two FROM o),
f AS (
  SELECT conv_id, turn, i, r, x, two, left(r, 1) AS c, CASE WHEN b = '' THEN 1 WHEN q > 1 THEN 2 WHEN right(b, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f
  FROM q),
e AS (SELECT *, f IN (0, 3) AS ok, CASE f WHEN 3 THEN 3 ELSE 0 END AS t FROM f),
v AS (
  SELECT conv_id, max(i) + 1 AS i, [0, 6, 3, 0] AS p FROM e GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, [least(w[1], 3 + w[3], 6 + w[4]), least(w[2], 3 + w[3], 6 + w[4]), least(w[3], 3 + w[4]), least(w[4], 3 + w[3])]
  FROM (
    SELECT e.conv_id, e.i, [
      least(4 + p[1], CASE WHEN ok THEN 3 + t + p[3] END, CASE WHEN ok AND c = 's' THEN t + p[2] WHEN ok AND c = 'u' THEN t + p[3] END),
      least(4 + p[2], CASE WHEN ok THEN 3 + t + p[3] END, CASE WHEN ok AND c = 'u' THEN t + p[3] END),
      least(4 + p[3], CASE WHEN ok THEN 3 + t + p[4] END, CASE WHEN ok AND c = 'a' THEN t + p[4] END),
      least(4 + p[4], CASE WHEN ok THEN 3 + t + p[3] END, CASE WHEN ok AND c = 'u' THEN t + p[3] END)] AS w
    FROM v JOIN e ON e.conv_id IS NOT DISTINCT FROM v.conv_id AND e.i = v.i - 1)),
g AS (
  SELECT conv_id, 1 AS i, 0 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS said, p[1] AS cost FROM v WHERE i = 1
  UNION ALL
  SELECT conv_id, CASE op WHEN 'I' THEN i ELSE i + 1 END, CASE op WHEN 'D' THEN s WHEN 'K' THEN keep ELSE more END, audit || op,
         CASE op WHEN 'D' THEN said WHEN 'K' THEN list_append(said, r || ':' || x) ELSE list_append(said, CASE s WHEN 2 THEN 'assistant:' ELSE 'user:' END || CASE op WHEN 'R' THEN x ELSE '' END) END, cost
  FROM (
    SELECT *, CASE WHEN c IS NULL THEN 'I' WHEN p[s + 1] = 4 + n[s + 1] THEN 'D' WHEN p[s + 1] = 3 + p[more + 1] THEN 'I' WHEN ok AND p[s + 1] = t + n[keep + 1] THEN 'K' ELSE 'R' END AS op
    FROM (
      SELECT g.*, v.p, w.p AS n, e.c, e.ok, e.t, e.r, e.x, CASE g.s WHEN 2 THEN 3 ELSE 2 END AS more,
             CASE WHEN e.c = 's' AND g.s = 0 THEN 1 WHEN e.c = 'u' AND g.s <> 2 THEN 2 WHEN e.c = 'a' AND g.s = 2 THEN 3 END AS keep
      FROM g JOIN v ON v.conv_id IS NOT DISTINCT FROM g.conv_id AND v.i = g.i
      LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM g.conv_id AND e.i = g.i
      LEFT JOIN v w ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND w.i = g.i + 1)
    WHERE c IS NOT NULL OR s IN (1, 2))),
z AS (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(said, length(audit)) AS said, max(cost) AS cost FROM g GROUP BY conv_id),
a AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated,
         count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM e GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""

ORACLE_SQL["op12_prefix_trie"] = f"""
WITH t AS (
  SELECT conv_id, length(r) || ':' || r || x AS key, length(x) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x)) AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
s AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS k, list(key ORDER BY i) AS ks, list(n ORDER BY i) AS ns FROM t GROUP BY conv_id),
h AS (SELECT *, CAST({_TEXT_CRC} % 6 AS BIGINT) AS h FROM s),
r AS (
  SELECT h.conv_id, list_concat(coalesce(b.ks[1:h], []), h.ks[h + 1:]) AS ks, list_concat(coalesce(b.ns[1:h], []), h.ns[h + 1:]) AS ns
  FROM h LEFT JOIN s b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, ks[1:d] AS p, d, ns[d] AS n, d = len(ks) AS ends FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM r)),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(max(n), 0) AS n, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ends
  FROM p GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
every AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (p)),
sub AS (
  SELECT up, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * n) AS BIGINT) AS saved_tokens
  FROM (SELECT p[1:k] AS up, n_children, n_convs, n FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM every)) GROUP BY up)
SELECT every.conv_id, every.d AS depth, above.conv_id AS parent_conv_id, every.n_convs, every.n_children, n_leaves, saved_tokens, sha256(every.ends) AS ends_sha256
FROM every JOIN sub ON sub.up = every.p LEFT JOIN nodes above ON every.d > 0 AND above.p = every.p[1:every.d - 1]
"""
