"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessaline.llm import ann, centroids, chat, fingerprint, language, licenses, merkle, packing, pieces, secrets, simhash, substrings, toxicity
from tessaline.llm.common import documents, table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": lambda spark, sf_dir: toxicity.op1(documents(spark, sf_dir), table(spark, sf_dir, "labels")),
        "op2_best_fit_packing": lambda spark, sf_dir: packing.op2(documents(spark, sf_dir)),
        "op3_document_fingerprints": lambda spark, sf_dir: fingerprint.op3(documents(spark, sf_dir)),
        "op4_substring_dedup": lambda spark, sf_dir: substrings.op4(documents(spark, sf_dir)),
        "op5_simhash_near_dedup": lambda spark, sf_dir: simhash.op5(documents(spark, sf_dir)),
        "op6_secret_scan": lambda spark, sf_dir: secrets.op6(documents(spark, sf_dir)),
        "op7_license_scan": lambda spark, sf_dir: licenses.op7(documents(spark, sf_dir)),
        "op8_sentencepiece": lambda spark, sf_dir: pieces.op8(documents(spark, sf_dir)),
        "op9_nearest_neighbours": lambda spark, sf_dir: ann.op9(table(spark, sf_dir, "embeddings")),
        "op10_language_id": lambda spark, sf_dir: language.op10(documents(spark, sf_dir)),
        "op11_merkle_manifest": lambda spark, sf_dir: merkle.op11(documents(spark, sf_dir)),
        "op12_centroid_clustering": lambda spark, sf_dir: centroids.op12(table(spark, sf_dir, "embeddings")),
        "op13_chat_formatting": lambda spark, sf_dir: chat.op13(spark, table(spark, sf_dir, "conversations")),
    }


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, s, array_to_string(ws[s:s+19], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w)),
late AS (
  SELECT doc_id, s
  FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS pos FROM late),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t
  FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n.c, 0) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def _secret_sql(rule: secrets.Rule, order: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {order} AS ord, '{rule.kind}' AS kind, unnest(range(len(regexp_extract_all(t, '{pattern}')))) AS i,
         unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(regexp_extract_all(t, '{pattern}', {rule.group})) AS g,
         unnest(list_slice(string_split_regex(t, '{pattern}'), 1, len(regexp_extract_all(t, '{pattern}')))) AS b, {rule.least} AS least
  FROM d"""


OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_secret_sql(r, i) for i, r in enumerate(secrets.RULES))}),
p AS (
  SELECT *, sum(length(b) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM m),
s AS (SELECT doc_id, ord, kind, CAST(e - length(m) AS BIGINT) AS a, CAST(e AS BIGINT) AS e FROM p WHERE length(g) >= least),
j AS (
  SELECT doc_id, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, ord) AS spans,
         count(*) FILTER (kind = 'assign') AS x, count(*) FILTER (kind = 'access') AS y, count(*) FILTER (kind = 'hex') AS z
  FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(x, 0) AS n_assign, coalesce(y, 0) AS n_access, coalesce(z, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (doc_id)
"""

_TEMPLATES = ", ".join(f"('{name}', '{' '.join(licenses.template_words(text))}')" for name, text in licenses.TEMPLATES.items())
OP7_SQL = f"""
WITH t AS (SELECT license, string_split(words, ' ') AS ws FROM (VALUES {_TEMPLATES}) AS v(license, words)),
ts AS (
  SELECT DISTINCT license, len(ws) AS words, array_to_string(ws[i:i+4], ' ') AS s
  FROM (SELECT license, ws, unnest(range(1, len(ws) - 3)) AS i FROM t)),
size AS (SELECT license, count(*) AS size FROM ts GROUP BY license),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '{licenses.WORD}') AS ws FROM documents),
hit AS (
  SELECT doc_id, license, words, i - 1 AS pos, s
  FROM (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS s
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)) JOIN ts USING (s)),
win AS (
  SELECT DISTINCT doc_id, license, words,
         unnest(range(greatest(0, CAST(ceil((pos + 5 - 64) / 32) AS BIGINT)), CAST(floor(pos / 32) AS BIGINT) + 1)) AS w
  FROM hit),
n AS (
  SELECT doc_id, license, w, count(DISTINCT s) AS n, min(pos) AS first_word, max(pos + 5) AS end_word
  FROM win JOIN hit USING (doc_id, license, words)
  WHERE pos >= w * 32 - words AND pos + 5 <= w * 32 + 64 + words GROUP BY ALL)
SELECT doc_id, license, max(n / size) AS containment, CAST(min(first_word) AS INTEGER) AS first_word,
       CAST(max(end_word) AS INTEGER) AS end_word
FROM n JOIN size USING (license) WHERE n / size >= 0.8 GROUP BY ALL
"""

OP9_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])),
                          lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS n FROM d)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""

OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, concat('=', source) AS k, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         list_reduce(
           list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT)),
           lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))),
           4294967295) AS crc,
         list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)],
                        lambda v: CASE WHEN v IS NULL THEN '-' ELSE concat(strlen(v), ':', v) END) AS head
  FROM documents),
leaf AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE k END AS tree, crc,
         sha256(concat(array_to_string(head, ''), CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS h,
         sha256(concat(array_to_string(head, ''), CASE WHEN low IS NULL THEN '-' ELSE concat(strlen(low), ':', low) END)) AS changed
  FROM d),
up(tree, level, hs) AS (
  SELECT tree, 0, list(h ORDER BY doc_id, h) FROM leaf GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, list_transform(range(0, len(hs), 16), lambda i: sha256(array_to_string(hs[i + 1:i + 16], ''))) FROM up WHERE len(hs) > 1),
sub AS (SELECT tree, hs[1] AS h FROM up WHERE len(hs) = 1),
top(level, hs) AS (
  SELECT 0, list(h ORDER BY encode(tree)) FROM sub
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(hs), 16), lambda i: sha256(array_to_string(hs[i + 1:i + 16], ''))) FROM top WHERE len(hs) > 1),
place AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, h) - 1 AS i FROM leaf),
mine(tree, doc_id, h, changed, crc, level, i, proof, folded) AS (
  SELECT tree, doc_id, h, changed, crc, 0, i, '', CASE WHEN (4294967295 - crc) % 5 = 0 THEN changed ELSE h END FROM place
  UNION ALL
  SELECT m.tree, doc_id, h, changed, crc, m.level + 1, i // 16,
         concat(proof, array_to_string(hs[i // 16 * 16 + 1:i], ''), array_to_string(hs[i + 2:i // 16 * 16 + 16], '')),
         sha256(concat(array_to_string(hs[i // 16 * 16 + 1:i], ''), folded, array_to_string(hs[i + 2:i // 16 * 16 + 16], '')))
  FROM mine m JOIN up u ON u.tree = m.tree AND u.level = m.level AND len(hs) > 1),
low AS (SELECT m.* FROM mine m JOIN up u ON u.tree = m.tree AND u.level = m.level AND len(hs) = 1),
rank AS (SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS i FROM sub),
high(doc_id, h, subroot, level, i, proof, folded) AS (
  SELECT doc_id, low.h, rank.h, 0, rank.i, proof, folded FROM low JOIN rank USING (tree)
  UNION ALL
  SELECT doc_id, h, subroot, m.level + 1, i // 16,
         concat(proof, array_to_string(hs[i // 16 * 16 + 1:i], ''), array_to_string(hs[i + 2:i // 16 * 16 + 16], '')),
         sha256(concat(array_to_string(hs[i // 16 * 16 + 1:i], ''), folded, array_to_string(hs[i + 2:i // 16 * 16 + 16], '')))
  FROM high m JOIN top u ON u.level = m.level AND len(hs) > 1)
SELECT doc_id, h AS leaf, subroot, hs[1] AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = hs[1] AS verified
FROM high m JOIN top u ON u.level = m.level AND len(hs) = 1
"""


def _op12_sql(k: int = 8, rounds: int = 10, size: int = 64) -> str:
    """The rounds one behind the other; components as rows."""
    parts = [f"""
WITH q AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, unnest(range({size})) AS i, unnest(q) AS x FROM q),
s AS (SELECT r, row_number() OVER (ORDER BY sha256(concat('3:', vec_id)), q) - 1 AS n FROM q),
c0 AS MATERIALIZED (SELECT n, i, x AS c FROM s JOIN x USING (r) WHERE n < {k})"""]
    for at in range(rounds + 1):
        parts.append(f"""
a{at} AS MATERIALIZED (
  SELECT r, min([d, n])[2] AS n, min(d) AS d
  FROM (SELECT r, n, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN c{at} USING (i) GROUP BY r, n) GROUP BY r)""")
        if at < rounds:
            parts.append(f"""
c{at + 1} AS MATERIALIZED (
  SELECT n, i, CASE WHEN m IS NULL THEN c ELSE (t - ((t % m) + m) % m) // m END AS c
  FROM c{at} LEFT JOIN (SELECT n, i, sum(x) AS t, count(*) AS m FROM x JOIN a{at} USING (r) GROUP BY n, i) USING (n, i))""")
    return ",".join(parts) + f"""
SELECT vec_id, CAST(n AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY n) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN q USING (r) JOIN (SELECT n, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY n) USING (n)
"""


OP13_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
         length(regexp_replace(role, '([<\[])(\\*)(s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g')) AS r,
         length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g')) AS t
  FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(7 + r + t + CASE WHEN role = 'assistant' THEN 7 ELSE 6 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_substring_dedup": OP4_SQL, "op6_secret_scan": OP6_SQL, "op7_license_scan": OP7_SQL, "op9_nearest_neighbours": OP9_SQL,
        "op11_merkle_manifest": OP11_SQL, "op12_centroid_clustering": _op12_sql(), "op13_chat_formatting": OP13_SQL,
    }
