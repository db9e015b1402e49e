"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colonnade.llm import decontaminate, language, lm_score, mixing, near_dup, pii, quality, secrets, token_binary, toxicity
from colonnade.llm.common import documents


def table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    benchmark, labels = table("benchmark"), table("labels")
    return {
        "op1_secrets": lambda s, d: secrets.digest(documents(s, d)),
        "op2_quality": lambda s, d: quality.digest(documents(s, d)),
        "op3_decontaminate": lambda s, d: decontaminate.digest(documents(s, d), benchmark(s, d)),
        "op4_pii": lambda s, d: pii.digest(documents(s, d)),
        "op5_mixing": lambda s, d: mixing.digest(documents(s, d)),
        "op6_language": lambda s, d: language.digest(documents(s, d)),
        "op7_near_dup": lambda s, d: near_dup.digest(documents(s, d)),
        "op8_tokens": lambda s, d: token_binary.digest(documents(s, d)),
        "op9_lm_score": lambda s, d: lm_score.digest(documents(s, d)),
        "op10_toxicity": lambda s, d: toxicity.digest(documents(s, d), labels(s, d)),
        # the columns of operators 1, 2 and 4 that SQL can express
        "base_secrets": lambda s, d: secrets.digest(documents(s, d)).select("doc_id", "n_assign", "n_access", "n_hex"),
        "base_quality": lambda s, d: quality.base_digest(documents(s, d)),
        "base_pii": lambda s, d: pii.base_digest(documents(s, d)),
    }


OP3_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w, row_number() OVER () AS r
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
patterns AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS m, array_to_string(w[i + 1 : i + 8], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 8, 0) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM patterns),
spots AS (
  SELECT r, i, m, array_to_string(w[i + 1 : i + m], ' ') AS p
  FROM (SELECT r, w, m, unnest(range(0, len(w) - m + 1)) AS i FROM words, lengths WHERE len(w) >= m)),
found AS (SELECT r, i, s.m AS m, item_id FROM spots s JOIN patterns t ON s.p = t.p AND s.m = t.m),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM found) GROUP BY r),
per AS (
  SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM words LEFT JOIN hits USING (r) LEFT JOIN per USING (r)
"""

#: Exact shingle multisets of all pairs that share one, then components by the least reachable doc_id.
OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
shingles AS (
  SELECT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 5, 0) + 1)) AS i FROM words WHERE len(w) > 0)),
bags AS (SELECT doc_id, s, count(*) AS c FROM shingles GROUP BY ALL),
sizes AS (SELECT doc_id, sum(c) AS n FROM bags GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.c, b.c)) AS o
  FROM bags a JOIN bags b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 10 * o >= 8 * (p.n + q.n - o)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(root, node) AS (
  SELECT doc_id, doc_id FROM documents WHERE doc_id IN (SELECT x FROM edges)
  UNION SELECT root, y FROM reach JOIN edges ON node = x),
classes AS (SELECT doc_id, coalesce(m, doc_id) AS class_id FROM documents LEFT JOIN (SELECT node, min(root) AS m FROM reach GROUP BY node) ON node = doc_id)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, row_number() OVER (PARTITION BY class_id ORDER BY doc_id) = 1 AS kept FROM classes
"""


NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE_SECRETS_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
  len(list_filter(regexp_extract_all(t, '(?:{NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access,
  len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex
FROM texts
"""

BASE_QUALITY_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
words AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts),
windows AS (SELECT r, i, w[i + 1 : i + 3] AS g FROM (SELECT r, w, unnest(range(0, len(w) - 2)) AS i FROM words WHERE len(w) > 2)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
hits AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM twice) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
FROM words LEFT JOIN hits USING (r)
"""

BASE_PII_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS n_email,
    len(list_filter(regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), lambda x: len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 OR coalesce(try_cast(y AS INTEGER), 0) > 255)) = 0)) AS n_ip,
    list_filter(list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda d: length(d) BETWEEN 13 AND 19) AS cards,
    len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) AS n_phone
  FROM texts)
SELECT doc_id, n_email, n_ip, len(list_filter(cards, lambda d: list_sum(list_transform(range(length(d)), lambda k: list_extract([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9], CAST(10 * (k % 2) + CAST(substr(d, CAST(length(d) - k AS BIGINT), 1) AS INTEGER) + 1 AS BIGINT)))) % 10 = 0)) AS n_card, n_phone
FROM found
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": OP3_SQL, "op7_near_dup": OP7_SQL, "base_secrets": BASE_SECRETS_SQL, "base_quality": BASE_QUALITY_SQL, "base_pii": BASE_PII_SQL}
