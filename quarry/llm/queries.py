"""The queries of this subpackage, over whole tables with the operators' own parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import ctw, dartminhash, licenses, maxscore, mixing, packing, pfp, quality, secrets, sharding
from quarry.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), ["doc_id"])


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top(table(spark, sf_dir, "embeddings"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find(table(spark, sf_dir, "documents"))


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.classes(table(spark, sf_dir, "documents"))


def op8_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op9_pfp_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfp.dedup(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_quality_rules, op3_context_tree, op4_curriculum_mix, op5_maxscore, op6_license_scan, op7_dart_minhash, op8_jump_shards, op9_pfp_dedup, op10_best_fit_packing)}


def _license_sql() -> str:
    """All units against all templates, without the operator's bounds."""
    rows = ", ".join(f"({i}, '{n}', {k}, [{', '.join(repr(x) for x in b)}])" for i, (n, k, b) in enumerate(licenses.template_bigrams()))
    letters = "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH templates(nth, license, template, b) AS (VALUES {rows}),
units AS (
  SELECT doc_id, text AS unit FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents WHERE contains(text, chr(10))),
words AS (SELECT doc_id, regexp_extract_all(translate(unit, '{letters.upper()}', '{letters}'), '[a-z0-9]+') AS w FROM units),
pairs AS (
  SELECT row_number() OVER () AS r, doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS u FROM words WHERE len(w) > 1),
scored AS (
  SELECT r, doc_id, nth, license, template, CAST(2 AS DOUBLE) * len(list_intersect(u, b)) / (len(u) + len(b)) AS dice FROM pairs, templates),
best AS (
  SELECT doc_id, count(DISTINCT r) AS n_matches, arg_min(license, (-dice, nth)) AS license, arg_min(template, (-dice, nth)) AS template, max(dice) AS dice
  FROM scored WHERE dice >= 0.8 GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_matches, 0) AS n_matches, license, CAST(template AS INT) AS template, round(dice, 6) AS dice
FROM documents d LEFT JOIN best USING (doc_id)
"""


ORACLE_SQL: dict[str, str] = {
    "op6_license_scan": _license_sql(),
    "op4_curriculum_mix": r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source IS NULL, CAST(source AS BLOB)) - 1 AS nth FROM sized GROUP BY source),
weighted AS (
  SELECT *, CAST([5, 2, 1][CAST(nth % 3 AS INT) + 1] AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS most FROM sources),
rounds(i, level) AS (
  SELECT 0, CAST(0 AS DOUBLE)
  UNION ALL
  SELECT i + 1, (SELECT (sum(source_size) - coalesce(sum(CASE WHEN most <= r.level * weight THEN most END), 0)) / sum(CASE WHEN most > r.level * weight THEN weight END) FROM weighted)
  FROM rounds r WHERE i < 100 AND (SELECT (sum(source_size) - coalesce(sum(CASE WHEN most <= r.level * weight THEN most END), 0)) / sum(CASE WHEN most > r.level * weight THEN weight END) FROM weighted) > r.level),
targets AS (
  SELECT *, least(most, weight * (SELECT max(level) FROM rounds)) AS target FROM weighted),
placed AS (
  SELECT d.doc_id, d.source, d.size, CAST(t.source_size AS BIGINT) AS source_size, t.target, t.nth,
    coalesce(sum(d.size) OVER (PARTITION BY t.nth ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / CAST(2 AS DOUBLE) AS middle
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, CAST(CASE WHEN size = 0 THEN 0 ELSE least(3, greatest(0, floor((target - middle) / source_size) + 1)) END AS INT) AS copies,
    CAST([1.0, 0.5, 1.5] AS DOUBLE[])[CAST(nth % 3 AS INT) + 1] AS a, CAST([1.0, 1.5, 0.5] AS DOUBLE[])[CAST(nth % 3 AS INT) + 1] AS e FROM placed),
positioned AS (
  SELECT row_number() OVER () AS r, doc_id, source, size, source_size, target, copies, CAST(copies * size AS BIGINT) AS taken,
    list_transform(list_transform(range(copies), lambda i: least(1.0, (middle + i * source_size) / target)),
      lambda x: CASE WHEN e = a THEN x ELSE 2 * x / (a + sqrt(greatest(a * a + 2 * (e - a) * x, 0))) END) AS positions
  FROM taken),
copied AS (SELECT r, doc_id, unnest(positions) AS position, unnest(range(len(positions))) AS n FROM positioned),
ordered AS (SELECT r, row_number() OVER (ORDER BY round(position, 12), coalesce(CAST(doc_id AS VARCHAR), ''), n) - 1 AS place FROM copied),
listed AS (SELECT r, list(place ORDER BY place) AS places FROM ordered GROUP BY r)
SELECT doc_id, source, size, source_size, target, copies, taken, positions, coalesce(places, CAST([] AS BIGINT[])) AS places
FROM positioned LEFT JOIN listed USING (r)
""",
    "op8_jump_shards": """
WITH RECURSIVE polynomial(i, n, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL SELECT i, n + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM polynomial WHERE n < 8),
letters AS (SELECT list(c ORDER BY i) AS t FROM polynomial WHERE n = 8),
sized AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
summed AS (
  SELECT r, doc_id, h, CAST(strlen(x) + 8 AS BIGINT) AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda b: CAST('0x' || b AS BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS text_crc32
  FROM sized, letters),
jumps(r, k, b, j) AS (
  SELECT r, CAST('0x' || h[1:16] AS UHUGEINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM summed
  UNION ALL
  SELECT r, n, j, CAST(floor((j + 1) * (CAST(2147483648 AS DOUBLE) / CAST((n >> 33) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT r, j, (k * 2862933555777941757 + 1) % CAST(18446744073709551616 AS UHUGEINT) AS n FROM jumps WHERE j < 25)),
shards AS (SELECT r, CAST(max(b) FILTER (WHERE b < 24) AS INT) AS shard, CAST(max(b) AS INT) AS grown_shard FROM jumps GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM summed JOIN shards USING (r)
""",
    "op5_maxscore": """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
  FROM rows q JOIN rows r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
""",
}
