"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ripplegraph.llm import decontam, hmm, langid, mixing, pii, quality, quotes, simhash, topk, toxicity
from ripplegraph.llm.base import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op1(table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op2(table(spark, sf_dir, "documents"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op3(table(spark, sf_dir, "embeddings"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op4(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op6(table(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.op7(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op9(table(spark, sf_dir, "documents"))


def op10_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.op10(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_language, op2_personal_data, op3_top_k, op4_decontamination, op5_quality, op6_mixing, op7_language_model, op8_toxicity, op9_simhash, op10_quotation)}


SQL: dict[str, str] = {}

SQL["op4_decontamination"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT dw.r, dw.i, dw.n, bw.id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""


def _time(share: str) -> str:
    return f"CASE WHEN slope = 0 THEN {share} ELSE least(greatest((sqrt((1 - slope) * (1 - slope) + 4 * slope * ({share})) - (1 - slope)) / (2 * slope), 0), 1) END"


SQL["op6_mixing"] = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))) AS digest FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n, sum(source_size) OVER () AS full_size FROM s),
w AS (SELECT *, CASE n % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM n),
k AS (SELECT *, 2.0::DOUBLE * source_size / weight AS r FROM w),
p AS (SELECT *, row_number() OVER o AS k, coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
    sum(weight) OVER (ORDER BY r DESC, n DESC ROWS UNBOUNDED PRECEDING) AS rest FROM k WINDOW o AS (ORDER BY r, n)),
l AS (SELECT CAST(3 * full_size - 2 * caps AS DOUBLE) / CAST(2 * rest AS DOUBLE) AS level FROM p WHERE r >= CAST(3 * full_size - 2 * caps AS DOUBLE) / CAST(2 * rest AS DOUBLE) ORDER BY k LIMIT 1),
t AS (SELECT source, n, source_size, least(level * weight, CAST(2 * source_size AS DOUBLE)) AS target FROM k, l),
q AS (SELECT doc_id, size, source_size, target, n, CAST(round(target) AS BIGINT) AS words,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, CAST(greatest(0, least(size, words - first)) AS BIGINT) AS once, CAST(greatest(0, least(size, words - source_size - first)) AS BIGINT) AS again,
    CASE n % 3 WHEN 0 THEN -0.6::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.6::DOUBLE END AS slope FROM q)
SELECT doc_id, size, source_size, target, once + again AS taken,
    CASE WHEN once > 0 THEN round({_time('CAST(first AS DOUBLE) / words')}, 9) + 0.0 END AS position,
    CASE WHEN again > 0 THEN round({_time('CAST(source_size + first AS DOUBLE) / words')}, 9) + 0.0 END AS again_position, again AS again_words
FROM x
"""


SQL["op3_top_k"] = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


SQL["op10_quotation"] = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM conversations),
l AS (SELECT r, conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM m),
v AS (SELECT r, conv_id, turn, i, length(regexp_replace(regexp_extract(line, '^([ \t]*>)+'), '[^>]', '', 'g')) AS level, regexp_replace(line, '^([ \t]*>)+[ \t]?', '') AS words FROM l),
w AS (SELECT *, lead(level, 1, 0) OVER o AS after, CASE WHEN level IS DISTINCT FROM lag(level) OVER o THEN 1 ELSE 0 END AS new FROM v WINDOW o AS (PARTITION BY r ORDER BY i)),
p AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS passage FROM w),
b AS (SELECT r, trim(regexp_replace(string_agg(words, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g')) AS body FROM p WHERE level = 0 AND NOT (after > 0 AND regexp_matches(words, 'wrote:\s*$')) GROUP BY r),
q AS (SELECT r, conv_id, turn, passage, level, string_agg(words, ' ' ORDER BY i) AS whole FROM p WHERE level > 0 GROUP BY r, conv_id, turn, passage, level),
au AS (SELECT r, conv_id, turn, passage, level, whole AS unit FROM q UNION SELECT r, conv_id, turn, passage, level, words FROM p WHERE level > 0),
asked AS (SELECT DISTINCT r, conv_id, turn, passage, level, trim(regexp_replace(lower(unit), '\s+', ' ', 'g')) AS unit FROM au),
ou AS (SELECT conv_id, turn, unnest([body] || string_split_regex(body, '\n[ \t]*\n') || string_split(body, chr(10))) AS unit FROM b JOIN m USING (r)),
orig AS (SELECT conv_id, trim(regexp_replace(lower(unit), '\s+', ' ', 'g')) AS unit, min(turn) AS origin FROM ou WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
f AS (SELECT a.r, a.passage, a.level, length(a.unit) AS n, o.origin FROM asked a JOIN orig o ON a.conv_id = o.conv_id AND a.unit = o.unit WHERE a.unit <> '' AND o.origin < a.turn),
par AS (SELECT r, origin AS parent_turn FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY level, n DESC, origin DESC) AS k FROM f) x WHERE k = 1),
cnt AS (SELECT r, count(DISTINCT passage) AS n_linked FROM f GROUP BY r),
up AS (SELECT conv_id, turn, min(parent_turn) AS parent FROM par JOIN m USING (r) GROUP BY conv_id, turn),
walk(conv_id, turn, root, hops) AS (SELECT conv_id, turn, parent, 1 FROM up UNION ALL SELECT k.conv_id, k.turn, u.parent, k.hops + 1 FROM walk k JOIN up u ON u.conv_id = k.conv_id AND u.turn = k.root),
rt AS (SELECT conv_id, turn, arg_max(root, hops) AS root, max(hops) AS hops FROM walk GROUP BY conv_id, turn),
x AS (SELECT m.r, m.conv_id, m.turn, m.role, coalesce(rt.root, m.turn) AS root_turn, par.parent_turn, coalesce(rt.hops, 0) AS depth, coalesce((SELECT count(*) FROM q WHERE q.r = m.r), 0) AS n_quoted, coalesce(cnt.n_linked, 0) AS n_linked, coalesce(b.body, '') AS body
    FROM m LEFT JOIN b USING (r) LEFT JOIN par USING (r) LEFT JOIN cnt USING (r) LEFT JOIN rt ON rt.conv_id = m.conv_id AND rt.turn = m.turn)
SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY root_turn NULLS FIRST, turn NULLS FIRST, r) - 1 AS BIGINT) AS position, root_turn, parent_turn, CAST(depth AS INTEGER) AS depth,
    CAST(n_quoted AS BIGINT) AS n_quoted, CAST(n_linked AS BIGINT) AS n_linked, body, '<|' || coalesce(role, '') || '|>' || chr(10) || body AS chat
FROM x
"""


def oracle_sql() -> dict[str, str]:
    return SQL
