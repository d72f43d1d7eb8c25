"""Registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quayside.llm import adaptive_rules, bitplane, conversation, jaccard, langid, lloyd, mixing, order_minhash, packing, quality, sharding, tensor_minhash, tokens, url_trie
from quayside.llm.common import table

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_bitplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.round_trip(table(spark, sf_dir, "documents"), tokens.tokenizer_path(WORD_BPE), end_id=1)


def op2_language_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op3_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.tokenizer_path(BYTE_BPE), end_id=1)


def op4_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trie.judge(table(spark, sf_dir, "pages"), RULES)


def op5_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op8_jaccard_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare(table(spark, sf_dir, "documents"))


def op10_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_rules.judge(table(spark, sf_dir, "documents"))


def op11_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor_minhash.dedup(table(spark, sf_dir, "documents"))


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(table(spark, sf_dir, "embeddings"))


def op13_cost_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.audited(conversation.repair(conversation.damaged(table(spark, sf_dir, "conversations"))))


QUERIES = {f.__name__: f for f in (op1_bitplane, op2_language_hierarchy, op3_nnls_packing, op4_url_trie, op5_quality_ftrl, op6_hash_threshold_mix, op7_extendible_shards, op8_jaccard_partitions, op9_order_minhash, op10_adaptive_rules, op11_tensored_minhash, op12_lloyd, op13_cost_layers)}

_HASH = "('0x' || substr(md5({}), 1, 15))::BIGINT"
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

SQL: dict[str, str] = {
    "op4_url_trie": """
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v FROM parts, rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
""",
    "op6_hash_threshold_mix": r"""
WITH docs AS (
  SELECT doc_id, source, length(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g')) - length(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', '', 'g')) AS size,
    HASH >> 24 AS h FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM by_source),
run AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS words, sum(weight) OVER ()::BIGINT AS weights,
    3 * coalesce(sum(source_size) OVER before, 0)::BIGINT AS capped, coalesce(sum(weight) OVER before, 0)::BIGINT AS capped_weights
  FROM weighed WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
above AS (SELECT *, weight * (words - capped) > 3 * source_size * (weights - capped_weights) AS above FROM run),
price AS (SELECT capped AS c, capped_weights AS cw FROM above WHERE NOT above ORDER BY source_size / weight, capped, capped_weights LIMIT 1),
goals AS (
  SELECT source, source_size, CASE WHEN above THEN (3 * source_size)::DOUBLE ELSE (words - c)::DOUBLE * weight / (weights - cw) END AS target FROM above LEFT JOIN price ON true),
budgets AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS repeats FROM goals),
cells AS (SELECT source, h, sum(size)::BIGINT AS n FROM docs GROUP BY source, h),
sums AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h)::BIGINT - n AS below FROM cells),
edges AS (
  SELECT s.source, min(h + CASE WHEN n - (target - repeats * source_size - below) < target - repeats * source_size - below THEN 1 ELSE 0 END) AS threshold
  FROM sums s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
  WHERE below <= target - repeats * source_size AND below + n > target - repeats * source_size GROUP BY s.source)
SELECT doc_id, d.source, size, source_size, target, least(3, repeats + CASE WHEN h < coalesce(threshold, 0) THEN 1 ELSE 0 END)::INT AS copies,
  least(3, repeats + CASE WHEN h < coalesce(threshold, 0) THEN 1 ELSE 0 END) * size AS taken
FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN edges e ON d.source IS NOT DISTINCT FROM e.source
""".replace("HASH", _HASH.format("coalesce(doc_id::VARCHAR, '-') || '|' || md5(coalesce(text, ''))")),
    "op7_extendible_shards": """
WITH docs AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS bytes, HASH AS h FROM documents),
every AS (SELECT doc_id, h, bytes, d, h >> (60 - d) AS prefix FROM docs, range(0, 61) AS r(d)),
sums AS (SELECT d, prefix, sum(bytes)::BIGINT AS total FROM every GROUP BY ALL),
leaves AS (SELECT e.doc_id, e.h, min(d) AS d FROM every e JOIN sums s USING (d, prefix) WHERE total <= 16777216 GROUP BY ALL)
SELECT docs.doc_id, bytes, d || '-' || upper(to_hex(docs.h >> (60 - d))) AS shard, d::INT AS depth, total AS shard_bytes, false AS oversized
FROM docs JOIN leaves ON docs.doc_id = leaves.doc_id AND docs.h = leaves.h JOIN sums USING (d) WHERE prefix = docs.h >> (60 - d)
""".replace("HASH", _HASH.format("coalesce(doc_id::VARCHAR, '-') || '|' || md5(coalesce(text, ''))")),
    "op10_adaptive_rules": r"""
WITH docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, WORDS AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) AS l FROM documents),
base AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (length(text) - length(translate(text, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', '')))::BIGINT AS n_signs, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines FROM docs),
wins AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS pos FROM docs)),
twice AS (SELECT doc_id, pos FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
rep AS (SELECT doc_id, sum(own)::BIGINT AS n_repeat_words FROM (SELECT doc_id, least(8, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos, 8)) AS own FROM twice) GROUP BY doc_id),
rows_ AS (
  SELECT base.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_signs / greatest(word_chars, 1) AS sign_rate, n_dup_lines / greatest(n_lines, 1) AS dup_line_rate,
    coalesce(n_repeat_words, 0) / greatest(n_words, 1) AS repeat_rate, word_chars / greatest(n_words, 1) AS word_length FROM base LEFT JOIN rep USING (doc_id)),
long AS (SELECT lang, source, m, v FROM rows_, LATERAL (VALUES ('sign_rate', sign_rate), ('dup_line_rate', dup_line_rate), ('repeat_rate', repeat_rate), ('word_length', word_length)) AS t(m, v)),
-- a row for each level of groups: own, language's, all
levels AS (
  SELECT 1 AS level, lang, source, m, count(*) >= 50 AS enough, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3, quantile_disc(v, 0.99) AS q99 FROM long GROUP BY ALL
  UNION ALL SELECT 2, lang, NULL, m, count(*) >= 50, quantile_disc(v, 0.25), quantile_disc(v, 0.75), quantile_disc(v, 0.99) FROM long GROUP BY lang, m
  UNION ALL SELECT 3, NULL, NULL, m, true, quantile_disc(v, 0.25), quantile_disc(v, 0.75), quantile_disc(v, 0.99) FROM long GROUP BY m),
said AS (
  SELECT *, CASE WHEN m IN ('sign_rate', 'word_length') THEN q3 + 5 * (q3 - q1) ELSE 2 * q99 END AS high, CASE WHEN m = 'word_length' THEN q1 - 5 * (q3 - q1) END AS low
  FROM levels WHERE enough AND CASE WHEN m IN ('sign_rate', 'word_length') THEN q3 > q1 ELSE q99 > 0 END),
fence AS (
  SELECT g.lang, g.source, g.m, arg_min(coalesce(high, 1e300), level) AS high, arg_min(coalesce(low, -1e300), level) AS low FROM (SELECT DISTINCT lang, source, m FROM long) g
  JOIN said s ON s.m = g.m AND (level = 3 OR (level = 2 AND s.lang IS NOT DISTINCT FROM g.lang) OR (level = 1 AND s.lang IS NOT DISTINCT FROM g.lang AND s.source IS NOT DISTINCT FROM g.source)) GROUP BY ALL),
fences AS (
  SELECT lang, source, max(CASE WHEN m = 'sign_rate' THEN high END) AS f1, max(CASE WHEN m = 'dup_line_rate' THEN high END) AS f2, max(CASE WHEN m = 'repeat_rate' THEN high END) AS f3,
    max(CASE WHEN m = 'word_length' THEN high END) AS f4, max(CASE WHEN m = 'word_length' THEN low END) AS f5 FROM fence GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(sign_rate <= f1, true) AND coalesce(dup_line_rate <= f2, true) AND coalesce(repeat_rate <= f3, true) AND coalesce(word_length <= f4, true) AND coalesce(word_length >= f5, true) AS kept,
  sign_rate, dup_line_rate, repeat_rate, word_length
FROM rows_ r LEFT JOIN fences f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
""".replace("WORDS", _WORDS),
}


def _lloyd_sql() -> str:
    """Rounds of exact integers, written out."""
    floor = "(s - ((s % n) + n) % n) // n"
    out = ["v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(least(greatest(x::DOUBLE, -524288), 524288) * 256)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x::DOUBLE), false))))"]
    out.append("e AS MATERIALIZED (SELECT rid, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM v)")
    out.append("c0 AS MATERIALIZED (SELECT c, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, 'null')), v) - 1 AS c, v FROM v) WHERE c < 40)")
    for k in range(6):
        out.append(f"d{k} AS MATERIALIZED (SELECT rid, c, sum((e.x - c{k}.x) * (e.x - c{k}.x))::BIGINT AS d FROM e JOIN c{k} USING (i) GROUP BY ALL)")
        out.append(f"a{k} AS MATERIALIZED (SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{k} GROUP BY rid)")
        if k < 5:
            out.append(f"m{k} AS MATERIALIZED (SELECT c, i, {floor} AS x FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{k} JOIN e USING (rid) GROUP BY ALL))")
            out.append(f"c{k + 1} AS MATERIALIZED (SELECT c, i, coalesce(m{k}.x, c{k}.x)::BIGINT AS x FROM c{k} LEFT JOIN m{k} USING (c, i))")
    out.append("h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c5 GROUP BY c)")
    return "WITH " + ",\n".join(out) + "\nSELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a5 JOIN v USING (rid) JOIN h USING (c)"


SQL["op12_lloyd"] = _lloyd_sql()
