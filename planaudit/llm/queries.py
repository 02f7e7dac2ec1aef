"""One registered query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planaudit.llm import ann, decontaminate, hard_negatives, language_id, line_dedup, mixing, near_dedup, preference_chat, prefix_trie, quality, simhash, substring_dedup, token_counts

MODEL = "piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def trusted(labels: DataFrame) -> DataFrame:
    """Documents labelled as good and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(_read(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), percent=85)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), trusted(_read(spark, sf_dir, "labels")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_components(_read(spark, sf_dir, "documents")).drop("same")


def op5_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference_chat.preference_pairs(preference_chat.neighbour_pairs(_read(spark, sf_dir, "conversations")))

    def spans(mask: str) -> Column:
        return F.array_join(F.transform(mask, lambda x: F.concat_ws(":", x["start"], x["length"])), ",").alias(mask)

    return pairs.select("pair_id", "chosen_id", "rejected_id", "n_prompt_turns", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), decontaminate.split_items(_read(spark, sf_dir, "benchmark")))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path(MODEL), limit=4096)


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(_read(spark, sf_dir, "embeddings"), every=20, k=20)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"), window=13)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(prefix_trie.reopened(prefix_trie.sequences(_read(spark, sf_dir, "conversations"))))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_read(spark, sf_dir, "embeddings").withColumn("label", label))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_language_id, op2_minhash_near_dedup, op3_quality_classifier, op4_line_dedup, op5_preference_chat, op6_benchmark_decontamination, op7_source_mixing, op8_token_counts, op9_ann, op10_substring_dedup, op11_conversation_trie, op12_simhash_near_dedup, op13_hard_negatives]
    return {f.__name__: f for f in found}


OP5_SQL = """
WITH turns AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos
  FROM conversations),
level AS (
  SELECT pair_id, pos,
         count(*) = 2 AND min(role) IS NOT DISTINCT FROM max(role) AND min(text) IS NOT DISTINCT FROM max(text)
         AND count(role) <> 1 AND count(text) <> 1 AS same
  FROM turns GROUP BY pair_id, pos),
prefix AS (
  SELECT pair_id, CAST(coalesce(min(CASE WHEN NOT same THEN pos END), max(pos) + 1) - 1 AS BIGINT) AS n_prompt_turns
  FROM level GROUP BY pair_id),
shown AS (
  SELECT t.*, n_prompt_turns, pos > n_prompt_turns AS later,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS line
  FROM turns t JOIN prefix USING (pair_id)),
placed AS (
  SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY pair_id, side, later ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            + length(line) - length(coalesce(text, '')) - 1 AS start
  FROM shown)
SELECT pair_id,
       min(CASE WHEN side = 0 THEN conv_id END) AS chosen_id,
       min(CASE WHEN side = 1 THEN conv_id END) AS rejected_id,
       min(n_prompt_turns) AS n_prompt_turns,
       coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE side = 0 AND NOT later), '') AS prompt,
       CASE WHEN count(*) FILTER (WHERE side = 0) > 0 THEN coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE side = 0 AND later), '') END AS chosen,
       CASE WHEN count(*) FILTER (WHERE side = 1) > 0 THEN coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE side = 1 AND later), '') END AS rejected,
       CASE WHEN count(*) FILTER (WHERE side = 0) > 0 THEN coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || length(text), ',' ORDER BY pos)
         FILTER (WHERE side = 0 AND later AND role = 'assistant' AND length(text) > 0), '') END AS chosen_mask,
       CASE WHEN count(*) FILTER (WHERE side = 1) > 0 THEN coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || length(text), ',' ORDER BY pos)
         FILTER (WHERE side = 1 AND later AND role = 'assistant' AND length(text) > 0), '') END AS rejected_mask
FROM placed GROUP BY pair_id
"""

OP7_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth
  FROM docs GROUP BY source),
weighted AS (
  SELECT source, source_size, CASE (nth - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS cap
  FROM sizes),
filling AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k FROM weighted),
levels AS (
  SELECT *, ((SELECT CAST(sum(source_size) AS DOUBLE) FROM filling)
             - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM filling),
level AS (SELECT level FROM levels WHERE level <= cap / weight ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT level FROM level) * weight), cap) AS target FROM weighted),
ranked AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         CASE WHEN t.source_size = 0 THEN 0.0::DOUBLE ELSE t.target / CAST(t.source_size AS DOUBLE) END AS rate,
         CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS DOUBLE) AS rank,
         CAST(('0x' || substr(md5('7:' || coalesce(d.source, chr(1) || 'null')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS drawn
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
tried AS (
  SELECT source, CAST(k AS DOUBLE) / 32.0::DOUBLE AS step, k, max(target) AS target,
         sum(CAST(floor(rate * rank + (drawn + CAST(k AS DOUBLE) / 32.0::DOUBLE)) - floor(rate * (rank - 1) + (drawn + CAST(k AS DOUBLE) / 32.0::DOUBLE)) AS BIGINT) * size) AS words
  FROM ranked, range(32) r(k) GROUP BY source, k),
chosen AS (
  SELECT source, step FROM tried QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(CAST(words AS DOUBLE) - target), k) = 1)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(floor(rate * rank + (drawn + step)) - floor(rate * (rank - 1) + (drawn + step)) AS BIGINT) * CAST(size AS BIGINT) AS taken
FROM ranked r JOIN chosen c ON r.source IS NOT DISTINCT FROM c.source
"""


# crc32 bit by bit over the digits of an id
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
         lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda y, i: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295::BIGINT)"""

OP11_SQL = rf"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, {_CRC} % 4 AS h FROM own),
parts AS (
  SELECT i.conv_id, 0 AS part, pos, role, text FROM ids i JOIN own o ON o.conv_id = i.conv_id - i.conv_id % 20 AND pos <= h
  UNION ALL
  SELECT i.conv_id, 1, pos, role, text FROM ids i JOIN own o ON o.conv_id = i.conv_id AND pos > h),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         md5(len(role) || ':' || role || text) AS turn
  FROM parts),
paths AS (
  SELECT conv_id, depth, words, md5(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS path FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
linked AS (
  SELECT *, lag(path) OVER w AS above, lead(path) OVER w IS NULL AS ends FROM paths WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
nodes AS (
  SELECT path, depth, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM linked GROUP BY path, depth),
children AS (SELECT above AS path, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
told AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (path)),
sums AS (
  SELECT p.path, sum(CASE WHEN t.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((t.n_convs - 1) * t.words) AS saved
  FROM told t JOIN paths p ON p.conv_id = t.conv_id AND p.depth <= t.depth GROUP BY p.path)
SELECT t.conv_id, t.depth, a.conv_id AS parent_conv_id, t.n_convs, t.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, t.ends_sha256
FROM told t JOIN sums s USING (path) LEFT JOIN nodes a ON a.path = t.above
"""

OP13_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS vec_id, a.label = r.label AS alike, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_preference_chat": OP5_SQL, "op7_source_mixing": OP7_SQL, "op11_conversation_trie": OP11_SQL, "op13_hard_negatives": OP13_SQL}
