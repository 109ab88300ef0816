"""One query per operator of this subpackage, over the whole ``documents`` table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, classifier, divergence, exact_dedup, fingerprint, licenses, lm_score, mixing, quality_rules, sharding, simhash, token_count
from .common import documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir), threshold=0.8)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    order, _ = quality_rules.plan_cascade(docs)
    return quality_rules.judge(docs, order)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classifier.score_documents(documents(spark, sf_dir), labels)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), shards=16)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), radius=3, size=3)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), limit=4096)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir), keep=["doc_id"])
    return out.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(documents(spark, sf_dir))


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(documents(spark, sf_dir))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir), least_docs=3, top=200)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_bpe": op3_bpe,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_fingerprints": op5_fingerprints,
    "op6_sharding": op6_sharding,
    "op7_simhash": op7_simhash,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_lm_scores": op10_lm_scores,
    "op11_cross_tokenizer": op11_cross_tokenizer,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_source_divergence": op13_source_divergence,
}

OP2_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM docs
), pos AS (
  SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM split
), grams AS (
  SELECT rid, i, CASE WHEN i + 4 <= len(w) THEN array_to_string(w[i : i + 4], ' ') END AS g FROM pos
), flagged AS (
  SELECT rid, i, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY rid, g) > 1 THEN 1 ELSE 0 END AS again FROM grams
), covered AS (
  SELECT rid, max(again) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM flagged
), repeats AS (
  SELECT rid, CAST(sum(c) AS BIGINT) AS n_repeat_words FROM covered GROUP BY rid
), counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         CAST(len(ln) AS BIGINT) AS n_lines, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct_words
  FROM split LEFT JOIN repeats USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 20 * n_words
            OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_distinct_words < 30 * least(n_words, 1000)
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM counts
"""


def _jump_sql(shards: int) -> str:
    """The chain of jumps as one number, 64 * shard + next; all ``shards`` steps of it."""
    u = "(('0x' || substr(md5(key || ':' || i), 1, 8))::BIGINT + 1.0::DOUBLE) / 4294967296.0::DOUBLE"
    step = f"CASE WHEN a % 64 >= {shards} THEN a ELSE (a % 64) * 64 + least(floor((a % 64 + 1)::DOUBLE / ({u})), {shards})::BIGINT END"
    return f"CAST(list_reduce(CAST(range(0, {shards + 1}) AS BIGINT[]), lambda a, i: {step}) // 64 AS INT)"


OP6_SQL = f"""
WITH table_crc AS (
  SELECT list(v ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce([i] || range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))
), docs AS (
  SELECT doc_id, encode(coalesce(text, '')) AS t, coalesce(doc_id::VARCHAR, 'null') AS key FROM documents
), bytes AS (
  SELECT doc_id, key, octet_length(t) AS n, list_transform(regexp_extract_all(hex(t), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM docs
), rows AS (
  SELECT doc_id, key, CAST(n + 1 AS BIGINT) AS size, {_jump_sql(16)} AS shard, {_jump_sql(17)} AS grown_shard,
         CAST(xor(list_reduce([4294967295::BIGINT] || b, lambda a, x: xor(a >> 8, crcs[xor(a & 255, x) + 1])), 4294967295) AS BIGINT) AS text_crc32
  FROM bytes, table_crc
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws(':', key, 'slot', text_crc32, size))[1:8], doc_id NULLS LAST, text_crc32, size) - 1 AS slot
FROM rows
"""

OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, row_number() OVER w = 1 AS kept, h AS text_sha256
FROM docs WINDOW w AS (PARTITION BY h ORDER BY doc_id NULLS LAST, rid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""

#: Every kept term of a language in every group of it, absent ones too.
OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), occurrences AS (
  SELECT rid, lang, source, unnest(ts) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM occurrences GROUP BY lang, term HAVING count(DISTINCT rid) >= 3
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), own AS (
  SELECT lang, source, term, count(*) AS n FROM occurrences SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT d.lang, d.source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN own USING (lang, source) GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
         (1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 1)) // (g.total + l.v)::HUGEINT)::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v)::HUGEINT)::BIGINT AS lang_p
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
), pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(f.value, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  ) f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source
), more AS (
  SELECT lang, source, term AS item, (p - lang_p) * (p - lang_p) // lang_p AS value FROM shares WHERE n > 0 AND p > lang_p
)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value::BIGINT, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM more QUALIFY rank <= 200
"""

ORACLE_SQL: dict[str, str] = {"op2_quality_rules": OP2_SQL, "op6_sharding": OP6_SQL, "op12_exact_dedup": OP12_SQL, "op13_source_divergence": OP13_SQL}
