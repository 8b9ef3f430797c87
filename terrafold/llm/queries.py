"""The queries of the text operators: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import exact_dedup, jaccard_join, kd_sharding, language_id, packing, piece_bpe, quality_cnn, quality_rules, quotation, source_mixing, toxicity, turn_repair
from terrafold.llm.common import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out("doc_id", 4, 2)))
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2)))
    found = toxicity.score(table(spark, sf_dir, "documents"), model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op3_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.format_conversations(table(spark, sf_dir, "conversations"))


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_sharding.shard(table(spark, sf_dir, "documents"))


def op5_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"), with_ids=False)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality_cnn.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)))
    found = quality_cnn.score(table(spark, sf_dir, "documents"), model)
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), width=4, percent=85)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op10_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piece_bpe.round_trip(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(table(spark, sf_dir, "conversations"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = source_mixing.plan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_quotation": op3_quotation,
    "op4_kd_sharding": op4_kd_sharding,
    "op5_bin_slack_packing": op5_bin_slack_packing,
    "op6_quality_cnn": op6_quality_cnn,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_piece_bpe": op10_piece_bpe,
    "op11_turn_repair": op11_turn_repair,
    "op12_source_mixing": op12_source_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op8_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_points,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               first_value(doc_id) OVER w = doc_id AS kept,
               sha256(norm) AS text_sha256
        FROM d
        WINDOW w AS (PARTITION BY norm ORDER BY n_points DESC, doc_id)
    """,
    "op11_turn_repair": r"""
        WITH RECURSIVE
        keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                                  lambda c: unicode(c)::BIGINT) AS bytes
            FROM conversations),
        hit AS (
            SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, b: list_reduce(
                          list_concat([xor(c, b)], range(8)),
                          lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 20 AS h
            FROM keyed),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
                   CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM hit, (VALUES (1), (2)) AS c(n) WHERE h <> 0 AND (n = 1 OR h = 3)),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
                   count(*) OVER (PARTITION BY conv_id) AS n
            FROM damaged),
        faulted AS (
            SELECT conv_id, i, n, turn, role, text, left(role, 1) AS r,
                   CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                        WHEN regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault,
                   CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 WHEN fault = 'truncated' THEN 1 ELSE 0 END AS m,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS r_before
            FROM placed),
        -- costs to go in the states: nothing yet, after s, after u, after a
        go AS (
            SELECT DISTINCT conv_id, n + 1 AS i, [0, 4, 2, 0] AS c FROM faulted
            UNION ALL
            SELECT conv_id, i, [least(b[1], 2 + b[3], 4 + b[4]), least(b[2], 2 + b[3], 4 + b[4]), least(b[3], 2 + b[4]), least(b[4], 2 + b[3])]
            FROM (
                SELECT f.conv_id, f.i, [
                    least(3 + c[1], m + CASE r WHEN 's' THEN c[2] WHEN 'u' THEN c[3] ELSE 1000000 END, m + 2 + c[3]),
                    least(3 + c[2], m + CASE r WHEN 'u' THEN c[3] ELSE 1000000 END, m + 2 + c[3]),
                    least(3 + c[3], m + CASE r WHEN 'a' THEN c[4] ELSE 1000000 END, m + 2 + c[4]),
                    least(3 + c[4], m + CASE r WHEN 'u' THEN c[3] ELSE 1000000 END, m + 2 + c[3])] AS b
                FROM go JOIN faulted f ON f.conv_id IS NOT DISTINCT FROM go.conv_id AND f.i = go.i - 1)),
        walk AS (
            SELECT DISTINCT conv_id, 1::BIGINT AS i, n, 0 AS g, '' AS audit, []::VARCHAR[] AS turns FROM faulted
            UNION ALL
            SELECT conv_id,
                   CASE letter WHEN 'I' THEN i ELSE i + 1 END, n,
                   CASE WHEN letter = 'D' THEN g WHEN letter = 'K' AND r = 's' THEN 1 ELSE ahead END,
                   audit || letter,
                   CASE letter WHEN 'D' THEN turns WHEN 'I' THEN list_append(turns, waited || ':')
                        WHEN 'K' THEN list_append(turns, role || ':' || text) ELSE list_append(turns, waited || ':' || text) END
            FROM (
                SELECT w.*, f.role, f.text, f.r,
                       CASE g WHEN 2 THEN 3 ELSE 2 END AS ahead, CASE g WHEN 2 THEN 'assistant' ELSE 'user' END AS waited,
                       CASE WHEN 3 + b.c[g + 1] = a.c[g + 1] THEN 'D'
                            WHEN 2 + a.c[ahead + 1] = a.c[g + 1] THEN 'I'
                            WHEN m + CASE WHEN r = 's' AND g = 0 THEN b.c[2] WHEN r = left(waited, 1) THEN b.c[ahead + 1] END = a.c[g + 1] THEN 'K'
                            ELSE 'R' END AS letter
                FROM walk w
                JOIN go a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.i = w.i
                LEFT JOIN go b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.i = w.i + 1
                LEFT JOIN faulted f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i
                WHERE NOT (w.i = w.n + 1 AND a.c[w.g + 1] = 0))),
        ends AS (SELECT * FROM walk WHERE i = n + 1 AND g IN (0, 3)),
        facts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (r_before IS NOT NULL AND r_before || r NOT IN ('su', 'ua', 'au')) AS illegal
            FROM faulted GROUP BY conv_id)
        SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(go.c[1], 0)::BIGINT AS cost,
               coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(turns, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) k
        LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM k.conv_id
        LEFT JOIN go ON go.conv_id IS NOT DISTINCT FROM k.conv_id AND go.i = 1
        LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM k.conv_id
    """,
}
