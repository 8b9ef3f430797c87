"""The jobs as queries: each runs its job twice into a folder of its own and returns the output as it then stands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import delivery_audit, season_update
from terrafold import queries
from terrafold.sources.files import scratch


def job1_season_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "season-update")
    for _ in range(2):
        season_update.update(spark, f"{sf_dir}/lineitem.parquet", f"{sf_dir}/supplier.parquet", out)
    return season_update.result(spark, out)


def job2_delivery_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "delivery-audit")
    for _ in range(2):
        delivery_audit.audit(spark, sf_dir, out)
    return delivery_audit.result(spark, out)


def _audit_sql(table: str, part: str, key: str, missing: str, rules: dict[str, str]) -> str:
    counts = " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, CAST({part} AS VARCHAR) AS part, '{rule}' AS rule, count(*) AS n_rows, count(*) FILTER ({bad}) AS n_bad, min({key}) FILTER ({bad}) AS first_bad FROM {table}_keyed GROUP BY ALL"
        for rule, bad in ({"no_key": missing, "repeated_key": f"times > 1 AND NOT ({missing})"} | rules).items()
    )
    return counts


_NO_TEXT = r"NOT regexp_matches(coalesce(text, ''), '[^\x20\x09-\x0D]')"
_CONV_KEY = "coalesce(CAST(conv_id AS VARCHAR), '') || ':' || coalesce(CAST(turn AS VARCHAR), '')"
_DOC_KEY = "coalesce(CAST(doc_id AS VARCHAR), '')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_season_update": job1_season_update, "job2_delivery_audit": job2_delivery_audit}

ORACLE_SQL: dict[str, str] = {
    "job1_season_update": queries.SEASON_UPDATE_SQL,
    "job2_delivery_audit": " ".join((
        "WITH documents_keyed AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS times FROM documents),",
        "labels_keyed AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS times FROM labels),",
        "conversations_keyed AS (SELECT *, count(*) OVER (PARTITION BY conv_id, turn) AS times FROM conversations)",
        _audit_sql("documents", "source", _DOC_KEY, "doc_id IS NULL", {
            "no_text": _NO_TEXT, "wrong_length": "n_chars IS DISTINCT FROM length(coalesce(text, ''))", "fragment": "length(text) < 100", "no_language": "lang IS NULL",
        }),
        "UNION ALL",
        _audit_sql("labels", "quality", _DOC_KEY, "doc_id IS NULL", {
            "not_a_label": "quality NOT IN (0, 1) OR toxic NOT IN (0, 1)", "no_label": "quality IS NULL AND toxic IS NULL",
            "unknown_documents": "doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels_keyed.doc_id)",
        }),
        "UNION ALL",
        _audit_sql("conversations", "role", _CONV_KEY, "conv_id IS NULL OR turn IS NULL", {
            "no_text": _NO_TEXT, "unknown_role": "role NOT IN ('system', 'user', 'assistant')", "late_system_turn": "role = 'system' AND turn > 0",
        }),
    )),
}
