"""Audits a delivery of tables before a run uses them: bad rows are set aside with their reasons, and a report says how
many rows of each part of each table break each rule.

    python -m jobs.delivery_audit --input FOLDER --out PATH [--config jobs/delivery_audit.json]

The config names the tables; for each its key, the column that parts it, rules (a name and an SQL condition that holds for a bad row), and the
tables whose keys it refers to. Rules that need more than the row are built in: `no_key` (a part of the key is missing),
`repeated_key`, `unknown_<table>` (the key is not in that table). Under --out lie

    rows/TABLE   all rows with `reasons` (empty for a good row), by `accepted` and then by the table's part
    report       table, part, rule, n_rows (of the part), n_bad, first_bad (the least key), one row for each rule; by table

Each table is read once for its rows and once for its keys, and written in one pass. Every run replaces what stands under
--out for the tables that it is asked for, so a rerun gives the same result, and a run that was cut short is made good by
the next.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import config, log, start_logging
from terrafold.operators import quarantine

REPORT = "part string, rule string, n_rows long, n_bad long, first_bad string, `table` string"
DEFAULTS = {
    "documents": {"key": ["doc_id"], "part": "source", "rules": {"no_text": r"NOT coalesce(text, '') RLIKE '[^\\x20\\x09-\\x0D]'", "wrong_length": "n_chars IS DISTINCT FROM length(coalesce(text, ''))", "fragment": "length(text) < 100", "no_language": "lang IS NULL"}, "refers": []},
    "labels": {"key": ["doc_id"], "part": "quality", "rules": {"not_a_label": "quality NOT IN (0, 1) OR toxic NOT IN (0, 1)", "no_label": "quality IS NULL AND toxic IS NULL"}, "refers": ["documents"]},
    "conversations": {"key": ["conv_id", "turn"], "part": "role", "rules": {"no_text": r"NOT coalesce(text, '') RLIKE '[^\\x20\\x09-\\x0D]'", "unknown_role": "role NOT IN ('system', 'user', 'assistant')", "late_system_turn": "role = 'system' AND turn > 0"}, "refers": []},
}


def rules_of(rows: DataFrame, plan: dict, others: dict[str, DataFrame]) -> tuple[DataFrame, list[str]]:
    """rows with the reasons that speak against them, and the names of all rules."""
    key = plan["key"]
    missing = F.lit(False)
    for k in key:
        missing = missing | F.col(k).isNull()
    rules = {"no_key": missing, "repeated_key": F.col("_repeated")} | {name: F.expr(text) for name, text in plan["rules"].items()}
    rows = quarantine.repeated(rows, *key, name="_repeated")
    for other in plan["refers"]:
        there = others[other].select(*[F.col(k) for k in key], F.lit(True).alias(f"_in_{other}")).where(~missing).distinct()
        rows = rows.join(there, key, "left")
        rules[f"unknown_{other}"] = F.col(f"_in_{other}").isNull() & ~missing
    judged = quarantine.judged(rows, rules)
    return judged.drop("_repeated", *[f"_in_{x}" for x in plan["refers"]]), list(rules)


def audit(spark: SparkSession, folder: str, out: str, settings: dict | None = None) -> dict:
    """One run over the tables of the settings; returns for each its counts, by rule too."""
    settings = settings or DEFAULTS
    folder, out = folder.rstrip("/"), out.rstrip("/")
    tables = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in settings}
    done = {}
    for name, plan in settings.items():
        judged, rules = rules_of(tables[name], plan, tables)
        part, seen, at = plan["part"], Observation(), f"{out}/rows/{name}"
        marked = quarantine.counted(judged, rules, seen).withColumn("accepted", F.size(quarantine.REASONS) == 0)
        marked.hint("rebalance", "accepted", part).write.mode("overwrite").option("compression", "zstd").partitionBy("accepted", part).parquet(at)
        counts = seen.get
        back = spark.read.schema(marked.schema).parquet(at)
        key = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in plan["key"]])
        each = [F.struct(F.lit(rule).alias("rule"), F.count_if(F.array_contains(quarantine.REASONS, rule)).alias("n_bad"), F.min(F.when(F.array_contains(quarantine.REASONS, rule), key)).alias("first_bad")) for rule in rules]
        sums = back.groupBy(F.col(part).cast("string").alias("part")).agg(F.count(F.lit(1)).alias("n_rows"), F.array(*each).alias("_each"))
        report = sums.select("part", "n_rows", F.explode("_each").alias("_r")).select("part", "_r.rule", "n_rows", "_r.n_bad", "_r.first_bad")
        report.coalesce(1).write.mode("overwrite").parquet(f"{out}/report/table={name}")
        log.info("%s/%s.parquet: %d rows read, %d rejected: %s; written to %s", folder, name, counts["rows"], counts["rejected"], {r: counts[r] for r in rules if counts[r]}, out)
        done[name] = counts
    return done


def result(spark: SparkSession, out: str) -> DataFrame:
    """The report as it stands."""
    return spark.read.schema(REPORT).parquet(f"{out}/report").select(F.col("table").alias("table_name"), "part", "rule", "n_rows", "n_bad", "first_bad")


def main() -> None:
    parse = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("input", "out"):
        parse.add_argument(f"--{name}", required=True)
    parse.add_argument("--config")
    given = parse.parse_args()
    start_logging()
    spark = SparkSession.builder.appName("delivery_audit").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        audit(spark, given.input, given.out, given.config and config(spark, given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
