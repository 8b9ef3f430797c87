"""The jobs over growing and broken input, and the rules that set rows and series aside."""

import datetime as dt
import json
import subprocess
import sys

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from jobs import common, delivery_audit, season_update
from terrafold.operators import quarantine, season

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lineitem(spark, tmp_path_factory):
    """Observations of few points, as a copy that can grow: a function that gives the path of those before a day."""
    folder = f"file://{tmp_path_factory.mktemp('observations')}"
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").where("l_shipdate >= '1999-01-01'").withColumn("l_suppkey", F.col("l_suppkey") % 4 + 1).cache()

    def until(day=None, **more):
        path = f"{folder}/{day}-{len(more)}"
        some = rows if day is None else rows.where(F.col("l_shipdate") < F.lit(day).cast("timestamp"))
        for column, value in more.items():
            some = some.withColumn(column, value)
        some.write.mode("overwrite").parquet(path)
        return path

    return until


def state(spark, out):
    """All tables of a season store, as sorted rows."""
    return {t: sorted(map(str, spark.read.parquet(f"{out}/{t}").collect())) for t in ("daily", "rejected", "seasons", "coverage", "mark")}


def files(spark, path):
    return sorted(r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime").collect())


def test_seasons_over_growing_input(spark, lineitem, tmp_path):
    points = f"{DATA}/supplier.parquet"
    out, once = f"file://{tmp_path}/grown", f"file://{tmp_path}/once"
    first = season_update.update(spark, lineitem("2000-09-15"), points, out)
    assert (first["taken_from"], first["taken_to"]) == (dt.date(1999, 1, 1), dt.date(2000, 9, 14))
    old = files(spark, f"{out}/daily")
    second = season_update.update(spark, lineitem(), points, out)
    assert second["taken_from"] == dt.date(2000, 9, 1) and second["days"] < first["days"]
    # months that were whole are not written again
    kept = [f for f in files(spark, f"{out}/daily") if "year=1999" in f]
    assert kept and set(kept) <= set(old)
    season_update.update(spark, lineitem(), points, once)
    assert state(spark, out) == state(spark, once)
    # nothing new: nothing is written
    before = files(spark, out)
    assert season_update.update(spark, lineitem(), points, out)["days"] == 0
    assert files(spark, out) == before


def test_a_run_cut_short_is_made_good(spark, lineitem, tmp_path, monkeypatch):
    points, out, once = f"{DATA}/supplier.parquet", f"file://{tmp_path}/cut", f"file://{tmp_path}/once"
    season_update.update(spark, lineitem("2000-09-15"), points, out)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="lost"):
        m.setattr(season, "reduce_seasons", broken)
        season_update.update(spark, lineitem(), points, out)
    season_update.update(spark, lineitem(), points, out)
    season_update.update(spark, lineitem(), points, once)
    assert state(spark, out) == state(spark, once)


def test_late_rows_are_taken_from_a_day_on(spark, lineitem, tmp_path):
    points, out, once = f"{DATA}/supplier.parquet", f"file://{tmp_path}/late", f"file://{tmp_path}/once"
    season_update.update(spark, lineitem(), points, out)
    changed = lineitem(l_quantity=F.when(F.col("l_shipdate") >= "2001-02-01", F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    assert season_update.update(spark, changed, points, out)["days"] == 0
    season_update.update(spark, changed, points, out, since=dt.date(2001, 2, 10))
    season_update.update(spark, changed, points, once)
    assert state(spark, out) == state(spark, once)


def test_rejected_series_are_reported_and_come_back(spark, lineitem, tmp_path):
    points, out, once = f"{DATA}/supplier.parquet", f"file://{tmp_path}/bad", f"file://{tmp_path}/once"
    bad = lineitem(l_quantity=F.when((F.col("l_suppkey") == 2) & (F.year("l_shipdate") == 2000), None).otherwise(F.col("l_quantity")))
    found = season_update.update(spark, bad, points, out)
    rejected = spark.read.parquet(f"{out}/rejected").where("id IS NOT NULL").collect()
    assert found["rejected"] == len(rejected) > 0 and {r["id"] for r in rejected} == {2}
    assert all(r["reasons"] == ["no_value"] and 0 < r["n_bad"] <= r["n_rows"] for r in rejected)
    gone = {(r["season"], r["region"]) for r in rejected}
    good = season_update.result(spark, out).collect()
    assert good and not [r for r in good if r["id"] == 2 and (r["year"], r["region"]) in gone]
    season_update.update(spark, lineitem(), points, out, since=dt.date(1999, 1, 1))
    season_update.update(spark, lineitem(), points, once)
    assert state(spark, out) == state(spark, once)


def test_season_update_of_nothing(spark, lineitem, tmp_path):
    out = f"file://{tmp_path}/none"
    assert season_update.update(spark, lineitem("1990-01-01"), f"{DATA}/supplier.parquet", out)["days"] == 0
    assert common.written(spark, f"{out}/mark", season_update.MARK) is None


DOCS = [(1, "a" * 120, "en", "s", 120), (2, None, "en", "s", 0), (3, "short", None, "t", 9), (3, "b" * 100, "de", "t", 100), (None, "c" * 100, "de", None, 100)]


def delivery(spark, folder):
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (9, 2, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 0, "bot", "x"), (1, 2, "system", " ")], "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{folder}/conversations.parquet")


def test_audit_sets_bad_rows_aside(spark, tmp_path):
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    delivery(spark, folder)
    counts = delivery_audit.audit(spark, folder, out)
    assert (counts["documents"]["rows"], counts["documents"]["rejected"]) == (5, 4)
    docs = {(r["doc_id"], r["n_chars"]): (r["accepted"] == "true", r["reasons"]) for r in spark.read.parquet(f"{out}/rows/documents").collect()}
    assert docs == {
        (1, 120): (True, []), (2, 0): (False, ["no_text"]), (3, 9): (False, ["repeated_key", "wrong_length", "fragment", "no_language"]),
        (3, 100): (False, ["repeated_key"]), (None, 100): (False, ["no_key"]),
    }
    report = {(r["table_name"], r["part"], r["rule"]): (r["n_rows"], r["n_bad"], r["first_bad"]) for r in delivery_audit.result(spark, out).collect()}
    assert report["documents", "t", "repeated_key"] == (2, 2, "3") and report["documents", None, "no_key"] == (1, 1, "")
    assert report["labels", "2", "unknown_documents"] == (1, 1, "9") and report["labels", "2", "not_a_label"] == (1, 1, "9")
    assert report["labels", None, "no_label"] == (1, 1, "2") and report["conversations", "system", "late_system_turn"] == (1, 1, "1:2")
    # a rerun, and one over a delivery that has been mended, leave what one run would
    before = sorted(map(str, report.items()))
    delivery_audit.audit(spark, folder, out)
    assert sorted(str(((r["table_name"], r["part"], r["rule"]), (r["n_rows"], r["n_bad"], r["first_bad"]))) for r in delivery_audit.result(spark, out).collect()) == before
    spark.createDataFrame(DOCS[:1], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    delivery_audit.audit(spark, folder, out)
    assert [(r["doc_id"], r["accepted"] == "true") for r in spark.read.parquet(f"{out}/rows/documents").collect()] == [(1, True)]


def test_configs_say_what_the_jobs_do_without(spark):
    here = str(common.__file__).rsplit("/", 1)[0]
    assert common.config(spark, f"file://{here}/delivery_audit.json") == delivery_audit.DEFAULTS
    assert common.config(spark, f"file://{here}/season_update.json") == season_update.DEFAULTS


def test_command_line(tmp_path):
    """A run of its own, by module and config file, twice."""
    conf = tmp_path / "conf.json"
    conf.write_text(json.dumps({"labels": delivery_audit.DEFAULTS["labels"], "documents": delivery_audit.DEFAULTS["documents"]}))
    root = str(common.__file__).rsplit("/", 2)[0]
    for _ in range(2):
        run = subprocess.run([sys.executable, "-m", "jobs.delivery_audit", "--input", DATA, "--out", f"file://{tmp_path}/out", "--config", f"file://{conf}"], cwd=root, capture_output=True, text=True, timeout=300)
        assert run.returncode == 0, run.stderr[-2000:]
        assert "rows read" in run.stderr
    assert (tmp_path / "out" / "report" / "table=labels").exists() and not (tmp_path / "out" / "report" / "table=conversations").exists()


def test_rules_and_counts_in_one_pass(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, None), (3, -1.0)], "id long, value double")
    rules = {"missing": F.col("value").isNull(), "negative": F.col("value") < 0}
    seen = Observation()
    got = {r["id"]: r["reasons"] for r in quarantine.counted(quarantine.judged(rows, rules), list(rules), seen).collect()}
    assert got == {1: [], 2: ["missing"], 3: ["negative"]}
    assert seen.get == {"rows": 3, "rejected": 2, "missing": 1, "negative": 1}
    assert quarantine.judged(rows, {}).where("size(reasons) = 0").count() == 3


def test_series_are_judged_whole(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 9), (2, "a", 1), (2, "a", 2), (3, "a", 3), (None, "a", 9)], "id long, date string, value int")
    rules = {"high": F.col("value") > 5}
    report = quarantine.series_report(rows, ("id",), rules, unique="date")
    assert {r["id"]: (r["reasons"], r["n_bad"], r["n_rows"]) for r in report.collect()} == {1: (["high"], 1, 2), 2: (["repeated"], 2, 2), None: (["high"], 1, 1)}
    assert [r["id"] for r in quarantine.without(rows, report, "id").collect()] == [3]
    assert {r["id"] for r in quarantine.series_report(rows, ("id",), rules).collect()} == {1, None}
    marked = quarantine.repeated(rows, "id", "date")
    assert sorted((r["id"] or 0, r["repeated"]) for r in marked.collect()) == [(0, False), (1, False), (1, False), (2, True), (2, True), (3, False)]
