"""Runs of audits as an appended table, and reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append_run(findings: DataFrame, path: str, run_id: str) -> None:
    """Add the counts of a run for each workbook; runs are a Parquet table that only grows."""
    counts = findings.groupBy("workbook_id").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warning"), F.count("*").alias("findings"), F.coalesce(F.max("impact"), F.lit(0.0)).alias("at_risk"))
    counts.withColumn("run_id", F.lit(run_id)).withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def latest_runs(runs: DataFrame) -> DataFrame:
    by = Window.partitionBy("workbook_id").orderBy(F.desc("at"), F.desc("run_id"))
    return runs.withColumn("n", F.row_number().over(by)).filter("n = 1").drop("n")


def recent_runs(runs: DataFrame, most: int = 30) -> DataFrame:
    """The latest runs of each workbook, newest first."""
    by = Window.partitionBy("workbook_id").orderBy(F.desc("at"), F.desc("run_id"))
    return runs.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= most).orderBy("workbook_id", "n").drop("n")


def report(findings: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """A JSON report for each workbook: its findings in order of rank, and money at risk (the most, never a sum). What the findings
    have of edits, changes, headlines and traces is in it; stats: a row for each workbook, in the report as it is."""
    more = ("edits", "group_cells", "cells", "impact_cell", "impact_before", "impact_after", "changes", "headlines", "trace", "verified")
    one = F.struct("rank", "rule", "severity", "cell", "title", "confidence", "impact", "fix", "evidence", *[c for c in more if c in findings.columns])
    # Maps have no order: ranks alone sort, and are one a finding.
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("x"))), lambda a, b: a["rank"] - b["rank"]), lambda f: f["x"])
    out = findings.groupBy("workbook_id").agg(listed.alias("findings"), F.coalesce(F.max("impact"), F.lit(0.0)).alias("at_risk"))
    parts = ["at_risk", "findings"]
    if stats is not None:
        held = F.struct(*[c for c in stats.columns if c != "workbook_id"]).alias("stats")
        out, parts = stats.select("workbook_id", held).join(out, "workbook_id", "left").withColumn("at_risk", F.coalesce("at_risk", F.lit(0.0))), ["stats", *parts]
    return out.select("workbook_id", F.to_json(F.struct(*parts)).alias("report"))
