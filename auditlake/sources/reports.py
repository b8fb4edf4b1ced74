"""Stored reports: findings and scores as tables, reports as JSON, ledgers of proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT = "id long, score int, findings array<struct<dimension: string, severity: string, title: string>>"


def write_findings(findings: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by dimension, so that reports of one dimension read its files only."""
    findings.write.mode(mode).partitionBy("dimension").parquet(path)


def write_scores(scores: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet of one row a run; scores are narrow, so they aren't partitioned by value."""
    scores.write.mode(mode).parquet(path)


def to_report_json(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """(id, blob): each run (id, score) with its findings (run_id, seq, dimension, severity, title) in order, as JSON.

    A report holds its run's findings only, which are what one document of the service holds. A run without findings
    has an empty list.
    """
    entry = F.struct("dimension", "severity", "title")
    lists = findings.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", entry.alias("f")))), lambda x: x["f"]).alias("findings"))
    both = runs.join(lists, runs["id"] == lists["run_id"], "left")
    none = F.array().cast("array<struct<dimension:string,severity:string,title:string>>")
    return both.select("id", F.to_json(F.struct("id", "score", F.coalesce("findings", none).alias("findings"))).alias("blob"))


def read_reports(blobs: DataFrame) -> DataFrame:
    """(run_id, score, dimension, severity, title): one row a finding of every blob that is JSON of a report; others give no rows."""
    r = blobs.select(F.from_json("blob", REPORT).alias("r")).where("r.id is not null")
    return r.select(F.col("r.id").alias("run_id"), F.col("r.score").alias("score"), F.explode("r.findings").alias("f")).select("run_id", "score", "f.*")


def read_ledger(lines: DataFrame) -> DataFrame:
    """(entry_date, state, title, risk, evidence) of bullet lines (value) with five parts between bars; other lines are skipped."""
    parts = F.transform(F.split(F.regexp_replace("value", r"^\s*[-*]\s*", ""), r"\|", -1), lambda x: F.trim(x))
    p = lines.where(F.col("value").rlike(r"^\s*[-*]\s")).select(parts.alias("p")).where("size(p) = 5")
    fields = [F.col("p")[0].try_cast("date").alias("entry_date"), *[F.col("p")[i].alias(n) for i, n in enumerate(("state", "title", "risk", "evidence"), 1)]]
    return p.select(*fields).where("entry_date is not null")
