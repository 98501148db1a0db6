"""Validator reports: failed rules with their first contexts, and consistency of the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHOWN_CHECKS = 8
# Declared, never inferred: inference would turn clause 7.10 into the number 7.1.
REPORT = (
    "_isCompliant string, _jobEndStatus string, _profileName string, "
    "details struct<_failedRules: string, rule: array<struct<_specification: string, "
    "_clause: string, _testNumber: string, _status: string, _failedChecks: string, "
    "description: string, check: array<struct<_status: string, context: string, "
    "errorMessage: string>>>>>"
)


def read_validation(spark: SparkSession, path: str) -> DataFrame:
    """Report rows of every validator file below ``path``."""
    rows = (
        spark.read.format("xml")
        .option("rowTag", "validationReport")
        .schema(REPORT)
        .load(path)
        .withColumn("doc_id", F.input_file_name())
    )
    return rows.withColumn("report", F.struct(*[c for c in rows.columns if c != "doc_id"])).select(
        "doc_id", "report"
    )


def parse_validation(df: DataFrame, xml: str) -> DataFrame:
    """Report rows of a table that holds one report text per row."""
    options = {"rowTag": "validationReport"}
    return df.withColumn("report", F.from_xml(F.col(xml), REPORT, options)).drop(xml)


def _count(value: Column, observed: Column) -> Column:
    clean = F.regexp_replace(F.trim(value), r"^\+", "")
    return F.when(value.isNull(), observed).when(clean.rlike("^[0-9]{1,18}$"), clean.cast("long"))


def failed_rules(reports: DataFrame) -> DataFrame:
    """PDFUA001: one row per failed rule, with at most eight contexts."""
    kept = [c for c in reports.columns if c != "report"]
    rules = reports.select(*kept, F.posexplode("report.details.rule").alias("rule_ord", "r"))
    checks = F.filter(F.coalesce("r.check", F.array()), lambda c: c["_status"] == "failed")
    shown = F.slice(checks, 1, SHOWN_CHECKS)
    text = lambda f: F.transform(shown, lambda c: F.coalesce(F.trim(c[f]), F.lit("")))
    return rules.filter(F.col("r._status") == "failed").select(
        *kept,
        F.col("rule_ord").cast("long").alias("rule_ord"),
        F.coalesce("r._specification", F.lit("")).alias("specification"),
        F.coalesce("r._clause", F.lit("")).alias("clause"),
        F.coalesce("r._testNumber", F.lit("")).alias("test_number"),
        F.coalesce(F.trim("r.description"), F.lit("")).alias("description"),
        _count(F.col("r._failedChecks"), F.size(checks).cast("long")).alias("failed_checks"),
        text("context").alias("contexts"),
        text("errorMessage").alias("messages"),
    )


def report_problem(report: Column) -> Column:
    """Why a report cannot be trusted (an execution failure), or null."""
    failed = F.size(
        F.filter(F.coalesce(report["details"]["rule"], F.array()), lambda r: r["_status"] == "failed")
    )
    declared = _count(report["details"]["_failedRules"], F.lit(None).cast("long"))
    verdict = report["_isCompliant"]
    return (
        F.when(~report["_jobEndStatus"].eqNullSafe(F.lit("normal")), "job ended abnormally")
        .when(~F.coalesce(verdict.isin("true", "false"), F.lit(False)), "malformed verdict")
        .when(report["details"]["_failedRules"].isNull(), "incomplete details")
        .when(declared.isNull(), "malformed count")
        .when((declared != failed) | ((verdict == "true") != (declared == 0)), "inconsistent")
    )


def validate_reports(reports: DataFrame) -> DataFrame:
    """Verdict and trust of every report; an untrusted one is status 3."""
    problem = report_problem(F.col("report"))
    kept = [c for c in reports.columns if c != "report"]
    return reports.select(
        *kept,
        (F.col("report._isCompliant") == "true").alias("compliant"),
        problem.alias("problem"),
        F.when(problem.isNotNull(), 3)
        .when(F.col("report._isCompliant") == "true", 0)
        .otherwise(2)
        .alias("status"),
    )
