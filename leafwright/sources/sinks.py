"""Findings tables, report lines, SARIF rows and guarded publication."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.functions.identity import percent_encode
from leafwright.functions.names import safe_label
from leafwright.operators.findings import summary
from leafwright.operators.sequence import BLOCK, ordinal, running_sum, scan

REPORT_VERSION = 1
PART_RESULTS = 10_000


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings as parquet, one folder per category."""
    findings.write.mode("errorifexists").partitionBy("category").parquet(path)


def report_lines(findings: DataFrame, docs: DataFrame, kind: str) -> DataFrame:
    """One JSON line per document with its counts.

    Findings themselves stay rows (``finding_lines``), so a document with any number of findings
    is never folded into one value.
    """
    counts = docs.select("doc_id").distinct().join(summary(findings), "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    filled = counts.select("doc_id", zero("errors"), zero("warnings"), zero("info"))
    body = F.struct(
        F.lit(REPORT_VERSION).alias("schema_version"),
        F.lit(kind).alias("kind"),
        F.col("doc_id").alias("subject"),
        F.struct("errors", "warnings", "info").alias("summary"),
    )
    return filled.withColumn("report", F.to_json(body))


def finding_lines(findings: DataFrame) -> DataFrame:
    """One JSON line per finding."""
    body = F.struct("rule_id", "severity", "category", "path", "details")
    return findings.select("doc_id", "pos", F.to_json(body).alias("finding"))


def sarif_rules(findings: DataFrame, run: str) -> DataFrame:
    """Distinct sorted rules per run with their index (bounded by the rule dimension)."""
    from pyspark.sql import Window

    seen = findings.select(run, "rule_id", "severity", "category").distinct()
    place = F.row_number().over(Window.partitionBy(run).orderBy("rule_id")) - 1
    return seen.withColumn("rule_index", place.cast("long"))


def sarif_artifacts(findings: DataFrame, run: str, order: str, uri: str, block=BLOCK) -> DataFrame:
    """Distinct artifacts per run, numbered by a scan over the distinct rows only."""
    seen = findings.select(run, order, uri).distinct()
    numbered = ordinal(seen, [run], order, "__n", block)
    return numbered.select(run, order, uri, (F.col("__n") - 1).alias("artifact_index"))


def sarif(findings: DataFrame, run: str, order: str, uri: str, block=BLOCK) -> DataFrame:
    """SARIF result rows per run with rule and artifact index.

    Free text never leaves: only rule, level, category and the logical location.  Results with an
    unsafe label are marked instead of written.
    """
    rules_ = sarif_rules(findings, run)
    artifacts = sarif_artifacts(findings, run, order, uri, block)
    level = F.when(F.col("severity") == "info", "note").otherwise(F.col("severity"))
    joined = findings.join(rules_.select(run, "rule_id", "rule_index"), [run, "rule_id"]).join(
        artifacts.select(run, order, "artifact_index"), [run, order]
    )
    return joined.select(
        run,
        "rule_id",
        "rule_index",
        "artifact_index",
        level.alias("level"),
        "category",
        "path",
        safe_label(F.col("path")).alias("safe"),
        percent_encode(F.col(uri)).alias("uri"),
        "pos",
    )


def sarif_parts(results: DataFrame, run: str, order: list[str], size: int = PART_RESULTS, block=BLOCK):
    """SARIF external result files: bounded JSON arrays, as many per run as it needs."""
    counted = scan(
        results, [run], order, {"__n": running_sum(F.lit(1).cast("long"), False)}, block
    ).withColumn("part", F.floor(F.col("__n") / size))
    body = F.to_json(
        F.struct(
            F.col("rule_id").alias("ruleId"),
            F.col("rule_index").alias("ruleIndex"),
            "level",
            F.array(
                F.struct(
                    F.struct(
                        F.struct(F.col("artifact_index").alias("index")).alias("artifactLocation")
                    ).alias("physicalLocation"),
                    F.array(F.struct(F.col("path").alias("fullyQualifiedName"))).alias(
                        "logicalLocations"
                    ),
                )
            ).alias("locations"),
            F.struct("category").alias("properties"),
        )
    )
    listed = F.sort_array(F.collect_list(F.struct("__n", body.alias("json"))))
    joined = F.array_join(F.transform(listed, lambda s: s["json"]), ",")
    return counted.groupBy(run, "part").agg(
        F.count("*").alias("n_results"), F.concat(F.lit("["), joined, F.lit("]")).alias("results")
    )


def _commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, manifest) of every commit file, by number; one is a line, so they are few and short."""
    files = _files(spark, path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    if not files.exists(folder):
        return []
    numbers = sorted(int(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().isdigit())
    if not numbers:
        return []
    texts = spark.read.text([f"{path}/commits/{n:09d}" for n in numbers], wholetext=True)
    named = texts.select("value", F.col("_metadata.file_name").alias("name")).toArrow().to_pylist()
    by_name = {row["name"]: row["value"] for row in named}
    return [(n, by_name.get(f"{n:09d}", "")) for n in numbers]


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _manifest(text: str) -> dict | None:
    """A commit's manifest; null for one whose writer was lost before its end."""
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) and found.get("complete") else None


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the newest complete commit; null where nothing has been published."""
    for _, text in reversed(_commits(spark, path)):
        manifest = _manifest(text)
        if manifest:
            return spark.read.parquet(f"{path}/{manifest['folder']}")
    return None


def stage(df: DataFrame, path: str) -> dict:
    """First phase: write the rows where no reader looks; returns what a commit needs."""
    base = max((n for n, _ in _commits(df.sparkSession, path)), default=-1)
    folder = f"versions/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    return {"folder": folder, "base": base}


def commit(spark: SparkSession, path: str, staged: dict, *, replace: bool = False) -> str:
    """Second phase: make staged rows the published ones by creating the next commit file.

    The file is created only if it is not there (the file system must be able to tell, as HDFS is), so of two
    publishers that staged on the same base one is refused.  A commit whose writer was lost before its end
    does not count, and a lost publisher leaves nothing that a reader sees.
    """
    known = _commits(spark, path)
    if any(n > staged["base"] for n, _ in known) or (not replace and any(_manifest(t) for _, t in known)):
        return "REFUSED"
    jvm = spark._jvm
    name = jvm.org.apache.hadoop.fs.Path(f"{path}/commits/{staged['base'] + 1:09d}")
    try:
        out = _files(spark, path).create(name, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in str(error.java_exception):
            return "REFUSED"
        raise
    out.write(bytearray(json.dumps({"folder": staged["folder"], "complete": True}).encode()))
    out.close()
    return "PUBLISHED"


def publish(df: DataFrame, path: str, violations: DataFrame | None = None, *, replace=False, dry_run=False):
    """Publish ``df`` unless something forbids it; returns PUBLISHED, PREVIEW or REFUSED.

    An existing destination is refused unless it may be replaced, any violation refuses, and a dry run
    writes nothing.  Readers (see ``published``) have the old rows until the commit and the new ones after.
    """
    if violations is not None and not violations.isEmpty():
        return "REFUSED"
    if dry_run:
        return "PREVIEW"
    spark = df.sparkSession
    foreign = _files(spark, path).exists(spark._jvm.org.apache.hadoop.fs.Path(path)) and not _commits(spark, path)
    if not replace and (foreign or any(_manifest(text) for _, text in _commits(spark, path))):
        return "REFUSED"
    return commit(spark, path, stage(df, path), replace=replace)
