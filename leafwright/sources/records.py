"""Strict answer and batch records read with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.functions.names import item_id_problem, relative_path_problem

ANSWER = (
    "title string, description string, text string, name string, language string, western string, "
    "asian string, complex string, level int, rows int, columns int, decorative boolean, "
    "enabled boolean, navigation array<string>"
)
ANSWERS = (
    "plan_id string, doc_id string, source_sha256 string, kind_id string, path string, "
    f"fingerprint string, answer struct<{', '.join(f.replace(' ', ':', 1) for f in ANSWER.split(', '))}>"
)
BATCH_KEYS = ["id", "source", "plan"]


def read_answers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Answers and rejected records of a JSON lines file; an unknown key rejects a record."""
    keys = lambda c: F.map_keys(F.from_json(c, "map<string,string>"))
    names = lambda fields: F.array(*[F.lit(f.split()[0]) for f in fields.split(", ")])
    outer = names(ANSWERS.partition(", answer")[0] + ", answer string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    read = F.from_json("value", ANSWERS + ", _corrupt_record string", options)
    unknown = F.concat(
        F.array_except(keys(F.col("value")), outer),
        F.coalesce(F.array_except(keys(F.get_json_object("value", "$.answer")), names(ANSWER)), F.array()),
    )
    rows = spark.read.text(path).filter(F.trim("value") != "").select("value", read.alias("r"), unknown.alias("__unknown"))
    bad = (
        F.col("r._corrupt_record").isNotNull() | F.col("r.kind_id").isNull()
        | F.coalesce(F.size("__unknown") > 0, F.lit(True))
    )
    good = rows.filter(~bad).select("r.*").drop("_corrupt_record")
    return good, rows.filter(bad).select("r.*", "value").withColumn("_corrupt_record", F.col("value")).drop("value")


def check_batch(raw: DataFrame, record: str = "record", batch: str = "batch_id") -> DataFrame:
    """Batch records with the reason each is refused, null for a good one.

    Keys must be exactly id, source and plan; ids follow their pattern, are not reserved and are
    unique ignoring case; both paths are relative.
    """
    found = F.from_json(F.col(record), "map<string,string>", {"mode": "PERMISSIVE"})
    names = F.array_sort(F.map_keys("__m"))
    parsed = raw.withColumn("__m", found).select(
        "*", *[F.col("__m")[k].alias(k) for k in BATCH_KEYS], names.alias("__keys")
    )
    twice = (
        parsed.groupBy(batch, F.lower("id").alias("__id"))
        .agg(F.count("*").alias("__n"))
        .filter("__n > 1")
    )
    joined = parsed.withColumn("__id", F.lower("id")).join(twice, [batch, "__id"], "left")
    exact = F.array(*[F.lit(k) for k in sorted(BATCH_KEYS)])
    problem = (
        F.when(F.col("__m").isNull(), "malformed")
        .when(F.col("__keys") != exact, "keys")
        .when(item_id_problem(F.col("id")), "id")
        .when(F.col("__n").isNotNull(), "duplicate id")
        .when(
            relative_path_problem(F.col("source")) | relative_path_problem(F.col("plan")), "path"
        )
    )
    kept = [c for c in raw.columns if c != record]
    return joined.select(*kept, *BATCH_KEYS, problem.alias("problem"))


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """Checked batch items of a JSON lines file (one object per item)."""
    return check_batch(spark.read.text(path).select(F.lit(path).alias("batch_id"), F.col("value").alias("record")))
