"""Incremental audit of arriving documents and the progress fold."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from leafwright.plans import workflow
from leafwright.session import Appended, shared_dir, stored

# A later state of a step outranks an earlier one at the same time.
STATE_RANK = {"running": 0, "skipped": 1, "passed": 2, "failed": 3}


def state_rank(state: Column) -> Column:
    whole = None
    for name, rank in STATE_RANK.items():
        whole = F.when(state == name, rank) if whole is None else whole.when(state == name, rank)
    return whole


def stream_table(spark: SparkSession, path: str, name: str, files: int = 1000) -> DataFrame:
    """A given parquet table, one file or a folder of files, as a stream of at most ``files`` files a batch, in its own schema."""
    schema = spark.read.parquet(f"{path}/{name}.parquet").schema
    # a pattern, since a stream takes a plain path for a folder and refuses a file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}/{name}[.]parquet")


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one streaming run below the cluster's shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _drain(stream: DataFrame, write: Callable[[DataFrame, int], None], folder: str, mode: str) -> StreamingQuery:
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


LEDGER = "doc_id string, sha256 string, version string"
RULES_VERSION = "1"


def audit_stream(
    stream: DataFrame, folder: str, audit: Callable[[DataFrame], DataFrame] = workflow.audit, version: str = RULES_VERSION
) -> str:
    """Audit every document that arrives once and keep its findings; returns the findings folder.

    ``stream``: corpus rows (see ``sources.corpus.identify``).  A document is known by its id, the digest of
    its bytes and the version of the rules; a ledger of these lies beside the findings, one folder a batch.
    A document that comes again, in a later batch or after a restart, is left out; a changed one, and any
    under new rules, is audited.  A batch overwrites its own folders and does not look at its own ledger, so
    one that is run again after a lost executor or driver gives the same and leaves no second copy.  Only
    keys meet the ledger; of the documents only those fed twice in one batch are moved.
    """
    findings = f"{folder}/findings"
    key = ["doc_id", "__sha"]

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        ledger = Appended(session, StructType.fromDDL(LEDGER), f"{folder}/ledger")
        # a document refused unread has no digest
        rows = batch.withColumn("__sha", F.coalesce("sha256", F.lit("")))
        arrived = rows.groupBy(*key).agg(F.count("*").alias("__n"))
        if number:
            known = ledger.all().filter((F.col("version") == version) & (F.col("step") < number))
            arrived = arrived.join(known.select("doc_id", F.col("sha256").alias("__sha")), key, "left_anti")
        new = stored(arrived)
        once = rows.join(new.filter("__n = 1").select(*key), key, "left_semi")
        twice = rows.join(new.filter("__n > 1").select(*key), key, "left_semi").dropDuplicates(key)
        audit(once.unionByName(twice).drop("__sha")).write.mode("overwrite").parquet(f"{findings}/batch={number}")
        ledger.add(new.select("doc_id", F.col("__sha").alias("sha256"), F.lit(version).alias("version")), number)

    _drain(stream, write, folder, "append")
    return findings


def progress_query(events: DataFrame, folder: str, delay: str = "1 hour", span: str = "1 day") -> StreamingQuery:
    """Fold the events that are there into updates per item, step and span of time; returns the ended query.

    The state of a span leaves the stream once the watermark, ``delay`` behind the newest event, has passed
    its end; an event later than that is dropped.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    folded = timed.groupBy(F.window("ts", span).alias("span"), "item", "step").agg(
        F.max(F.struct("ts", state_rank(F.col("state")).alias("rank"), "state")).alias("last"), F.count("*").alias("n_events")
    )

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col("span.start").alias("span"), "item", "step", "last", "n_events")
        rows.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    return _drain(folded, write, folder, "update")


def progress_stream(events: DataFrame, folder: str, delay: str = "1 hour", span: str = "1 day") -> str:
    """Fold progress events to the latest state per item and step; returns the folder of updates.

    Each batch writes the spans that changed under its number; ``latest_progress`` puts them together.
    """
    progress_query(events, folder, delay, span)
    return f"{folder}/updates"


def latest_progress(spark: SparkSession, updates: str) -> DataFrame:
    """The latest state of every item and step, of the newest update of each of its spans."""
    newest = spark.read.parquet(updates).groupBy("span", "item", "step").agg(
        F.max_by(F.struct("last", "n_events"), "batch").alias("s")
    )
    return newest.groupBy("item", "step").agg(
        F.max("s.last").alias("last"), F.sum("s.n_events").alias("n_events")
    ).select("item", "step", F.col("last.state").alias("state"), "n_events")
