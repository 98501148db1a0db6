"""Stage outcomes, run and batch roll-ups, stage eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.operators.findings import combine_status, gate
from leafwright.session import literal_frame

# The ordered stages, their least profile level, inputs and the artifact they give.
# Levels: 0 source, 1 pdf, 2 production.
STAGES = [
    (1, "audit-source", 0, [], "audited_source"),
    (2, "export-source", 1, ["audited_source"], "source_pdf"),
    (3, "remediate", 0, ["audited_source"], "candidate"),
    (4, "audit-remediated", 0, ["candidate"], None),
    (5, "export-remediated", 1, ["candidate"], "candidate_pdf"),
    (6, "audit-pdf", 1, ["candidate_pdf"], None),
    (7, "validate-pdf", 2, ["candidate_pdf"], None),
    (8, "fidelity", 1, ["source_pdf", "candidate_pdf"], None),
]
PRODUCER = {artifact: stage for _, stage, _, _, artifact in STAGES if artifact}


def outcome_status(outcome: Column, errors: Column, warnings: Column, strict: Column) -> Column:
    """Exit status of one outcome."""
    return (
        F.when(outcome == "crashed", 3)
        .when(outcome == "refused", 2)
        .when(outcome == "gate-failed", gate(errors, warnings, strict))
        .otherwise(0)
    )


def failed_stage(stages: DataFrame, by: list[str]) -> DataFrame:
    """First failed stage in order, the combined status and whether the run passed."""
    failed = F.col("status") != 0
    return stages.groupBy(*by).agg(
        F.min_by("stage", F.when(failed, F.col("ord"))).alias("failed_stage"),
        combine_status(F.col("status")).alias("exit_status"),
        F.when(F.count_if(failed) > 0, "failed").otherwise("passed").alias("run_status"),
    )


def item_status(items: DataFrame) -> DataFrame:
    """Lifetime of every batch item from its flags and combined status."""
    code = F.when(F.col("interrupted"), 3).otherwise(F.col("exit_status"))
    label = (
        F.when(F.col("interrupted"), "interrupted")
        .when(F.col("exit_status").isNotNull(), F.when(code != 0, "failed").otherwise("completed"))
        .when(F.col("started"), "running")
        .otherwise("pending")
    )
    return items.withColumn("item_status", label).withColumn("exit_status", code)


def batch_status(items: DataFrame, by: list[str]) -> DataFrame:
    """Roll a batch up to counts, the strongest status and the number of pending items.

    Pending identifiers stay rows of ``item_status``; a batch of any size has a one-row summary.
    """
    known = item_status(items)
    agg = known.groupBy(*by).agg(
        F.count("*").alias("n_items"),
        F.count_if(~F.col("started")).alias("n_pending"),
        F.count_if(F.col("item_status") == "failed").alias("n_failed"),
        F.bool_or("interrupted").alias("interrupted"),
        F.bool_and(F.col("exit_status").isNotNull()).alias("complete"),
        combine_status(F.coalesce("exit_status", F.lit(0))).alias("combined"),
    )
    code = F.when(F.col("interrupted"), 3).otherwise(F.col("combined"))
    label = (
        F.when(F.col("interrupted"), "interrupted")
        .when(F.col("complete"), F.when(code != 0, "failed").otherwise("completed"))
        .otherwise("running")
    )
    return agg.select(
        *by, "n_items", "n_pending", "n_failed", code.alias("exit_status"), label.alias("batch_status")
    )


def stage_plan(docs: DataFrame) -> DataFrame:
    """Outcome of each of the eight stages per item.

    ``docs`` holds ``item``, ``level`` and one ``result_<n>`` column per stage with the outcome
    the stage gives when it runs (passed, gate-failed, refused, crashed, not-applicable).  A
    stage is skipped below its profile level or when an input's producer left no artifact; a
    failed gate keeps its artifact, except that a source audit that fails its gate is blocked.
    """
    produced: dict[str, Column] = {}
    frame, stages = docs, []
    for ord_, stage, level, inputs, artifact in STAGES:
        missing = F.lit(None).cast("string")
        for name in reversed(inputs):
            missing = F.when(~produced[name], F.lit(PRODUCER[name])).otherwise(missing)
        reason = F.when(F.col("level") < level, "profile").when(
            missing.isNotNull(), "missing-input"
        )
        outcome = F.when(reason.isNotNull(), "skipped").otherwise(F.col(f"result_{ord_}"))
        frame = frame.withColumn(f"__o{ord_}", outcome)
        stages.append(
            F.struct(
                F.lit(ord_).alias("ord"),
                F.lit(stage).alias("stage"),
                F.col(f"__o{ord_}").alias("outcome"),
                reason.alias("reason"),
                F.when(reason == "missing-input", missing).alias("producer"),
            )
        )
        if artifact:
            produced[artifact] = F.col(f"__o{ord_}") == "passed"
    return frame.select("item", F.explode(F.array(*stages)).alias("s")).select("item", "s.*")


def stage_dimension(spark) -> DataFrame:
    """The eight stages as rows."""
    return literal_frame(
        spark, [(o, s, lvl) for o, s, lvl, _, _ in STAGES], "ord int, stage string, level int"
    )
