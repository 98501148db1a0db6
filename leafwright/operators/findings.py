"""Findings: raising, combining, counting, gating, questions, groups and measurements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwright.functions.identity import bound_details, row_weight
from leafwright.operators.sequence import first_list
from leafwright.rules import BLOCKING, rules

FINDING = (
    "doc_id string, rule_id string, path string, pos long, "
    "details map<string,string>, kind_id string, fingerprint string"
)


def raise_rule(
    df: DataFrame,
    rule: str | Column,
    doc: str = "doc_id",
    path: Column | None = None,
    pos: Column | None = None,
    details: dict[str, Column] | None = None,
    kind: str | None = None,
    fingerprint: Column | None = None,
) -> DataFrame:
    """One finding per row of ``df`` in the common finding layout."""
    null = F.lit(None).cast("string")
    pairs = [c for k, v in (details or {}).items() for c in (F.lit(k), v.cast("string"))]
    found = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")
    return df.select(
        F.col(doc).cast("string").alias("doc_id"),
        (F.lit(rule) if isinstance(rule, str) else rule).alias("rule_id"),
        (null if path is None else path).alias("path"),
        (F.lit(0) if pos is None else pos).cast("long").alias("pos"),
        bound_details(found).alias("details"),
        F.lit(kind).cast("string").alias("kind_id"),
        (null if fingerprint is None else fingerprint).alias("fingerprint"),
    )


def raise_rules(
    df: DataFrame,
    tests: dict[str, Column],
    doc: str = "doc_id",
    path: Column | None = None,
    pos: Column | None = None,
    details: dict[str, dict[str, Column]] | None = None,
) -> DataFrame:
    """Findings of several rules about the same rows in one pass: one row per rule that holds."""
    empty = F.expr("cast(map() as map<string,string>)")

    def found(rule: str) -> Column:
        pairs = [
            c
            for k, v in ((details or {}).get(rule) or {}).items()
            for c in (F.lit(k), v.cast("string"))
        ]
        return F.struct(
            F.lit(rule).alias("rule_id"),
            (F.create_map(*pairs) if pairs else empty).alias("details"),
        )

    held = F.array_compact(F.array(*[F.when(test, found(rule)) for rule, test in tests.items()]))
    null = F.lit(None).cast("string")
    rows = df.select(
        F.col(doc).cast("string").alias("doc_id"),
        (null if path is None else path).alias("path"),
        (F.lit(0) if pos is None else pos).cast("long").alias("pos"),
        F.explode(held).alias("__f"),
    )
    return rows.select(
        "doc_id", F.col("__f.rule_id").alias("rule_id"), "path", "pos",
        bound_details(F.col("__f.details")).alias("details"),
        null.alias("kind_id"), null.alias("fingerprint"),
    )


def union_findings(*frames: DataFrame) -> DataFrame:
    """All findings with severity and category from the broadcast rule dimension."""
    whole = reduce(lambda a, b: a.unionByName(b), frames)
    return whole.join(rules(whole.sparkSession), "rule_id", "left")


def summary(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Error, warning and info counts per document."""
    count = lambda s: F.count_if(F.col("severity") == s)
    return findings.groupBy(*(by or ["doc_id"])).agg(
        count("error").alias("errors"),
        count("warning").alias("warnings"),
        count("info").alias("info"),
    )


def gate(errors: Column, warnings: Column, strict: Column) -> Column:
    """2 for any error, 1 for a warning under a strict profile, else 0."""
    return F.when(errors > 0, 2).when(strict & (warnings > 0), 1).otherwise(0)


def status_rank(code: Column) -> Column:
    """Precedence of a status: 0, 1, 2, then 4, then 3 (a crash outranks a usage error)."""
    return F.when(code == 3, 4).when(code == 4, 3).otherwise(code)


def combine_status(code: Column) -> Column:
    """The strongest status of a group; 0 for an empty one."""
    return F.coalesce(F.max_by(code, status_rank(code)), F.lit(0))


def split_blocked(findings: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that may be audited further, and those a blocking finding ended."""
    blocked = findings.filter(F.col("rule_id").isin(BLOCKING)).select("doc_id").distinct()
    return docs.join(blocked, "doc_id", "left_anti"), docs.join(blocked, "doc_id", "left_semi")


def open_questions(findings: DataFrame) -> DataFrame:
    """One question per (document, kind, path): its rules in first-seen order, and a conflict flag.

    The list is bounded by the rule dimension; positions are reduced per rule first.
    """
    asked = findings.filter(F.col("kind_id").isNotNull())
    per_rule = asked.groupBy("doc_id", "kind_id", "path", "rule_id").agg(
        F.min("pos").alias("first_pos"),
        F.count("*").alias("n"),
        F.min("fingerprint").alias("low"),
        F.max("fingerprint").alias("high"),
    )
    seen = F.sort_array(F.collect_list(F.struct("first_pos", "rule_id")))
    return per_rule.groupBy("doc_id", "kind_id", "path").agg(
        F.array_join(F.transform(seen, lambda s: s["rule_id"]), ",").alias("rules"),
        F.sum("n").alias("n_findings"),
        (F.min("low") != F.max("high")).alias("conflict"),
        F.min("low").alias("fingerprint"),
    )


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def target_groups(nodes: DataFrame, keys: list[str], order: str, content: Column) -> DataFrame:
    """Nodes that share one target: count, first values and a digest of the whole ordered group.

    The digest sums position-bound row digests, so a group of any size is digested by partial
    aggregation; only the first eight values are listed.
    """
    weighed = nodes.withColumn("__content", content)
    bound = F.concat_ws(":", F.col(order).cast("string"), F.col("__content"))
    whole = weighed.groupBy(*keys).agg(
        F.count("*").alias("n_nodes"),
        F.substring(F.sha2(F.sum(row_weight(bound)).cast("string"), 256), 1, 16).alias("digest"),
    )
    listed = first_list(weighed, keys, [order], F.col("__content"), "values")
    return whole.join(listed, keys)


def merge_facts(facts: DataFrame) -> DataFrame:
    """Latest non-null value per (document, producer, field); null means not measured."""
    return (
        facts.filter(F.col("value").isNotNull())
        .groupBy("doc_id", "producer", "field")
        .agg(F.max_by("value", "pos").alias("value"))
    )


def measure(inspected: DataFrame, rows: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Long-form counts per document.

    Documents inspected without any row measure 0; one marked as not ``inspected`` has null for each field.
    """
    counted = rows.groupBy("doc_id").agg(*[c.alias(n) for n, c in measures.items()])
    if "inspected" not in inspected.columns:
        inspected = inspected.withColumn("inspected", F.lit(True))
    wide = inspected.select("doc_id", "inspected").join(counted, "doc_id", "left")
    value = lambda n: F.when(F.col("inspected"), F.coalesce(n, F.lit(0)).cast("long"))
    filled = wide.select("doc_id", *[value(n).alias(n) for n in measures])
    return filled.unpivot(["doc_id"], list(measures), "field", "value")


def review_topics(observed: DataFrame, topics: DataFrame) -> DataFrame:
    """Topics seen per document, each once, numbered in the canonical topic order."""
    seen = observed.select("doc_id", "topic").distinct().join(topics, "topic")
    w = Window.partitionBy("doc_id").orderBy("topic_order")
    return seen.select("doc_id", "topic", F.row_number().over(w).cast("long").alias("place"))


def version_agreement(parts: DataFrame) -> DataFrame:
    """ODF001 where a document's parts declare different versions, or none at all."""
    agg = parts.groupBy("doc_id").agg(
        F.count_distinct("version").alias("n_versions"),
        F.count_if(F.col("version").isNull()).alias("n_missing"),
        F.count("*").alias("n_parts"),
        F.min("version").alias("low"),
        F.max("version").alias("high"),
    )
    differs = (F.col("n_versions") > 1) | (
        (F.col("n_versions") == 1) & (F.col("n_missing") > 0)
    ) | (F.col("n_versions") == 0)
    return agg.withColumn("rule_id", F.when(differs, "ODF001"))


def manifest_versions(docs: DataFrame) -> DataFrame:
    """ODF002-ODF004: root entry missing, manifest or entry version unlike the document's."""
    unlike = lambda c: F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col("version"))
    found = F.array(
        F.when(unlike("manifest_version"), "ODF003"),
        F.when(~F.col("has_root_entry"), "ODF002"),
        F.when(F.col("has_root_entry") & unlike("entry_version"), "ODF004"),
    )
    return docs.select("doc_id", F.explode(F.array_compact(found)).alias("rule_id"))
