"""Answers: validation, binding, carry-over, guarded application and its proofs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.functions.identity import fingerprint
from leafwright.functions.language import normalize_language
from leafwright.functions.text import is_blank
from leafwright.operators.sequence import range_ordinal
from leafwright.rules import DECISION_RULES, decision_rules
from leafwright.session import literal_frame

# Fixed value: characters XML 1.0 cannot hold.
NOT_XML = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]"
# Which decision kinds change structure, or need it to stay as reviewed.
STRUCTURE_CHANGES = ["table.headers", "text.linkify_addresses", "text.remove_spacers"]
STRUCTURE_STABLE = ["language.target"]
STABLE_IF_ORDINAL = ["link.description"]


def _constraint(name: str, rule: dict) -> list[Column]:
    """Reasons one field's declared constraints give."""
    value, found = F.col(name), []
    if rule.get("required"):
        found.append(F.when(value.isNull(), f"{name}: required"))
    if rule.get("nonblank"):
        found.append(F.when(value.isNotNull() & is_blank(value), f"{name}: blank"))
    if rule.get("xml"):
        found.append(F.when(value.rlike(NOT_XML), f"{name}: not XML text"))
    if rule.get("language"):
        tag = normalize_language(value)
        bad = value.isNotNull() & (is_blank(value) | tag["problem"].isNotNull())
        found.append(F.when(bad, f"{name}: language"))
    if "pattern" in rule:
        found.append(F.when(~value.rlike(rule["pattern"]), f"{name}: pattern"))
    if "range" in rule:
        low, high = rule["range"]
        found.append(F.when(value < low, f"{name}: low"))
        if high is not None:
            found.append(F.when(value > high, f"{name}: high"))
    if "choices" in rule:
        found.append(F.when(~value.isin(rule["choices"]), f"{name}: choice"))
    return found


def _any(names: list[str]) -> Column:
    """Any non-null field, whatever the types."""
    return F.coalesce(*[F.col(n).cast("string") for n in names])


def validate_answers(
    answers: DataFrame,
    fields: dict[str, dict],
    require_any: list[str] | None = None,
    exclusive: tuple[str, list[str]] | None = None,
) -> DataFrame:
    """Add ``problems``: every reason an answer of one kind is refused, in field order."""
    found = [c for name, rule in fields.items() for c in _constraint(name, rule)]
    if require_any:
        found.append(F.when(_any(require_any).isNull(), "nothing answered"))
    if exclusive:
        switch, others = exclusive
        found.append(F.when(F.col(switch) & _any(others).isNotNull(), f"{switch}: exclusive"))
    return answers.withColumn("problems", F.array_compact(F.array(*found)))


def _left(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """A left join in which null keys meet each other."""
    renamed = others.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return rows.join(renamed, same, "left").drop(*[f"__k_{k}" for k in keys])


def bind_answers(answers: DataFrame, targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Bind every answer to its live target, or say why not.

    ``answers``: plan_id, doc_id, source_sha256, kind_id, path, fingerprint.  ``targets``: doc_id,
    path, fingerprint.  ``sources``: doc_id, sha256.  An answer without a path is about its document: it needs
    no target, and no fingerprint.  One problem refuses its whole plan (``plan_ok``), but every reason is kept.
    """
    live = targets.filter(F.col("path").isNotNull()).groupBy("doc_id", "path").agg(
        F.count("*").alias("__n"), F.min("fingerprint").alias("__fp")
    )
    # the document as a target of its own
    whole = sources.select("doc_id", F.lit(None).cast("string").alias("path")).distinct()
    live = live.unionByName(whole.select("*", F.lit(1).cast("long").alias("__n"), F.lit(None).cast("string").alias("__fp")))
    asked = answers.groupBy("plan_id", "kind_id", "path").agg(F.count("*").alias("__asked"))
    joined = _left(answers.join(sources.select("doc_id", F.col("sha256").alias("__sha")), "doc_id", "left"), live, ["doc_id", "path"])
    joined = _left(joined, asked, ["plan_id", "kind_id", "path"])
    reason = (
        F.when(~F.col("source_sha256").eqNullSafe(F.col("__sha")), "source digest")
        .when(~F.col("kind_id").isin(list(DECISION_RULES)), "unknown kind")
        .when(F.col("__asked") > 1, "answered twice")
        .when(F.col("__n").isNull(), "unknown path")
        .when(F.col("__n") > 1, "ambiguous path")
        .when(~F.col("__fp").eqNullSafe(F.col("fingerprint")), "fingerprint")
    )
    bound = joined.withColumn("reason", reason).drop("__n", "__fp", "__sha", "__asked")
    bad = bound.filter(F.col("reason").isNotNull()).select("plan_id").distinct()
    return bound.join(bad.withColumn("__bad", F.lit(True)), "plan_id", "left").select(
        *bound.columns, F.col("__bad").isNull().alias("plan_ok")
    )


def carry(old: DataFrame, available: DataFrame, keys: list[str]) -> DataFrame:
    """Old answers with the reason they cannot be carried over, null where they can.

    A key may be null, as the path of a question about the document itself, and so may a fingerprint.
    """
    now = available.select(*keys, F.col("fingerprint").alias("__fp"), F.lit(True).alias("__here"))
    joined = _left(old, now, keys)
    reason = F.when(F.col("__here").isNull(), "unavailable").when(
        ~F.col("__fp").eqNullSafe(F.col("fingerprint")), "changed"
    )
    return joined.withColumn("reason", reason).drop("__fp", "__here")


def predict(answers: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings each answer is expected to resolve and those that stay.

    ``answers``: doc_id, kind_id, path.  ``before``/``after``: doc_id, rule_id, path.
    """
    related = answers.join(decision_rules(answers.sparkSession), "kind_id").distinct()
    key = ["doc_id", "rule_id", "path"]
    count = lambda f, n: f.groupBy(*key).agg(F.count("*").alias(n))
    joined = related.join(count(before, "__b"), key, "left").join(count(after, "__a"), key, "left")
    gone = F.when(F.col("__a").isNull(), F.coalesce("__b", F.lit(0))).otherwise(0)
    return joined.groupBy("doc_id", "kind_id", "path").agg(
        F.sum(gone).cast("long").alias("resolved"),
        F.sum(F.coalesce("__a", F.lit(0))).cast("long").alias("remaining"),
    )


def order_plan(answers: DataFrame, kind_order: DataFrame, keys: list[str]) -> DataFrame:
    """Number a plan's answers by kind position, then path; one huge plan is ordered in many tasks."""
    placed = answers.join(kind_order, "kind_id")
    return range_ordinal(placed, keys, ["kind_position", "path"], "place")


def apply_answers(table: DataFrame, bound: DataFrame, key: str, fields: list[str]):
    """Candidate table and outcomes of setting ``fields`` from bound answers (one row per key).

    A null answer field keeps the current value, so applying twice changes nothing.
    """
    new = bound.select(key, *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__hit"))
    joined = table.join(new, key, "left")
    kept = [c for c in table.columns if c not in fields]
    value = {f: F.coalesce(F.col(f"__{f}"), F.col(f)) for f in fields}
    changed = F.lit(False)
    for f in fields:
        changed |= ~value[f].eqNullSafe(F.col(f))
    candidate = joined.select(*kept, *[value[f].alias(f) for f in fields]).select(*table.columns)
    answered = bound.select(key).join(
        joined.filter(F.col("__hit")).select(key, changed.alias("__changed")), key, "left"
    )
    status = F.when(F.col("__changed").isNull(), "failed").otherwise(
        F.when(F.col("__changed"), "applied").otherwise("unchanged")
    )
    outcomes = answered.select(
        key, status.alias("status"), (status == "applied").cast("long").alias("count")
    )
    return candidate, outcomes


def plan_policy(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """Plans whose answers may not be executed together, with the reason.

    ``answers``: plan_id, doc_id, kind_id, path, language.  ``docs``: doc_id, tracked.
    """
    joined = answers.join(docs, "doc_id", "left")
    allowed = (F.col("kind_id") == "document.metadata") & F.col("language").isNull()
    stable = F.col("kind_id").isin(STRUCTURE_STABLE) | (
        F.col("kind_id").isin(STABLE_IF_ORDINAL) & ~F.coalesce(F.col("path").contains("[id="), F.lit(True))
    )
    agg = joined.groupBy("plan_id").agg(
        F.bool_or(F.coalesce("tracked", F.lit(False)) & ~allowed).alias("__tracked"),
        F.bool_or(F.col("kind_id").isin(STRUCTURE_CHANGES)).alias("__changes"),
        F.bool_or(stable).alias("__stable"),
    )
    reason = F.when(F.col("__tracked"), "tracked revisions").when(
        F.col("__changes") & F.col("__stable"), "ordinal targets beside structural edits"
    )
    return agg.select("plan_id", reason.alias("reason"))


def preserved(before: DataFrame, after: DataFrame, key: str, editable: list[str], allowed: DataFrame):
    """Rows that changed, appeared or vanished although the allowance does not cover them.

    ``allowed``: key, permission (edit, create, remove); at most one row per key and permission.
    Only a digest of the protected columns is joined, never the content.
    """
    whole = [c for c in before.columns if c != key]
    fixed = [c for c in whole if c not in editable]
    shape = lambda f, p: f.select(
        key, fingerprint(fixed).alias(f"{p}_fixed"), fingerprint(whole).alias(f"{p}_whole")
    )
    both = shape(before, "b").join(shape(after, "a"), key, "full")
    permit = allowed.groupBy(key).agg(
        F.bool_or(F.col("permission") == "edit").alias("__edit"),
        F.bool_or(F.col("permission") == "create").alias("__create"),
        F.bool_or(F.col("permission") == "remove").alias("__remove"),
    )
    joined = both.join(permit, key, "left")
    ok = lambda c: F.coalesce(c, F.lit(False))
    reason = (
        F.when(F.col("b_whole").isNull() & ~ok("__create"), "created")
        .when(F.col("a_whole").isNull() & ~ok("__remove"), "removed")
        .when(F.col("b_fixed") != F.col("a_fixed"), "protected column")
        .when((F.col("b_whole") != F.col("a_whole")) & ~ok("__edit"), "unlisted row")
    )
    return joined.select(key, reason.alias("reason")).filter(F.col("reason").isNotNull())


def accounting(outcomes: DataFrame, before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Answers that report a change where nothing changed, or none where something did."""
    columns = [c for c in before.columns if c != key]
    left = before.select(key, fingerprint(columns).alias("__b"))
    right = after.select(key, fingerprint(columns).alias("__a"))
    reported = outcomes.groupBy(key).agg(
        F.bool_or(F.col("status") == "applied").alias("reported"),
        F.bool_or(F.col("status") == "failed").alias("failed"),
    )
    joined = reported.join(left, key, "left").join(right, key, "left")
    actual = ~F.col("__a").eqNullSafe(F.col("__b"))
    return joined.select(key, "reported", actual.alias("actual"), "failed").filter(
        (F.col("reported") != F.col("actual")) & ~F.col("failed")
    )


def guarded_candidate(docs: DataFrame, candidate: DataFrame, violations: DataFrame, key: str = "doc_id"):
    """Publication state per document, and the candidate rows of the documents that passed."""
    bad = violations.groupBy(key).agg(F.count("*").alias("n_violations"))
    state = docs.select(key).distinct().join(bad, key, "left").select(
        key,
        F.coalesce("n_violations", F.lit(0)).alias("n_violations"),
        F.when(F.col("n_violations").isNotNull(), "refused").otherwise("preview").alias("state"),
    )
    return state, candidate.join(bad.select(key), key, "left_anti")


def rename_conflicts(names: DataFrame, renames: DataFrame) -> DataFrame:
    """Why a rename is refused, or null.

    ``names``: doc_id, name.  ``renames``: doc_id, old, new.  Letter case never tells names apart.
    """
    have = names.groupBy("doc_id", F.col("name").alias("old")).agg(F.count("*").alias("__same"))
    by_fold = names.groupBy("doc_id", F.lower("name").alias("__new")).agg(
        F.count_distinct("name").alias("__spellings"), F.min("name").alias("__one")
    )
    asked = renames.groupBy("doc_id", F.lower("new").alias("__new")).agg(F.count("*").alias("__to"))
    olds = renames.groupBy("doc_id", F.lower("old").alias("__new")).agg(
        F.count_distinct("old").alias("__olds"), F.min("old").alias("__old_one")
    )
    frame = renames.withColumn("__new", F.lower("new"))
    joined = (
        frame.join(have, ["doc_id", "old"], "left")
        .join(by_fold, ["doc_id", "__new"], "left")
        .join(asked, ["doc_id", "__new"], "left")
        .join(olds, ["doc_id", "__new"], "left")
    )
    taken = (F.col("__spellings") > 1) | (F.col("__one") != F.col("old"))
    chained = (F.col("__olds") > 1) | (F.col("__old_one") != F.col("old"))
    no = F.lit(False)
    reason = (
        F.when(F.col("__same").isNull(), "unknown")
        .when(F.col("__same") > 1, "ambiguous")
        .when(F.coalesce(chained, no), "chained")
        .when(F.col("__to") > 1, "shared target")
        .when((F.col("old") != F.col("new")) & F.coalesce(taken, no), "taken")
    )
    return joined.select("doc_id", "old", "new", reason.alias("reason"))


def excluded_consumers(blocks: DataFrame, selected: DataFrame, changed: DataFrame) -> DataFrame:
    """Styles about to change that blocks outside the selection use as well.

    ``blocks``: doc_id, block_id, style.  ``selected``: doc_id, block_id.  ``changed``: doc_id, style.
    """
    users = blocks.join(changed.distinct(), ["doc_id", "style"], "left_semi")
    outside = users.join(selected, ["doc_id", "block_id"], "left_anti")
    return outside.groupBy("doc_id", "style").agg(F.count("*").alias("n_outside"))


def kind_order(spark, kinds: list[str]) -> DataFrame:
    """Decision kinds in their dependency order."""
    rows = [(kind, place) for place, kind in enumerate(kinds, 1)]
    return literal_frame(spark, rows, "kind_id string, kind_position int")
