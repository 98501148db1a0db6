"""References, ranges, revisions, notes, links, marked content and resources.

Every join here has one side reduced to a single row per key, so a hot key can only repeat on the
other side, where adaptive execution splits it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.operators.sequence import first_list


def resolve_refs(refs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Destination state of every reference.

    A destination outside the reading flow wins over missing and ambiguous; the three states are
    never merged.  A missing link name that holds a bar is producer-specific, hence REF004.
    """
    counted = anchors.groupBy("doc_id", "kind", "name").agg(
        F.count_if("in_flow").alias("__in"),
        F.count_if(~F.col("in_flow")).alias("__out"),
        F.max("note_class").alias("anchor_class"),
    )
    joined = refs.join(counted, ["doc_id", "kind", "name"], "left")
    n_in, n_out = F.coalesce("__in", F.lit(0)), F.coalesce("__out", F.lit(0))
    rule = (
        F.when(n_out > 0, "REF004")
        .when(n_in > 1, "REF002")
        .when(
            n_in == 0,
            F.when((F.col("kind") == "link") & F.col("name").contains("|"), "REF004").otherwise(
                "REF001"
            ),
        )
    )
    return joined.withColumn("rule_id", rule).drop("__in", "__out")


def ref_class(refs: DataFrame, notes: DataFrame) -> DataFrame:
    """NOTE002: a reference to exactly one note names another class than the note has."""
    unique = (
        notes.groupBy("doc_id", "name")
        .agg(F.count("*").alias("__n"), F.min("note_class").alias("owner_class"))
        .filter(F.col("__n") == 1)
        .drop("__n")
    )
    joined = refs.join(unique, ["doc_id", "name"])
    differs = F.col("note_class").isNotNull() & ~F.col("note_class").eqNullSafe(F.col("owner_class"))
    return joined.filter(differs)


def pair_ranges(markers: DataFrame, keys: list[str]) -> DataFrame:
    """REF003 per name: owners (points and starts) against ends.

    A start needs exactly one later end in its context, a point needs none, a name is unique and
    not blank, and ends need an owner.
    """
    is_ = lambda m: F.col("mark") == m
    agg = markers.groupBy(*keys).agg(
        F.count_if(~is_("end")).alias("owners"),
        F.count_if(is_("start")).alias("starts"),
        F.count_if(is_("end")).alias("ends"),
        F.min(F.when(is_("start"), F.col("pos"))).alias("start_pos"),
        F.min(F.when(is_("end"), F.col("pos"))).alias("end_pos"),
        F.min_by("context", F.when(is_("start"), F.col("pos"))).alias("start_context"),
        F.min_by("context", F.when(is_("end"), F.col("pos"))).alias("end_context"),
    )
    paired = (
        (F.col("ends") == 1)
        & (F.col("end_pos") > F.col("start_pos"))
        & (F.col("end_context") == F.col("start_context"))
    )
    valid = (
        (F.col("owners") == 1)
        & (F.col(keys[-1]) != "")
        & F.when(F.col("starts") == 1, F.coalesce(paired, F.lit(False))).otherwise(F.col("ends") == 0)
    )
    wrong = (
        F.when(F.col("owners") == 0, F.col("ends"))
        .when(~valid, F.col("owners"))
        .otherwise(F.lit(0).cast("long"))
    )
    return agg.select(*keys, "owners", "ends", wrong.alias("n_findings"))


def pair_revisions(regions: DataFrame, marks: DataFrame) -> DataFrame:
    """REVISION001-005 per change identity.

    ``regions``: doc_id, id, old_id, xml_id, kind, n_kinds.  ``marks``: doc_id, id, mark, pos,
    context, eligible.
    """
    well_formed = (
        (F.coalesce("id", F.lit("")) != "")
        & (F.col("old_id").isNull() | F.col("xml_id").isNull() | (F.col("old_id") == F.col("xml_id")))
        & (F.col("n_kinds") == 1)
    )
    declared = regions.groupBy("doc_id", "id").agg(
        F.count("*").alias("n_regions"),
        F.count_if(~well_formed).alias("n_malformed"),
        F.min("kind").alias("kind"),
        F.min("n_kinds").alias("n_kinds"),
    )
    is_ = lambda m: F.col("mark") == m
    marked = marks.groupBy("doc_id", "id").agg(
        F.count("*").alias("n_marks"),
        F.count_if(is_("change")).alias("n_points"),
        F.count_if(is_("change-start")).alias("n_starts"),
        F.count_if(is_("change-end")).alias("n_ends"),
        F.min(F.when(is_("change-start"), F.col("pos"))).alias("start_pos"),
        F.min(F.when(is_("change-end"), F.col("pos"))).alias("end_pos"),
        F.min_by("context", F.when(is_("change-start"), F.col("pos"))).alias("start_context"),
        F.min_by("context", F.when(is_("change-end"), F.col("pos"))).alias("end_context"),
        F.count_if(~F.col("eligible")).alias("n_hidden"),
    )
    both = declared.join(marked, ["doc_id", "id"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    n_regions, n_marks = zero(F.col("n_regions")), zero(F.col("n_marks"))
    point = (F.col("n_marks") == 1) & (F.col("n_points") == 1)
    span = (
        (F.col("n_marks") == 2)
        & (F.col("n_starts") == 1)
        & (F.col("n_ends") == 1)
        & (F.col("start_pos") < F.col("end_pos"))
        & (F.col("start_context") == F.col("end_context"))
    )
    fits = (F.col("n_kinds") == 1) & F.when(F.col("kind") == "deletion", point).otherwise(span)
    return both.select(
        "doc_id",
        "id",
        zero(F.col("n_malformed")).alias("revision001"),
        (
            (n_regions > 0)
            & (n_marks > 0)
            & ((n_regions != 1) | ~F.coalesce(fits, F.lit(False)))
        ).alias("revision002"),
        ((n_marks > 0) & (n_regions != 1)).alias("revision003"),
        ((n_regions > 0) & (n_marks == 0)).alias("revision004"),
        ((n_regions > 0) & (zero(F.col("n_hidden")) > 0)).alias("revision005"),
    )


def revision_summary(regions: DataFrame, marks: DataFrame) -> DataFrame:
    """REVISION006: documents with any tracked region or mark, and how many."""
    left = regions.groupBy("doc_id").agg(F.count("*").alias("regions"))
    right = marks.groupBy("doc_id").agg(F.count("*").alias("markers"))
    both = left.join(right, "doc_id", "full")
    return both.select(
        "doc_id",
        F.coalesce("regions", F.lit(0)).alias("regions"),
        F.coalesce("markers", F.lit(0)).alias("markers"),
    )


def audit_notes(notes: DataFrame) -> DataFrame:
    """NOTE003 and NOTE004 per note identity.

    ``notes``: doc_id, note_id, note_class, n_citations, n_bodies, body_filled.
    """
    complete = (
        (F.coalesce("note_id", F.lit("")) != "")
        & (F.col("n_citations") == 1)
        & (F.col("n_bodies") == 1)
        & F.coalesce("body_filled", F.lit(False))
    )
    agg = notes.groupBy("doc_id", "note_id").agg(
        F.count("*").alias("n_notes"), F.count_if(~complete).alias("note003")
    )
    repeated = (F.coalesce("note_id", F.lit("")) != "") & (F.col("n_notes") > 1)
    return agg.withColumn("note004", F.when(repeated, F.col("n_notes")).otherwise(0))


def note_classes(notes: DataFrame) -> DataFrame:
    """NOTE001: notes per class and document."""
    named = F.coalesce(F.nullif(F.col("note_class"), F.lit("")), F.lit("unknown"))
    return notes.groupBy("doc_id", named.alias("note_class")).agg(F.count("*").alias("n"))


def link_structure(annots: DataFrame, elements: DataFrame) -> DataFrame:
    """PDF017-PDF020 per document: counts and the first eight objects of each.

    ``annots``: doc_id, annot_ref, page_ref, contents.  ``elements``: doc_id, node_id, object_ref,
    page_ref, alt (one row per object reference).
    """
    text = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    known = annots.filter(F.col("annot_ref").isNotNull()).select(
        "doc_id", F.col("annot_ref").alias("object_ref"), F.col("page_ref").alias("own_page")
    ).dropDuplicates(["doc_id", "object_ref"])
    hits = elements.join(known, ["doc_id", "object_ref"], "left")
    foreign = F.col("page_ref").isNotNull() & ~F.col("page_ref").eqNullSafe(F.col("own_page"))
    mapped = (
        hits.filter(F.col("own_page").isNotNull())
        .groupBy("doc_id", F.col("object_ref").alias("annot_ref"))
        .agg(F.bool_or(foreign).alias("__foreign"), F.bool_or(text(F.col("alt"))).alias("__alt"))
    )
    seen = annots.join(mapped, ["doc_id", "annot_ref"], "left")
    orphan = (
        hits.groupBy("doc_id", "node_id")
        .agg(F.bool_or(F.col("own_page").isNotNull()).alias("__known"))
        .filter(~F.col("__known"))
        .select("doc_id", F.lit("PDF018").alias("rule_id"), F.col("node_id").alias("ref"))
    )
    found = F.array_compact(
        F.array(
            F.when(F.col("__foreign").isNull(), "PDF017"),
            F.when(F.col("__foreign"), "PDF019"),
            F.when(~text(F.col("contents")) & ~F.coalesce("__alt", F.lit(False)), "PDF020"),
        )
    )
    problems = seen.select(
        "doc_id", F.explode(found).alias("rule_id"), F.col("annot_ref").alias("ref")
    ).unionByName(orphan)
    counted = problems.groupBy("doc_id", "rule_id").agg(F.count("*").alias("n"))
    listed = first_list(problems, ["doc_id", "rule_id"], ["ref"], F.col("ref"), "first_refs")
    return counted.join(listed, ["doc_id", "rule_id"])


def reconcile_content(content: DataFrame, refs: DataFrame) -> DataFrame:
    """PDF021-PDF023 per (document, stream, marked content id).

    Both sides are reduced to one row per id before the full outer join.
    """
    keys = ["doc_id", "stream_ref", "mcid"]
    have = content.groupBy(*keys).agg(F.count("*").alias("n_content"))
    want = refs.groupBy(*keys).agg(F.count("*").alias("n_refs"))
    both = have.join(want, keys, "full")
    found = F.array_compact(
        F.array(
            F.when(F.col("n_refs").isNull(), "PDF021"),
            F.when(F.col("n_content").isNull(), "PDF022"),
            F.when(F.col("n_refs") > 1, "PDF023"),
        )
    )
    return both.select(
        *keys, F.coalesce("n_refs", F.lit(0)).alias("n_refs"), F.explode(found).alias("rule_id")
    )


def unmarked_text(streams: DataFrame) -> DataFrame:
    """PDF024: pages that show text outside tagged content and artifacts."""
    return streams.filter(F.col("unmarked_text_ops") > 0)


def missing_resources(hrefs: DataFrame, members: DataFrame) -> DataFrame:
    """References whose file, or embedded sub-document folder, is not in the package.

    ``hrefs``: doc_id, href, member, folder (whether a folder will do).  Folders are matched by
    their ``content.xml`` member, so the test stays an equi join.
    """
    names = members.select("doc_id", F.col("name").alias("__file")).distinct()
    wanted = F.when(F.col("folder"), F.array("member", F.concat("member", F.lit("/content.xml"))))
    tries = hrefs.withColumn("__try", wanted.otherwise(F.array("member")))
    asked = tries.filter(F.col("member").isNotNull()).select(
        "doc_id", "href", F.explode("__try").alias("__file")
    ).distinct()
    found = asked.join(names, ["doc_id", "__file"], "left_semi").select("doc_id", "href").distinct()
    return hrefs.join(found, ["doc_id", "href"], "left_anti")


def figures(nodes: DataFrame) -> DataFrame:
    """PDF008: figures without alternative, with the first eight of all and of the missing."""
    blank = F.coalesce(F.trim("alt") == "", F.lit(True))
    marked = nodes.filter(F.col("role") == "Figure").withColumn("__missing", blank)
    counted = marked.groupBy("doc_id").agg(
        F.count("*").alias("n_figures"), F.count_if("__missing").alias("n_missing")
    ).filter(F.col("n_missing") > 0)
    all_ = first_list(marked, ["doc_id"], ["node_id"], F.col("node_id"), "first_figures")
    miss = first_list(
        marked.filter("__missing"), ["doc_id"], ["node_id"], F.col("node_id"), "first_missing"
    )
    return counted.join(all_, "doc_id").join(miss, "doc_id")


def name_referenced(names: DataFrame, values: DataFrame) -> DataFrame:
    """Names some attribute value may refer to, without testing every name against every value.

    A value refers to ``name`` if ``name.`` occurs in it, plain or quoted, or if it is a link to
    the bare name.  A match always ends at a dot, so for every dot the text before it is cut to
    each name length the document has and the pieces are joined to the names by equality.

    ``names``: doc_id, name.  ``values``: doc_id, value.
    """
    quoted = F.concat(F.lit("'"), F.replace("name", F.lit("'"), F.lit("''")), F.lit("'"))
    spelled = names.select(
        "doc_id", "name", F.explode(F.array(F.lower("name"), F.lower(quoted))).alias("spelling")
    )
    lengths = spelled.groupBy("doc_id").agg(
        F.collect_set(F.length("spelling")).alias("__lengths")  # bounded by the longest name
    )
    lowered = values.select("doc_id", F.lower("value").alias("value"))
    sized = lowered.join(lengths, "doc_id")
    # Read backwards, the text before a dot is the text after it, which a lookahead can take for
    # every dot in one pass, however long the value is.
    widest = F.array_max("__lengths").cast("string")
    backwards = F.reverse("value")
    pattern = F.concat(F.lit(r"(?s)\.(?=(.{0,"), widest, F.lit("}))"))
    heads = F.regexp_extract_all(backwards, pattern, F.lit(1))
    before = sized.filter(F.col("value").contains(".")).select(
        "doc_id", "__lengths", F.explode(F.array_distinct(heads)).alias("__head")
    )
    pieces = before.select("doc_id", "__head", F.explode("__lengths").alias("__len")).filter(
        F.length("__head") >= F.col("__len")
    )
    dotted = pieces.select("doc_id", F.reverse(F.left("__head", F.col("__len"))).alias("spelling"))
    linked = lowered.filter(F.col("value").startswith("#")).select(
        "doc_id", F.substr("value", F.lit(2)).alias("spelling")
    )
    hits = dotted.unionByName(linked).distinct()
    return spelled.join(hits, ["doc_id", "spelling"], "left_semi").select("doc_id", "name").distinct()


def dynamic_reference(formula: Column) -> Column:
    """A formula that builds references at run time."""
    return formula.rlike(r"(?i)\b(?:INDIRECT|ADDRESS|HYPERLINK)\s*\(")
