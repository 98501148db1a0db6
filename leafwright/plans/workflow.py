"""The use cases over whole corpora: audit, plan, remediate, compare, run, batch, verify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.functions import text as words_
from leafwright.functions.identity import percent_encode
from leafwright.functions.uri import is_relative_link
from leafwright.operators import compare as cmp
from leafwright.operators import documents, graph, references, status, structure, update
from leafwright.operators import findings as fo
from leafwright.plans import nodes as odf
from leafwright.plans.families import family_findings
from leafwright.plans import styles as style_plans
from leafwright.plans.targets import named
from leafwright.session import stored
from leafwright.sources.corpus import package_members



def _at(kind: str, pos: Column) -> Column:
    return F.concat(F.lit(f"content/{kind}["), pos.cast("string"), F.lit("]"))


def _package_findings(corpus: DataFrame, members: DataFrame) -> DataFrame:
    unreadable = members.filter("problem IS NOT NULL")
    kept = members.filter("problem IS NULL")
    refused = corpus.filter("NOT admitted")
    shape = documents.audit_package(kept)
    guarded = documents.protection(kept)
    return (
        fo.raise_rule(unreadable, "PKG001")
        .unionByName(fo.raise_rule(refused, "PKG001"))
        .unionByName(fo.raise_rule(documents.package_limits(kept), "PKG001"))
        .unionByName(fo.raise_rule(shape, F.col("rule_id")))
        .unionByName(fo.raise_rule(guarded, F.col("rule_id")))
    )


def _kind_findings(corpus: DataFrame, nodes: DataFrame) -> DataFrame:
    """Media type, body, extension, versions and metadata of every parsed document."""
    attr = lambda n: F.col("attrs")[n]
    tag, root = F.col("tag"), F.col("parent_id").isNull()
    ok = nodes.filter("problem IS NULL")
    entry = tag.eqNullSafe("manifest:file-entry") & (attr("manifest:full-path") == "/")
    under = lambda name: F.col("parent_tag") == name
    pick = lambda test, value: F.max(F.when(test, value))
    agg = ok.groupBy("doc_id").agg(
        pick(root & (F.col("part") == "content"), tag).alias("root"),
        pick(root & (F.col("part") == "content"), attr("office:mimetype")).alias("declared_type"),
        pick(entry, attr("manifest:media-type")).alias("manifest_media_type"),
        F.min_by(F.when(under("office:body"), tag), F.when(under("office:body"), F.col("node_id"))).alias("body"),
        pick(root & (F.col("part") == "content"), attr("office:version")).alias("version"),
        pick(tag == "manifest:manifest", attr("manifest:version")).alias("manifest_version"),
        pick(entry, attr("manifest:version")).alias("entry_version"),
        F.bool_or(F.coalesce(entry, F.lit(False))).alias("has_root_entry"),
        F.bool_or(F.col("part") == "manifest").alias("has_manifest"),
        pick(tag == "dc:title", F.col("text")).alias("title"),
        pick(tag == "dc:language", F.col("text")).alias("declared"),
        F.max(F.when(tag == "style:text-properties", attr("fo:language"))).alias("default_language"),
    )
    extension = F.lower(F.regexp_extract("path", r"(\.[^.]*)$", 1))
    named = corpus.select("doc_id", extension.alias("extension"), odf.is_package(F.col("content")).alias("packed"))
    facts = agg.join(named, "doc_id").withColumn(
        "layout", F.when(F.col("packed"), "package").otherwise("flat")
    ).withColumn("media_type", F.coalesce("declared_type", "manifest_media_type"))
    flat_root = facts.filter("layout = 'flat' AND root <> 'office:document'")
    package_root = facts.filter("layout = 'package' AND root <> 'office:document-content' AND NOT media_type LIKE '%formula%'")
    versions = ok.filter(root & tag.startswith("office:")).select("doc_id", attr("office:version").alias("version"))
    agreed = fo.version_agreement(versions).filter("rule_id IS NOT NULL")
    manifest = fo.manifest_versions(facts.filter("has_manifest"))
    rule = F.col("rule_id")
    return (
        fo.raise_rule(documents.audit_kind(facts), rule)
        .unionByName(fo.raise_rule(flat_root, "ODF011"))
        .unionByName(fo.raise_rule(package_root, "ODF012"))
        .unionByName(fo.raise_rule(agreed, "ODF001"))
        .unionByName(fo.raise_rule(manifest, rule))
        .unionByName(fo.raise_rule(documents.audit_metadata(facts), rule, kind="document.metadata"))
    )


def _text_findings(nodes: DataFrame, styles: DataFrame) -> DataFrame:
    """Headings, links, lists, references, notes, visibility, layout and spacing."""
    attr = lambda n: F.col("attrs")[n]
    body = stored(odf.body(nodes))
    blocks = ["text:h", "text:p", "text:a", "text:note-body"]
    said = stored(odf.words(nodes, blocks))
    flow = body.filter("flow").join(said, ["doc_id", "node_id"], "left")
    pos = F.col("node_id")
    level = F.try_to_number(attr("text:outline-level"), F.lit("99")).cast("int")
    heads = flow.filter("tag = 'text:h'").select("doc_id", pos.alias("pos"), F.coalesce(level, F.lit(0)).alias("level"), "words")
    order = structure.heading_hierarchy(heads).filter("rule_id IS NOT NULL")
    typed = heads.filter(structure.valid_level(F.col("level")) & words_.is_manual_number(F.col("words")))
    texts = body.filter("tag = 'office:text'").select("doc_id").distinct()
    bare = structure.without_headings(texts, heads)
    links = flow.filter(F.col("tag").isin("text:a", "draw:a"))
    silent = links.filter(words_.is_blank(F.col("words")) & words_.is_blank(attr("office:title")))
    raw = links.filter(words_.raw_link_text(F.col("words"), attr("office:title")) & F.array_contains("above", "office:spreadsheet"))
    moving = links.filter(is_relative_link(attr("xlink:href"))).groupBy("doc_id").agg(F.count("*").alias("n"))
    # A paragraph's prose is its own text and the tails of what stands in it, also after a link.
    outside = ~F.array_contains("above", "text:a")
    own = flow.filter(F.col("tag").isin("text:p", "text:h", "text:span") & outside)
    after = body.filter(
        F.col("parent_tag").isin("text:p", "text:h", "text:span") & outside & odf.in_flow() & ~F.col("hidden")
    )
    raw_of = lambda c: F.explode(words_.addresses(F.coalesce(c, F.lit("")))).alias("raw")
    prose = own.select("doc_id", "node_id", raw_of("text")).unionByName(after.select("doc_id", "node_id", raw_of("tail")))
    marked = flow.filter(
        (F.col("tag") == "text:p") & ~F.array_contains("above", "text:list") & words_.typed_marker(F.col("words"))
    )
    broken = styles.filter("family = 'paragraph' AND props['breaks'] = 'true'").select("doc_id", "style", F.lit(True).alias("breaks"))
    blank = body.filter("flow AND tag = 'text:p'").join(said, ["doc_id", "node_id"], "left").withColumn("style", attr("text:style-name"))
    blank = blank.join(broken, ["doc_id", "style"], "left").select(
        "doc_id", F.col("words").alias("text"), "style", F.coalesce("breaks", F.lit(False)).alias("breaks"),
        F.exists("above", lambda t: t.isin("table:table-cell", "draw:text-box", "text:list-item", "office:annotation", "text:note")).alias("protected"),
    )
    lists = odf.lists_of(nodes)
    twice = fo.duplicates(lists.filter("xml_id IS NOT NULL"), ["doc_id", "xml_id"])
    edges = stored(structure.continuations(lists))
    circles = graph.cycles(edges.select("doc_id", F.col("list_id").alias("node"), F.col("continues").alias("next")))
    member = structure.list_membership(
        body.withColumn("continue_numbering", attr("text:continue-numbering")), "text:list", "text:list-item", "text:list-header"
    )
    bad_lists = member.select(
        "doc_id", "node_id", F.explode(F.array_compact(F.array(
            F.when(F.col("list002"), "LIST002"), F.when(F.col("list003"), "LIST003"), F.when(F.col("list004"), "LIST004"),
        ))).alias("rule_id"),
    )
    anchors, refs = odf.anchors_of(nodes), odf.refs_of(nodes)
    lost = references.resolve_refs(refs, anchors.drop("node_id")).filter("rule_id IS NOT NULL")
    classes = references.ref_class(refs.filter("kind = 'note'"), anchors.filter("kind = 'note'").select("doc_id", "name", "note_class"))
    notes = body.filter("flow AND tag = 'text:note'").select("doc_id", pos.alias("note"), attr("text:id").alias("note_id"), attr("text:note-class").alias("note_class"))
    inner = flow.filter(F.col("tag").isin("text:note-citation", "text:note-body")).select(
        "doc_id", F.col("parent_id").alias("note"), "tag", "words"
    ).groupBy("doc_id", "note").agg(
        F.count_if(F.col("tag") == "text:note-citation").alias("n_citations"),
        F.count_if(F.col("tag") == "text:note-body").alias("n_bodies"),
        F.bool_or((F.col("tag") == "text:note-body") & ~words_.is_blank(F.col("words"))).alias("body_filled"),
    )
    checked = references.audit_notes(notes.join(inner, ["doc_id", "note"], "left").fillna(0, ["n_citations", "n_bodies"]))
    local = lambda c: F.split_part(c, F.lit(":"), F.lit(-1))
    short = F.map_from_entries(F.transform(F.map_entries("attrs"), lambda e: F.struct(local(e["key"]), e["value"])))
    seen = documents.audit_visibility(
        body.filter(F.col("tag").isin("text:section", "text:hidden-text", "text:conditional-text", "text:hidden-paragraph"))
        .select("doc_id", pos.alias("pos"), local(F.col("tag")).alias("tag"), short.alias("attrs"))
    )
    floating = (F.col("tag") == "draw:frame") & F.coalesce(attr("text:anchor-type") != "as-char", F.lit(True))
    layout = documents.layout_counts(body.filter("flow"), {"section": F.col("tag") == "text:section", "floating-frame": floating})
    rule, found = F.col("rule_id"), fo.raise_rule
    return fo.union_findings(
        found(order, rule, path=_at("heading", F.col("pos")), pos=F.col("pos"), details={"text": F.col("words")}, kind="heading.level"),
        found(typed, "HEADING004", path=_at("heading", F.col("pos")), pos=F.col("pos"), details={"text": F.col("words")}),
        found(bare, "HEADING005"),
        found(silent, "LINK003", path=_at("link", pos), pos=pos, kind="link.description"),
        found(raw, "LINK002", path=_at("link", pos), pos=pos, details={"text": F.col("words")}),
        found(moving, "NATIVE003", details={"count": F.col("n")}),
        found(prose, "LINK001", path=_at("paragraph", pos), pos=pos, details={"text": words_.split_trailing(F.col("raw"))["token"]}, kind="text.linkify_addresses"),
        found(marked, "LIST009", path=_at("paragraph", pos), pos=pos),
        found(documents.spacers(blank), "STYLE002", details={"count": F.col("n")}, kind="text.remove_spacers"),
        found(twice, "LIST001", details={"id": F.col("xml_id")}),
        found(edges.filter("rule_id IS NOT NULL"), rule, path=_at("list", F.col("list_id")), pos=F.col("list_id")),
        found(circles, "LIST005", path=_at("list", F.col("node")), pos=F.col("node")),
        found(bad_lists, rule, path=_at("list", pos), pos=pos),
        found(lost, rule, path=_at("reference", F.col("pos")), pos=F.col("pos"), details={"target": F.col("name"), "target_kind": F.col("kind")}),
        found(classes, "NOTE002", path=_at("reference", F.col("pos")), pos=F.col("pos")),
        found(checked.filter("note003 > 0"), "NOTE003", details={"note": F.col("note_id")}),
        found(checked.filter("note004 > 0"), "NOTE004", details={"note": F.col("note_id")}),
        found(notes.groupBy("doc_id").agg(F.count("*").alias("n")), "NOTE001", details={"count": F.col("n")}),
        found(seen.filter("NOT coherent"), "ORDER001", path=_at("visibility", F.col("pos")), pos=F.col("pos")),
        found(seen.groupBy("doc_id").agg(F.count("*").alias("n")), "ORDER003", details={"contexts": F.col("n")}),
        found(layout, "ORDER002", details={"kind": F.col("kind"), "count": F.col("n")}),
    )


def _revision_findings(nodes: DataFrame) -> DataFrame:
    """REVISION001-006: tracked regions against the change marks of the current text."""
    attr = lambda n: F.col("attrs")[n]
    local = F.split_part("tag", F.lit(":"), F.lit(-1))
    body = odf.body(nodes)
    kids = body.filter(F.col("tag").isin("text:insertion", "text:deletion", "text:format-change"))
    kinds = kids.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(
        F.count("*").cast("int").alias("n_kinds"), F.min(local).alias("kind")
    )
    regions = body.filter("tag = 'text:changed-region'").join(kinds, ["doc_id", "node_id"], "left").select(
        "doc_id", F.coalesce(attr("xml:id"), attr("text:id"), F.lit("")).alias("id"), attr("text:id").alias("old_id"),
        attr("xml:id").alias("xml_id"), "kind", F.coalesce("n_kinds", F.lit(0)).alias("n_kinds"),
    )
    history = F.exists("above", lambda t: t.isin("text:tracked-changes", "office:annotation"))
    marks = body.filter(F.col("tag").isin("text:change", "text:change-start", "text:change-end") & ~history).select(
        "doc_id", F.coalesce(attr("text:change-id"), F.lit("")).alias("id"), local.alias("mark"),
        F.col("node_id").alias("pos"), "context", F.col("flow").alias("eligible"),
    )
    pairs = references.pair_revisions(regions, marks)
    tests = {"REVISION001": F.col("revision001") > 0} | {f"REVISION00{i}": F.col(f"revision00{i}") for i in range(2, 6)}
    at = F.concat(F.lit("content/revision[name="), percent_encode(F.col("id")), F.lit("]"))
    whole = references.revision_summary(regions, marks)
    return fo.union_findings(
        fo.raise_rules(pairs, tests, path=at),
        fo.raise_rule(whole, "REVISION006", details={"regions": F.col("regions"), "markers": F.col("markers")}),
    )


def _object_findings(nodes: DataFrame) -> DataFrame:
    """Graphics, sheets and blinking styles."""
    attr = lambda n: F.col("attrs")[n]
    ok = nodes.filter("problem IS NULL")
    blink = ok.filter(attr("style:text-blinking") == "true").select("doc_id").distinct()
    body = odf.body(nodes)
    inner = body.filter(F.col("tag").isin("svg:title", "svg:desc", "draw:image", "draw:object", "draw:object-ole"))
    filled = inner.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(
        F.max(F.when(F.col("tag") == "svg:title", F.col("text"))).alias("title"),
        F.max(F.when(F.col("tag") == "svg:desc", F.col("text"))).alias("description"),
        F.bool_or(F.col("tag").startswith("draw:")).alias("payload"),
    )
    frames = body.filter("flow AND tag = 'draw:frame'").join(filled, ["doc_id", "node_id"], "left")
    frames = frames.join(odf.words(nodes, ["draw:frame"]), ["doc_id", "node_id"], "left").select(
        "doc_id", F.col("node_id").alias("graphic_id"), F.lit("frame").alias("kind"), "title", "description",
        F.col("words").alias("visible_text"), F.coalesce("payload", F.lit(False)).alias("payload"),
        F.coalesce(attr("draw:decorative") == "true", F.lit(False)).alias("decorative"),
        F.transform("above", lambda t: F.split_part(t, F.lit(":"), F.lit(-1))).alias("ancestors"),
    )
    frames = stored(frames)
    sheets = body.filter((F.col("tag") == "table:table") & (F.col("parent_tag") == "office:spreadsheet"))
    from leafwright.functions.names import name_rule

    named = sheets.withColumn("rule_id", name_rule(F.coalesce(attr("table:name"), F.lit("")))).filter("rule_id IS NOT NULL")
    rule, gid = F.col("rule_id"), F.col("graphic_id")
    return fo.union_findings(
        fo.raise_rule(blink, "STYLE003"),
        fo.raise_rule(documents.missing_alternative(frames), rule, path=_at("frame", gid), pos=gid, kind="graphic.alternative"),
        fo.raise_rule(documents.decorative_conflict(frames), rule, path=_at("frame", gid), pos=gid),
        fo.raise_rule(named, rule, path=_at("sheet", F.col("ord")), pos=F.col("node_id"), kind="sheet.name"),
    )


def audit(corpus: DataFrame) -> DataFrame:
    """Findings of every document of a corpus (see ``sources.corpus.read_corpus``).

    Package and parse checks come first; a document they block is not read any further.
    """
    packed = corpus.filter(odf.is_package(F.col("content").cast("binary")))
    members = stored(package_members(packed))
    first = _package_findings(corpus, members)
    nodes = odf.document_nodes(corpus)
    broken = nodes.filter("problem IS NOT NULL").select("doc_id", "part")
    early = stored(
        fo.union_findings(first, fo.raise_rule(broken, "XML001", path=F.col("part")), _kind_findings(corpus, nodes))
    )
    open_, _ = fo.split_blocked(early, corpus.select("doc_id"))
    readable = stored(nodes.join(open_, "doc_id", "left_semi"))
    kept = members.filter("problem IS NULL")
    styles = stored(style_plans.effective(readable))
    said = odf.words(readable, ["text:p", "text:h"])
    late = [
        _text_findings(readable, styles), _revision_findings(readable), _object_findings(readable), *family_findings(readable, kept),
        style_plans.style_findings(readable, said, styles), style_plans.hidden_findings(readable, styles),
        style_plans.range_findings(readable), style_plans.resource_findings(readable, kept),
    ]
    whole = late[0]
    for frame in late[1:]:
        whole = whole.unionByName(frame)
    return stored(early.unionByName(named(whole, readable)))


def plan(findings: DataFrame, previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Open questions of the documents that may be planned, and what happens to old answers."""
    open_, _ = fo.split_blocked(findings, findings.select("doc_id").distinct())
    questions = fo.open_questions(findings.join(open_, "doc_id", "left_semi"))
    if previous is None:
        return questions, None
    return questions, update.carry(previous, questions, ["doc_id", "kind_id", "path"])


def remediate(table: DataFrame, bound: DataFrame, key: str, fields: list[str], doc: str) -> dict[str, DataFrame]:
    """Apply bound answers to a table and prove nothing else changed.

    Returns the candidate (documents without a violation only), outcomes, violations and state.
    """
    good = bound.filter("plan_ok AND reason IS NULL") if "plan_ok" in bound.columns else bound
    candidate, outcomes = update.apply_answers(table, good, key, fields)
    allowed = good.select(key, F.lit("edit").alias("permission"))
    wrong = update.preserved(table, candidate, key, fields, allowed)
    owners = table.select(key, F.col(doc).alias("doc_id"))
    failed = outcomes.filter("status = 'failed'").select(key, F.lit("failed").alias("reason"))
    violations = wrong.unionByName(failed).join(owners, key, "left")
    state, kept = update.guarded_candidate(
        owners, candidate.withColumn("doc_id", F.col(doc)), violations.filter("doc_id IS NOT NULL")
    )
    columns = [c for c in candidate.columns]
    return {"candidate": kept.select(*columns), "outcomes": outcomes, "violations": violations, "state": state}


def compare(before: DataFrame, after: DataFrame, links_before: DataFrame, links_after: DataFrame) -> DataFrame:
    """Fidelity findings between two snapshots: text, links, page geometry and page size."""
    pages = lambda f: f.select("doc_id", "page", "width", "height")
    text = cmp.first_diff(before.select("doc_id", "page", "text"), after.select("doc_id", "page", "text"))
    links = cmp.link_diff(links_before, links_after)
    shape = cmp.geometry_diff(pages(before), pages(after))
    large = cmp.oversize(pages(before))
    return fo.union_findings(
        fo.raise_rule(text, "FIDELITY003", details={"position": F.col("position"), "source": F.col("source"), "candidate": F.col("candidate")}),
        fo.raise_rule(links, F.col("rule_id"), details={"uri": F.col("uri"), "count": F.col("n")}),
        fo.raise_rule(shape, F.col("rule_id"), details={"source": F.col("source_pages"), "candidate": F.col("candidate_pages")}),
        fo.raise_rule(large, "FIDELITY007", details={"page": F.col("page")}),
    )


def run(docs: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Stage rows with their status, and one record per run."""
    zero = F.lit(0)
    stages = status.stage_plan(docs).withColumn(
        "status", status.outcome_status(F.col("outcome"), F.lit(1), zero, F.lit(strict))
    )
    return stages, status.failed_stage(stages, ["item"])


def batch(items: DataFrame, runs: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Item states and the one-row summary per batch."""
    joined = items.join(runs.select("item", "exit_status"), "item", "left")
    return status.item_status(joined), status.batch_status(joined, by)


def verify_evidence(recorded: DataFrame, observed: DataFrame) -> DataFrame:
    """Problems of evidence bundles: missing, modified, unlisted, repeated or unsafe files."""
    return cmp.verify_manifest(recorded, observed)
