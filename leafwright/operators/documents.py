"""Checks that filter or count the rows of one document table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.functions.language import normalize_language
from leafwright.functions.names import unsafe_member
from leafwright.functions.text import is_blank
from leafwright.operators.sequence import first_list
from leafwright.session import literal_frame

OASIS = "application/vnd.oasis.opendocument."
# Media type suffix, family, extension, body element, deprecated.
KINDS = [
    ("text", "text", ".odt", "office:text", False),
    ("text-template", "text", ".ott", "office:text", False),
    ("text-master", "text", ".odm", "office:text", False),
    ("text-master-template", "text", ".otm", "office:text", False),
    ("text-web", "text", ".oth", "office:text", False),
    ("spreadsheet", "spreadsheet", ".ods", "office:spreadsheet", False),
    ("spreadsheet-template", "spreadsheet", ".ots", "office:spreadsheet", False),
    ("graphics", "drawing", ".odg", "office:drawing", False),
    ("graphics-template", "drawing", ".otg", "office:drawing", False),
    ("presentation", "presentation", ".odp", "office:presentation", False),
    ("presentation-template", "presentation", ".otp", "office:presentation", False),
    ("chart", "chart", ".odc", "office:chart", False),
    ("chart-template", "chart", ".otc", "office:chart", False),
    ("formula", "formula", ".odf", None, False),
    ("formula-template", "formula", ".otf", None, False),
    ("image", "image", ".odi", "office:image", True),
    ("image-template", "image", ".oti", "office:image", True),
    ("base", "database", ".odb", "office:database", False),
]
# MathML tokens that carry text, and content elements that carry meaning alone.
MATH_TOKENS = ["mi", "mn", "mo", "mtext", "ms", "ci", "cn", "csymbol"]
MATH_VALUES = [
    "integers", "reals", "rationals", "naturalnumbers", "complexes", "primes", "emptyset",
    "exponentiale", "imaginaryi", "notanumber", "true", "false", "pi", "eulergamma", "infinity",
    "set", "list", "vector", "matrix",
]
MATH_EXCLUDED = ["annotation", "annotation-xml", "mphantom"]
VISIBILITY_FIELDS = ["hidden-text", "conditional-text", "hidden-paragraph"]
DECORATIVE_TAGS = ["control", "a", "event-listeners", "event-listener"]
OUT_OF_FLOW = ["annotation", "tracked-changes", "hidden-text", "conditional-text"]


def kinds(spark) -> DataFrame:
    """The 18 document media types (fixed size, broadcast)."""
    rows = [(OASIS + suffix, *rest) for suffix, *rest in KINDS]
    return literal_frame(
        spark,
        rows,
        "media_type string, family string, expected_extension string, expected_body string, "
        "deprecated boolean",
    )


def filled(text: Column) -> Column:
    return ~is_blank(text)


def _rules(frame: DataFrame, keep: list[str], **tests: Column) -> DataFrame:
    """One row per rule whose test holds."""
    found = F.array_compact(F.array(*[F.when(test, rule) for rule, test in tests.items()]))
    return frame.select(*keep, F.explode(found).alias("rule_id"))


def audit_metadata(docs: DataFrame) -> DataFrame:
    """META001-004 from ``title``, ``declared`` and ``default_language``.

    A malformed tag (META004) stops the other language checks of its document.
    """
    tags = docs.withColumn("__d", normalize_language(F.col("declared"))).withColumn(
        "__s", normalize_language(F.col("default_language"))
    )
    wrong = F.col("__d.problem").isNotNull() | F.col("__s.problem").isNotNull()
    absent = F.col("__d.tag").isNull() & F.col("__s.tag").isNull()
    differ = F.coalesce(F.lower("__d.tag") != F.lower("__s.tag"), F.lit(False))
    return _rules(
        tags,
        ["doc_id"],
        META001=is_blank(F.col("title")),
        META004=wrong,
        META002=~wrong & absent,
        META003=~wrong & differ,
    )


def audit_package(members: DataFrame) -> DataFrame:
    """PKG003-PKG010 from the member inventory (doc_id, ord, name, stored, ascii_clean).

    ``ascii_clean`` says whether the member's bytes are ASCII without edge white space.
    """
    mime = F.col("name") == "mimetype"
    agg = members.groupBy("doc_id").agg(
        F.count_if(mime).alias("n_mime"),
        F.min_by("name", "ord").alias("first"),
        F.bool_or(mime & ~F.col("stored")).alias("packed"),
        F.bool_or(mime & ~F.col("ascii_clean")).alias("unclean"),
        F.bool_or(F.col("name") == "META-INF/manifest.xml").alias("manifest"),
        F.bool_or(F.col("name") == "content.xml").alias("content"),
        F.bool_or(F.col("name") == "styles.xml").alias("styles"),
        F.bool_or(F.col("name") == "meta.xml").alias("meta"),
        F.bool_or(unsafe_member(F.col("name"))).alias("unsafe"),
    )
    twice = members.groupBy("doc_id", "name").agg(F.count("*").alias("n")).filter("n > 1")
    doubled = twice.groupBy("doc_id").agg(F.lit(True).alias("doubled"))
    whole = agg.join(doubled, "doc_id", "left")
    doubled_ = F.coalesce("doubled", F.lit(False))
    open_ = ~doubled_ & ~F.col("unsafe")
    has = F.col("n_mime") > 0
    return _rules(
        whole,
        ["doc_id"],
        PKG009=doubled_,
        PKG010=F.col("unsafe"),
        PKG003=open_ & ~has,
        PKG004=open_ & has & F.col("unclean"),
        PKG006=open_ & has & (F.col("first") != "mimetype"),
        PKG007=open_ & has & F.col("packed"),
        PKG008=open_ & ~(F.col("manifest") & F.col("content")),
        PKG005=open_ & ~(F.col("styles") & F.col("meta")),
    )


def package_limits(members: DataFrame, max_members: int = 10_000, max_bytes: int = 256 << 20):
    """Documents whose member count or unpacked size passes the limit (PKG001)."""
    return (
        members.groupBy("doc_id")
        .agg(F.count("*").alias("n_members"), F.sum("size").alias("unpacked"))
        .filter((F.col("n_members") > max_members) | (F.col("unpacked") > max_bytes))
    )


def audit_kind(docs: DataFrame) -> DataFrame:
    """ODF005-ODF009 and PKG002 by lookup in the media type dimension.

    ``docs``: doc_id, layout, media_type, manifest_media_type, body, extension.
    """
    known = docs.join(kinds(docs.sparkSession), "media_type", "left")
    real = F.col("family").isNotNull()
    flat = F.col("layout") == "flat"
    flat_ext = F.concat(F.lit(".f"), F.substr("expected_extension", F.lit(2)))
    fits = F.when(flat, F.col("extension").isin(".xml") | (F.col("extension") == flat_ext)).otherwise(
        F.col("extension") == F.col("expected_extension")
    )
    return _rules(
        known,
        ["doc_id"],
        PKG002=flat & F.col("media_type").isNull(),
        ODF006=~real,
        ODF005=real & (F.col("manifest_media_type") != F.col("media_type")),
        ODF007=real
        & F.col("expected_body").isNotNull()
        & ~F.col("body").eqNullSafe(F.col("expected_body")),
        ODF008=real & ~F.coalesce(fits, F.lit(False)),
        ODF009=real & F.col("deprecated"),
    )


def missing_alternative(graphics: DataFrame) -> DataFrame:
    """GRAPHIC001 for a payload without alternative, GRAPHIC002 for a bare shape.

    Decorative graphics and shapes that show words of their own need none.
    """
    bare = is_blank(F.col("title")) & is_blank(F.col("description")) & ~F.col("decorative")
    wordless = is_blank(F.col("visible_text"))
    rule = F.when(bare & F.col("payload"), "GRAPHIC001").when(bare & wordless, "GRAPHIC002")
    return graphics.withColumn("rule_id", rule).filter(F.col("rule_id").isNotNull())


def decorative_conflict(graphics: DataFrame) -> DataFrame:
    """GRAPHIC003 for an unsafe decorative role, GRAPHIC004 where it keeps alternative text."""
    unsafe = (
        (F.col("kind") == "g")
        | filled(F.col("visible_text"))
        | F.exists("ancestors", lambda a: a.isin(DECORATIVE_TAGS))
    )
    rule = F.when(unsafe, "GRAPHIC003").when(
        filled(F.col("title")) | filled(F.col("description")), "GRAPHIC004"
    )
    return (
        graphics.filter("decorative").withColumn("rule_id", rule).filter(F.col("rule_id").isNotNull())
    )


def link_without_purpose(parts: DataFrame, keys: list[str]) -> DataFrame:
    """LINK003: no text piece, title or described child of a link says anything."""
    agg = parts.groupBy(*keys).agg(
        F.bool_or(filled(F.col("text"))).alias("named"),
        F.bool_or(filled(F.col("title"))).alias("titled"),
        F.bool_or(filled(F.col("description"))).alias("described"),
    )
    return agg.filter(~(F.col("named") | F.col("titled") | F.col("described"))).select(*keys)


def eligible(ancestors: Column, excluded: list[str] = OUT_OF_FLOW) -> Column:
    """Whether none of a node's ancestors (or itself) leaves the current reading flow."""
    return ~F.exists(ancestors, lambda tag: tag.isin(excluded))


def audit_visibility(nodes: DataFrame) -> DataFrame:
    """Visibility contexts with ``coherent``; incoherent ones are ORDER001, any gives ORDER003.

    ``nodes``: doc_id, pos, tag, attrs (map).
    """
    attr = lambda name: F.col("attrs")[name]
    condition, display = attr("condition"), attr("display")
    section = F.col("tag") == "section"
    context = F.col("tag").isin(VISIBILITY_FIELDS) | (
        section & (condition.isNotNull() | F.coalesce(display.isin("none", "condition"), F.lit(False)))
    )
    boolean = lambda c: c.isNull() | c.isin("true", "false", "1", "0")
    section_ok = ((display == "none") & condition.isNull()) | (
        (display == "condition") & filled(condition)
    )
    needs = (
        F.when(
            F.col("tag") == "conditional-text",
            attr("string-value-if-true").isNotNull() & attr("string-value-if-false").isNotNull(),
        )
        .when(F.col("tag") == "hidden-text", attr("string-value").isNotNull())
        .otherwise(True)
    )
    field_ok = filled(condition) & boolean(attr("is-hidden")) & boolean(attr("current-value")) & needs
    coherent = F.coalesce(F.when(section, section_ok).otherwise(field_ok), F.lit(False))
    return nodes.filter(context).withColumn("coherent", coherent)


def layout_counts(nodes: DataFrame, tests: dict[str, Column], doc: str = "doc_id") -> DataFrame:
    """ORDER002: occurrences per declared layout kind and document, zero kinds left out."""
    wide = nodes.groupBy(doc).agg(*[F.count_if(t).alias(k) for k, t in tests.items()])
    return wide.unpivot([doc], list(tests), "kind", "n").filter(F.col("n") > 0)


def spacers(blocks: DataFrame) -> DataFrame:
    """STYLE002: empty free-standing paragraphs: count, with page breaks, first eight styles."""
    empty = blocks.filter(is_blank(F.col("text")) & ~F.col("protected")).withColumn(
        "style", F.coalesce("style", F.lit("(none)"))
    )
    counted = empty.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if("breaks").alias("with_breaks")
    )
    styles = empty.select("doc_id", "style").distinct()
    return counted.join(first_list(styles, ["doc_id"], ["style"], F.col("style"), "styles"), "doc_id")


def blinking(nodes: DataFrame) -> DataFrame:
    """STYLE003: documents in which any element declares blinking text."""
    return nodes.filter(F.col("attrs")["text-blinking"] == "true").select("doc_id").distinct()


def hidden_content(items: DataFrame, styles: DataFrame) -> DataFrame:
    """ORDER003: items hidden by their style or by their own state, counted per class.

    ``items``: doc_id, class, style, state.  ``styles``: doc_id, style, hidden.
    """
    hidden = styles.filter("hidden").select("doc_id", "style").distinct()
    marked = hidden.withColumn("__hidden", F.lit(True))
    joined = items.join(marked, ["doc_id", "style"], "left")
    test = F.coalesce("__hidden", F.lit(False)) | F.coalesce(
        F.col("state").isin("collapse", "filter", "none", "printer"), F.lit(False)
    )
    return joined.groupBy("doc_id", "class").agg(F.count_if(test).alias("n")).filter(F.col("n") > 0)


def audit_math(nodes: DataFrame) -> DataFrame:
    """MATH001-004 per formula document.

    ``nodes``: doc_id, tag, root (boolean), text, alttext, reference, ancestors (tags).
    """
    counts = ~F.col("tag").isin(MATH_EXCLUDED) & ~F.exists(
        "ancestors", lambda a: a.isin(MATH_EXCLUDED)
    )
    meaning = counts & (
        F.col("tag").isin(MATH_VALUES) | (F.col("tag").isin(MATH_TOKENS) & filled(F.col("text")))
    )
    agg = nodes.groupBy("doc_id").agg(
        F.bool_or(F.col("root")).alias("rooted"),
        F.bool_or(meaning).alias("meaning"),
        F.bool_or(F.col("root") & filled(F.col("alttext"))).alias("spoken"),
        F.bool_or(filled(F.col("reference"))).alias("external"),
    )
    root = F.col("rooted")
    return _rules(
        agg,
        ["doc_id"],
        MATH001=~root,
        MATH002=root & ~F.col("meaning"),
        MATH003=root & ~F.col("spoken"),
        MATH004=root & F.col("external"),
    )


def audit_chart(nodes: DataFrame) -> DataFrame:
    """CHART001-004, 006, 008 per chart document.

    ``nodes``: doc_id, tag (chart, series, title, label, description), text, href.
    """
    tag = lambda name: F.col("tag") == name
    words = filled(F.col("text"))
    agg = nodes.groupBy("doc_id").agg(
        F.count_if(tag("chart")).alias("charts"),
        F.count_if(tag("series")).alias("series"),
        F.bool_or(tag("title") & words).alias("titled"),
        F.bool_or(tag("description") & words).alias("described"),
        F.bool_or((tag("label") | tag("title")) & words).alias("labelled"),
        F.bool_or(
            tag("chart") & F.coalesce(~F.col("href").isin(".", "./"), F.lit(False))
        ).alias("external"),
    )
    one = F.col("charts") == 1
    return _rules(
        agg,
        ["doc_id"],
        CHART001=~one,
        CHART002=one & (F.col("series") == 0),
        CHART003=one & ~F.col("titled"),
        CHART004=one & ~F.col("described"),
        CHART006=one & F.col("external"),
        CHART008=one & ~F.col("labelled"),
    )


def audit_image(frames: DataFrame, members: DataFrame) -> DataFrame:
    """IMAGE003-005: one frame, a payload, and every resource embedded or present.

    ``frames``: doc_id, frame_id, href (null without payload), embedded.
    """
    counted = frames.groupBy("doc_id").agg(
        F.count_distinct("frame_id").alias("n"), F.count("href").alias("payloads")
    )
    single = counted.filter(F.col("n") == 1)
    names = members.select("doc_id", F.col("name").alias("href")).distinct()
    lost = (
        frames.filter(F.col("href").isNotNull() & ~F.col("embedded"))
        .join(single.select("doc_id"), "doc_id", "left_semi")
        .join(names, ["doc_id", "href"], "left_anti")
        .groupBy("doc_id")
        .agg(F.count("*").alias("n_findings"))
        .withColumn("rule_id", F.lit("IMAGE005"))
    )
    shape = _rules(
        counted, ["doc_id"], IMAGE003=F.col("n") != 1, IMAGE004=(F.col("n") == 1) & (F.col("payloads") == 0)
    ).withColumn("n_findings", F.lit(1).cast("long"))
    return shape.unionByName(lost)


def audit_database(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """DATABASE001-006 and 010-012 with counts per document.

    ``nodes``: doc_id, tag (database, connection, login, query, component, script), href, user.
    """
    from leafwright.functions.text import has_credentials

    tag = lambda name: F.col("tag") == name
    internal = F.col("href").startswith("sdbc:embedded:")
    agg = nodes.groupBy("doc_id").agg(
        F.count_if(tag("database")).alias("bodies"),
        F.count_if(tag("connection")).alias("connections"),
        F.count_if(tag("connection") & ~internal).alias("external"),
        F.count_if(tag("connection") & internal).alias("internal"),
        F.count_if(tag("connection") & has_credentials(F.col("href"))).alias("secrets"),
        F.bool_or(tag("login") & filled(F.col("user"))).alias("login"),
        F.count_if(tag("query")).alias("queries"),
        F.count_if(tag("component")).alias("components"),
        F.bool_or(tag("script")).alias("scripts"),
    )
    name = F.col("name")
    stored = members.groupBy("doc_id").agg(
        F.bool_or(name.startswith("database/") & ~name.endswith("/")).alias("storage"),
        F.bool_or(name.startswith("Basic/") | name.startswith("Scripts/")).alias("code"),
    )
    whole = agg.join(stored, "doc_id", "left")
    no = F.lit(False)
    one = F.col("bodies") == 1
    zero = F.lit(0).cast("long")
    count = lambda rule, n: F.struct(F.lit(rule).alias("rule_id"), n.cast("long").alias("n"))
    found = F.array(
        count("DATABASE001", F.when(~one, 1).otherwise(0)),
        count("DATABASE002", F.when(one & (F.col("connections") == 0), 1).otherwise(0)),
        count("DATABASE003", F.when(one & ~F.coalesce("storage", no), F.col("internal")).otherwise(zero)),
        count("DATABASE004", F.when(one, F.col("external")).otherwise(zero)),
        count("DATABASE005", F.when(one & F.col("login"), 1).otherwise(0)),
        count("DATABASE006", F.when(one, F.col("secrets")).otherwise(zero)),
        count("DATABASE010", F.when(one & (F.col("scripts") | F.coalesce("code", no)), 1).otherwise(0)),
        count("DATABASE011", F.when(one, F.col("queries")).otherwise(zero)),
        count("DATABASE012", F.when(one, F.col("components")).otherwise(zero)),
    )
    return (
        whole.select("doc_id", F.explode(found).alias("f"))
        .filter(F.col("f.n") > 0)
        .select("doc_id", "f.rule_id", "f.n")
    )


def authentication_settings(settings: DataFrame) -> DataFrame:
    """DATABASE007: documents with any sensitive setting; the value is never carried on."""
    from leafwright.functions.text import sensitive_setting

    hit = sensitive_setting(F.col("name"), F.col("kind"), F.col("value"))
    return settings.filter(hit).select("doc_id").distinct()


def audit_objects(objects: DataFrame) -> DataFrame:
    """DATABASE008 for a path declared more than once, DATABASE009 for one without description."""
    agg = objects.groupBy("doc_id", "path").agg(
        F.count("*").alias("n"), F.bool_or(filled(F.col("description"))).alias("described")
    )
    rule = F.when(F.col("n") > 1, "DATABASE008").when(~F.col("described"), "DATABASE009")
    return agg.withColumn("rule_id", rule).filter(F.col("rule_id").isNotNull())


def audit_pdf_meta(docs: DataFrame) -> DataFrame:
    """PDF002-007, 010, 011 from one extracted metadata row per document."""
    no = F.lit(False)
    return _rules(
        docs,
        ["doc_id"],
        PDF002=is_blank(F.col("title")),
        PDF003=is_blank(F.col("language")),
        PDF004=~F.coalesce("marked", no),
        PDF005=~F.coalesce("has_structure", no),
        PDF006=~F.coalesce("display_title", no),
        PDF007=F.coalesce(F.trim("ua_part") != "1", F.lit(True)),
        PDF010=F.col("pages") == 0,
        PDF011=(F.col("pages") > 0) & (F.col("text_chars") == 0) & (F.col("described_graphics") == 0),
    )


def protection(members: DataFrame) -> DataFrame:
    """PKG011 with its first eight signature members, PKG012 for encrypted packages."""
    base = F.regexp_extract("name", "([^/]*)$", 1)
    signed = members.filter(
        F.col("name").startswith("META-INF/") & base.contains("signatures")
    ).select("doc_id", "name").distinct()
    listed = first_list(signed, ["doc_id"], ["name"], F.col("name"), "members").withColumn(
        "rule_id", F.lit("PKG011")
    )
    locked = members.filter("encrypted").select("doc_id").distinct()
    return listed.unionByName(
        locked.select(
            "doc_id", F.lit(None).cast("array<string>").alias("members"), F.lit("PKG012").alias("rule_id")
        )
    )


def audit_pages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """PAGE001 without pages, PAGE002 without a unique name, PAGE003 without a title."""
    empty = docs.join(pages.select("doc_id").distinct(), "doc_id", "left_anti").select(
        "doc_id", F.lit("PAGE001").alias("rule_id"), F.lit(1).cast("long").alias("n")
    )
    named = pages.groupBy("doc_id", "name").agg(
        F.count("*").alias("n"), F.count_if(is_blank(F.col("title"))).alias("untitled")
    )
    bad_name = (F.coalesce("name", F.lit("")) == "") | (F.col("n") > 1)
    per_doc = named.groupBy("doc_id").agg(
        F.sum(F.when(bad_name, F.col("n")).otherwise(0)).alias("PAGE002"),
        F.sum("untitled").alias("PAGE003"),
    )
    long_ = per_doc.unpivot(["doc_id"], ["PAGE002", "PAGE003"], "rule_id", "n")
    return empty.unionByName(long_.filter(F.col("n") > 0))


def audit_languages(blocks: DataFrame, styles: DataFrame) -> DataFrame:
    """LANG001 where no channel names a language, LANG002 where the style is unresolved.

    ``styles``: doc_id, style, status (null when resolved), western, asian, complex.
    """
    joined = blocks.join(styles, ["doc_id", "style"], "left")
    used = F.col("style").isNotNull()
    missing = used & F.col("known").isNull()
    silent = F.coalesce("western", "asian", "complex").isNull()
    rule = F.when(missing | F.col("status").isNotNull(), "LANG002").when(silent, "LANG001")
    return joined.withColumn("rule_id", rule).filter(F.col("rule_id").isNotNull())


def style_usage(blocks: DataFrame, styles: DataFrame, keys: list[str]) -> DataFrame:
    """Use of every style with its parent and why it cannot be resolved, null where it can (STYLE001).

    ``blocks``: one row per use, with ``keys`` (the last names the style, "" for none).  ``styles``: keys,
    parent, status; one row per key.
    """
    used = blocks.groupBy(*keys).agg(F.count("*").alias("n"))
    joined = used.join(styles.withColumn("__known", F.lit(True)), keys, "left")
    missing = F.col("__known").isNull() & (F.col(keys[-1]) != "")
    return joined.select(*keys, "n", "parent", F.when(missing, "missing").otherwise(F.col("status")).alias("problem"))


def fonts(rows: DataFrame) -> DataFrame:
    """Fonts of each document without their subset tag; embedded if any subset is.

    ``rows``: doc_id, font (as the file names it), embedded.
    """
    name = F.regexp_replace("font", r"^[A-Z]{6}\+", "")
    return rows.groupBy("doc_id", name.alias("font")).agg(F.bool_or("embedded").alias("embedded"))
