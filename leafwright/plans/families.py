"""Checks of tables, sheets, pages, formulas, charts, images and databases over node rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.functions.identity import parse_range
from leafwright.functions.text import is_blank
from leafwright.operators import documents, graph, grids, structure
from leafwright.operators import findings as fo
from leafwright.plans import nodes as odf
from leafwright.session import stored

CELLS = ["table:table-cell", "table:covered-table-cell"]
SHAPES = ["draw:frame", "draw:rect", "draw:ellipse", "draw:circle", "draw:line", "draw:polygon", "draw:polyline",
          "draw:path", "draw:custom-shape", "draw:connector", "draw:g", "draw:control", "draw:page-thumbnail"]
SETTINGS = {"db:data-source-setting": "db:data-source-setting-name", "config:config-item": "config:name"}


def _attr(name: str) -> Column:
    return F.col("attrs")[name]


def _count(name: str) -> Column:
    """A declared repeat or span; one without or with an unusable declaration."""
    return F.greatest(F.coalesce(_attr(name).try_cast("long"), F.lit(1)), F.lit(1))


def _local(tag: Column) -> Column:
    return F.split_part(tag, F.lit(":"), F.lit(-1))


def _under(name: str) -> Column:
    return F.array_contains("above", name)


def _at(kind: str, pos: Column) -> Column:
    return F.concat(F.lit(f"content/{kind}["), pos.cast("string"), F.lit("]"))


def table_cells(body: DataFrame, said: DataFrame) -> DataFrame:
    """Cells with logical position (1-based), spans, header state, value type and words."""
    owner = odf.nearest("table:table")
    inside = lambda wrapper: F.coalesce(odf.nearest(wrapper) > owner, F.lit(False))
    key = ["doc_id", "table_id"]
    rows = body.filter("flow AND tag = 'table:table-row'").select(
        "doc_id", owner.alias("table_id"), F.col("node_id").alias("row_id"),
        _count("table:number-rows-repeated").alias("row_repeat"), inside("table:table-header-rows").alias("row_header"),
    )
    rows = structure.logical_runs(rows, key, "row_id", "row_repeat").withColumnsRenamed({"run_start": "y", "run_end": "y_end"})
    columns = body.filter("flow AND tag = 'table:table-column'").select(
        "doc_id", owner.alias("table_id"), "node_id", _count("table:number-columns-repeated").alias("n"),
        inside("table:table-header-columns").alias("header"),
    )
    wide = structure.leading_headers(columns, key, "node_id", F.col("header"), "n").select(*key, F.col("leading").alias("header_columns"))
    declared = columns.groupBy(*key).agg(F.sum("n").alias("declared_columns"))
    cells = body.filter("flow").filter(F.col("tag").isin(CELLS)).select(
        "doc_id", "node_id", F.col("parent_id").alias("row_id"), F.col("context"), _under("office:spreadsheet").alias("sheet"),
        _count("table:number-columns-repeated").alias("col_repeat"), _count("table:number-rows-spanned").alias("row_span"),
        _count("table:number-columns-spanned").alias("col_span"), (F.col("tag") == CELLS[1]).alias("covered"),
        F.coalesce(_attr("office:value-type"), F.when(_attr("table:formula").isNotNull(), "float")).alias("value_type"),
    )
    cells = structure.logical_runs(cells, ["doc_id", "row_id"], "node_id", "col_repeat").withColumnsRenamed({"run_start": "x", "run_end": "x_end"})
    placed = cells.join(rows, ["doc_id", "row_id"]).join(wide, key, "left").join(declared, key, "left").join(said, ["doc_id", "node_id"], "left")
    placed = placed.withColumn("header_columns", F.coalesce("header_columns", F.lit(0)))
    header = F.col("row_header") | (F.col("x") <= F.col("header_columns"))
    spans = F.col("covered") | (F.col("row_span") > 1) | (F.col("col_span") > 1)
    return stored(placed.withColumn("is_header", header).withColumn("spans", spans))


def table_findings(cells: DataFrame) -> DataFrame:
    """TABLE001-003 of the tables of text documents, TABLE004-005 of sheets."""
    key = ["doc_id", "table_id"]
    written = cells.filter("NOT sheet")
    kinds = grids.classify_tables(written).filter("rule_id IS NOT NULL")
    sizes = written.groupBy(*key).agg(F.max("y_end").alias("rows"), F.max("x_end").alias("columns"))
    # Only tables with spans are looked at.  A run of plain cells is one rectangle; merged and covered cells
    # are spelled out where they repeat.
    merged = written.join(written.filter("spans").select(*key).distinct(), key, "left_semi")
    spread = lambda a, b: F.explode(F.sequence(F.col(a), F.col(b)))
    plain = merged.filter("NOT spans").withColumns(
        {"row_span": F.col("y_end") - F.col("y") + 1, "col_span": F.col("x_end") - F.col("x") + 1}
    )
    spelled = merged.filter("spans").withColumn("y", spread("y", "y_end")).withColumn("x", spread("x", "x_end"))
    single = plain.unionByName(spelled)
    zero = single.withColumn("y", F.col("y") - 1).withColumn("x", F.col("x") - 1)
    broken = grids.grid_coverage(sizes, zero).unionByName(grids.row_widths(written))
    unsafe = broken.select(*key).distinct()
    sheets = grids.data_sheets(
        cells.filter("sheet").select(
            "doc_id", F.col("table_id").alias("sheet"), F.col("y").alias("row"), F.col("words").alias("text"),
            F.col("row_header").alias("header_row"), ((F.col("row_span") > 1) | (F.col("col_span") > 1)).alias("merged"),
        )
    )
    tid, sid, rule = F.col("table_id"), F.col("sheet"), F.col("rule_id")
    return fo.union_findings(
        fo.raise_rule(kinds.join(unsafe, key, "left_anti"), rule, path=_at("table", tid), pos=tid, details={"classification": F.col("kind")}, kind="table.headers"),
        fo.raise_rule(broken, "TABLE002", path=_at("table", tid), pos=tid, details={"reason": F.col("reason")}),
        fo.raise_rule(sheets, rule, path=_at("sheet", sid), pos=sid),
    )


def sheet_findings(body: DataFrame, cells: DataFrame) -> DataFrame:
    """SHEET003 for empty sheets after the last filled one."""
    sheets = body.filter((F.col("tag") == "table:table") & (F.col("parent_tag") == "office:spreadsheet"))
    shown = cells.filter("sheet").groupBy("doc_id", F.col("table_id").alias("node_id")).agg(
        F.bool_or(~is_blank(F.col("words"))).alias("filled")
    )
    drawn = body.filter(F.col("tag").startswith("draw:") & _under("office:spreadsheet"))
    drawn = drawn.groupBy("doc_id", odf.nearest("table:table").alias("node_id")).agg(F.lit(True).alias("drawn"))
    both = sheets.join(shown, ["doc_id", "node_id"], "left").join(drawn, ["doc_id", "node_id"], "left")
    no = F.lit(False)
    empty = ~F.coalesce("filled", no) & ~F.coalesce("drawn", no)
    trailing = structure.trailing_empty(both, "doc_id", "node_id", empty)
    return fo.union_findings(fo.raise_rule(trailing, "SHEET003", path=_at("sheet", F.col("ord")), pos=F.col("node_id")))


def page_findings(body: DataFrame) -> DataFrame:
    """PAGE001-005 of presentations and drawings."""
    kinds = ["office:presentation", "office:drawing"]
    docs = body.filter(F.col("tag").isin(kinds)).select("doc_id").distinct()
    pages = body.filter("tag = 'draw:page'")
    titles = body.filter("tag = 'svg:title'").select("doc_id", F.col("parent_id").alias("node_id"), F.col("text").alias("title"))
    titles = titles.groupBy("doc_id", "node_id").agg(F.max("title").alias("title"))
    named = pages.join(titles, ["doc_id", "node_id"], "left").withColumn("name", _attr("draw:name"))
    listed = pages.select("doc_id", F.col("node_id").alias("page_id"), _attr("draw:nav-order").alias("nav_order"))
    shapes = body.filter(F.col("tag").isin(SHAPES) & (F.col("parent_tag") == "draw:page")).select(
        "doc_id", F.col("parent_id").alias("page_id"), F.coalesce(_attr("xml:id"), _attr("draw:id")).alias("shape_id")
    )
    order = graph.navigation(
        listed.withColumn("declared", F.col("nav_order").isNotNull()), graph.listed_shapes(listed), shapes
    ).filter("rule_id IS NOT NULL")
    pid = F.col("page_id")
    return fo.union_findings(
        fo.raise_rule(documents.audit_pages(docs, named), F.col("rule_id"), details={"count": F.col("n")}, kind="page.metadata"),
        fo.raise_rule(order, F.col("rule_id"), path=_at("page", pid), pos=pid, kind="page.navigation"),
    )


def math_findings(nodes: DataFrame) -> DataFrame:
    """MATH001-004 of formula documents: a MathML root, a meaning, spoken text, no outside content."""
    ok = nodes.filter("problem IS NULL AND part = 'content'")
    above = F.transform(F.map_keys("nearest"), _local)
    docs = ok.filter((F.col("tag") == "math:math") & F.col("parent_id").isNull()).select("doc_id").distinct()
    rows = ok.join(docs, "doc_id", "left_semi").select(
        "doc_id", _local(F.col("tag")).alias("tag"), F.col("parent_id").isNull().alias("root"), "text", _attr("alttext").alias("alttext"),
        F.coalesce(_attr("href"), _attr("src"), _attr("altimg"), _attr("xlink:href")).alias("reference"), above.alias("ancestors"),
    )
    return fo.union_findings(fo.raise_rule(documents.audit_math(rows), F.col("rule_id"), path=F.lit("content/formula"), kind="formula.alternative"))


def chart_findings(body: DataFrame, said: DataFrame, nodes: DataFrame) -> DataFrame:
    """CHART001-004, 006-008 of chart documents."""
    inside = body.filter(_under("office:chart"))
    tag = F.col("tag")
    kind = (
        F.when(tag == "chart:chart", "chart").when(tag == "chart:series", "series").when(_under("chart:title"), "title")
        .when((tag == "text:p") & _under("table:table-cell"), "label")
    )
    rows = inside.join(said, ["doc_id", "node_id"], "left").select(
        "doc_id", kind.alias("tag"), F.col("words").alias("text"), _attr("xlink:href").alias("href")
    )
    meta = nodes.filter("problem IS NULL").filter(F.col("tag") == "dc:description").select(
        "doc_id", F.lit("description").alias("tag"), "text", F.lit(None).cast("string").alias("href")
    )
    charts = body.filter("tag = 'office:chart'").select("doc_id").distinct()
    whole = rows.unionByName(meta.join(charts, "doc_id", "left_semi"))
    ranges = inside.select("doc_id", "node_id", F.explode(F.array_compact(F.array(
        _attr("chart:values-cell-range-address"), _attr("chart:label-cell-address"), _attr("table:cell-range-address")))).alias("address"))
    unread = ranges.filter(parse_range(F.col("address")).isNull())
    return fo.union_findings(
        fo.raise_rule(documents.audit_chart(whole.filter("tag IS NOT NULL")), F.col("rule_id"), path=F.lit("content/chart")),
        fo.raise_rule(unread, "CHART007", path=_at("chart-range", F.col("node_id")), pos=F.col("node_id")),
    )


def series_findings(body: DataFrame, cells: DataFrame) -> DataFrame:
    """CHART009-011: series against the cached table of their chart."""
    tables = body.filter(_under("office:chart") & (F.col("tag") == "table:table")).select(
        "doc_id", F.col("node_id").alias("table_id"), F.coalesce(_attr("table:name"), F.lit("")).alias("name")
    )
    one = tables.groupBy("doc_id", F.col("name").alias("table")).agg(F.count("*").alias("__same"), F.min("table_id").alias("__named"))
    only = tables.groupBy("doc_id").agg(F.count("*").alias("__all"), F.min("table_id").alias("__only"))

    def resolved(tag: str, address: str, name: str) -> DataFrame:
        """Ranges of one cached table; an address without a name is of the only one."""
        rows = body.filter((F.col("tag") == tag) & _under("office:chart")).select("doc_id", F.col("node_id").alias(name), parse_range(_attr(address)).alias("r"))
        found = rows.filter("r IS NOT NULL").select("doc_id", name, "r.*").join(one, ["doc_id", "table"], "left").join(only, "doc_id", "left")
        table = F.when(F.col("table").isNull() & (F.col("__all") == 1), F.col("__only")).when(F.col("__same") == 1, F.col("__named"))
        return found.withColumn("table_id", table).filter("table_id IS NOT NULL").drop("table", "__same", "__named", "__all", "__only")

    size = lambda a: (F.col(f"last_{a}") - F.col(f"first_{a}") + 1).cast("long")
    ranges = stored(resolved("chart:series", "chart:values-cell-range-address", "series_id"))
    categories = resolved("chart:categories", "table:cell-range-address", "category_id").groupBy("doc_id").agg(
        F.count("*").alias("__n"), F.max(size("row")).alias("category_rows"), F.max(size("column")).alias("category_columns")
    ).filter("__n = 1").drop("__n")
    series = ranges.select("doc_id", "series_id", size("row").alias("rows"), size("column").alias("columns")).join(categories, "doc_id", "left")
    odd = grids.nonnumeric(F.col("value_type"), F.col("covered"), ~is_blank(F.col("words")))
    runs = cells.select(
        "doc_id", "table_id", F.col("y").alias("run_start"), F.col("y_end").alias("run_end"), F.col("x").alias("col_start"),
        F.col("x_end").alias("col_end"), odd.alias("nonnumeric"),
    )
    found = grids.series_consistency(series, grids.cells_in_range(ranges, runs, ["doc_id", "table_id"]))
    sid = F.col("series_id")
    return fo.union_findings(fo.raise_rule(found, F.col("rule_id"), path=_at("chart-series", sid), pos=sid))


def image_findings(body: DataFrame, members: DataFrame) -> DataFrame:
    """IMAGE003-005 of image documents."""
    inside = body.filter(_under("office:image"))
    frames = inside.filter("tag = 'draw:frame'").select("doc_id", F.col("node_id").alias("frame_id"))
    images = inside.filter("tag = 'draw:image'").select(
        "doc_id", F.col("node_id").alias("image_id"), F.col("parent_id").alias("frame_id"), F.coalesce(_attr("xlink:href"), F.lit("")).alias("href")
    )
    data = inside.filter("tag = 'office:binary-data'").select("doc_id", F.col("parent_id").alias("image_id"), F.lit(True).alias("embedded")).distinct()
    rows = frames.join(images, ["doc_id", "frame_id"], "left").join(data, ["doc_id", "image_id"], "left")
    rows = rows.withColumn("embedded", F.coalesce("embedded", F.lit(False)))
    return fo.union_findings(fo.raise_rule(documents.audit_image(rows, members), F.col("rule_id"), details={"count": F.col("n_findings")}))


def database_findings(body: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """DATABASE001-012 of database documents."""
    docs = body.filter("tag = 'office:database'").select("doc_id").distinct()
    ok = nodes.filter("problem IS NULL").join(docs, "doc_id", "left_semi")
    tag = F.col("tag")
    kind = (
        F.when(tag == "office:database", "database")
        .when(tag.isin("db:connection-resource", "db:file-based-database", "db:server-database"), "connection")
        .when(tag == "db:login", "login").when(tag == "db:query", "query").when(tag == "db:component", "component")
        .when(F.col("parent_tag") == "office:scripts", "script")
    )
    rows = ok.select("doc_id", kind.alias("tag"), F.coalesce(_attr("xlink:href"), F.lit("")).alias("href"), _attr("db:user-name").alias("user"))
    name = F.coalesce(*[F.when(tag == t, _attr(a)) for t, a in SETTINGS.items()])
    kind_of = F.coalesce(_attr("db:data-source-setting-type"), _attr("config:type"))
    own = ok.filter(tag.isin(list(SETTINGS))).select("doc_id", "node_id", name.alias("name"), kind_of.alias("kind"), F.col("text").alias("value"))
    values = ok.filter(tag == "db:data-source-setting-value").select("doc_id", F.col("parent_id").alias("node_id"), F.col("text").alias("v"))
    settings = own.join(values, ["doc_id", "node_id"], "left").withColumn("value", F.coalesce("v", "value"))
    # A name is one of its collection or table, or of the database.
    holder = odf.nearest("office:database", "db:query-collection", "db:component-collection", "db:table-representation")
    path = F.concat(F.lit("content/"), F.lit("holder["), holder, F.lit("]/"), _local(F.col("tag")))
    objects = body.filter(F.col("tag").isin("db:query", "db:component", "db:table-representation", "db:column")).select(
        "doc_id", F.concat(path, F.lit("[name="), F.coalesce(_attr("db:name"), F.lit("")), F.lit("]")).alias("path"), _attr("db:description").alias("description")
    )
    return fo.union_findings(
        fo.raise_rule(documents.audit_database(rows.filter("tag IS NOT NULL"), members), F.col("rule_id"), details={"count": F.col("n")}),
        fo.raise_rule(documents.authentication_settings(settings), "DATABASE007"),
        fo.raise_rule(documents.audit_objects(objects), F.col("rule_id"), path=F.col("path"), kind="database.description"),
    )


def family_findings(nodes: DataFrame, members: DataFrame) -> list[DataFrame]:
    """The findings of every family; each check sees only documents that hold its elements."""
    body = stored(odf.body(nodes))
    said = stored(odf.words(nodes, [*CELLS, "chart:title", "text:p"]))
    cells = table_cells(body, said)
    return [
        table_findings(cells),
        sheet_findings(body, cells),
        page_findings(body),
        math_findings(nodes),
        chart_findings(body, said, nodes),
        series_findings(body, cells),
        image_findings(body, members),
        database_findings(body, nodes, members),
    ]
