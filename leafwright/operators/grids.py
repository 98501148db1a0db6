"""Table grids: coverage of merged cells, range overlap, table intent, header boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwright.functions.text import is_blank
from leafwright.operators.sequence import previous, running_max, scan

ROW_BUCKET = 4096
TYPED_VALUES = ["float", "percentage", "currency", "date", "time", "boolean"]
NUMERIC_VALUES = ["float", "percentage", "currency", "date", "time"]
MAX_LABEL = 80


def grid_coverage(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """TABLE002 reasons per table.

    ``tables``: doc_id, table_id, rows, columns.  ``cells``: doc_id, table_id, y, x (0-based), row_span,
    col_span, covered.  Only tables that hold spans are looked at.  A rectangle becomes one interval per row,
    and a row's intervals are swept with a running maximum of their ends, so the work is spread over (table,
    row) and no grid is too large.  Rectangles whose summed area exceeds their grid must overlap and are
    never spelled out.
    """
    key = ["doc_id", "table_id"]
    area = F.when(~F.col("covered"), F.col("row_span") * F.col("col_span")).otherwise(0)
    span = F.col("covered") | (F.col("row_span") > 1) | (F.col("col_span") > 1)
    sized = cells.join(tables, key)
    beyond = ~F.col("covered") & (
        (F.col("y") + F.col("row_span") > F.col("rows"))
        | (F.col("x") + F.col("col_span") > F.col("columns"))
    )
    facts = sized.groupBy(*key).agg(
        F.bool_or(span).alias("complex"),
        F.bool_or(beyond).alias("beyond"),
        F.sum(area).alias("area"),
        F.first("rows").alias("rows"),
        F.first("columns").alias("columns"),
    )
    facts = facts.filter("complex").withColumn("cells", F.col("rows") * F.col("columns"))
    crowded = F.col("area") > F.col("cells")
    simple = facts.filter(~F.col("beyond") & ~crowded).select(*key)
    y = F.explode(F.sequence(F.col("y"), F.col("y") + F.col("row_span") - 1)).alias("y")
    bounded = cells.join(simple, key, "left_semi")
    # an origin counts before a covered cell at the same place
    origin = (
        bounded.filter(~F.col("covered")).select(*key, y, "x", "col_span")
        .select(*key, "y", "x", (F.col("x") + F.col("col_span")).alias("end"), F.lit(0).alias("covered"))
    )
    hidden = bounded.filter("covered").select(
        *key, "y", "x", F.lit(None).cast("long").alias("end"), F.lit(1).alias("covered")
    )
    before = Window.partitionBy(*key, "y").orderBy("x", "covered", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(before) > F.col("x"), F.lit(False))
    swept = origin.unionByName(hidden).withColumn("under", reached)
    found = swept.groupBy(*key).agg(
        F.bool_or((F.col("covered") == 0) & F.col("under")).alias("overlap"),
        F.bool_or((F.col("covered") == 1) & ~F.col("under")).alias("orphan"),
    )
    joined = facts.join(found, key, "left")
    no = F.lit(False)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("beyond"), "beyond grid"),
            F.when(~F.col("beyond") & (crowded | F.coalesce("overlap", no)), "overlap"),
            F.when(F.coalesce("orphan", no), "covered without origin"),
        )
    )
    return joined.select(*key, F.explode(reasons).alias("reason"))


def cells_in_range(ranges: DataFrame, runs: DataFrame, keys: list[str], bucket: int = ROW_BUCKET):
    """Cell runs that overlap a range, each pair once.

    Rows are bucketed on both sides, so one tall table spreads over many join keys, and a pair is
    kept only in the bucket where its overlap begins.
    """
    buckets = lambda a, b: F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket))
    left = ranges.withColumn("__b", F.explode(buckets("first_row", "last_row")))
    right = runs.withColumn("__b", F.explode(buckets("run_start", "run_end")))
    joined = left.join(right, [*keys, "__b"])
    overlap = (F.col("run_start") <= F.col("last_row")) & (F.col("run_end") >= F.col("first_row"))
    if "first_column" in ranges.columns and "col_start" in runs.columns:
        overlap &= (F.col("col_start") <= F.col("last_column")) & (
            F.col("col_end") >= F.col("first_column")
        )
    begins = F.floor(F.greatest("first_row", "run_start") / bucket) == F.col("__b")
    return joined.filter(overlap & begins).drop("__b")


def _extent(cells: DataFrame, keys: list[str], start: str, end: str, name: str) -> DataFrame:
    """How many logical rows or columns the runs of a table cover together, repeats included."""
    runs = cells.groupBy(*keys, start).agg(F.max(end).alias("__end"))
    swept = scan(runs, keys, start, {"__reach": running_max(F.col("__end"), False)})
    fresh = F.greatest(F.col("__end") - F.greatest(F.col("__reach"), F.col(start) - 1), F.lit(0))
    return swept.groupBy(*keys).agg(F.sum(fresh).cast("long").alias(name))


def crossing_merges(cells: DataFrame) -> DataFrame:
    """Tables in which a merged origin reaches over the border of a band of header rows or columns.

    ``cells``: doc_id, table_id, y, y_end (1-based), x, x_end, row_span, col_span, covered, row_header,
    header_columns (leading ones).  Borders are the rows whose header state differs from the row before; an
    origin crosses one that lies between its first row and its last.
    """
    key = ["doc_id", "table_id"]
    rows = cells.groupBy(*key, "y").agg(F.bool_or("row_header").alias("header"))
    states = scan(rows, key, "y", {"__before": previous(F.col("header"))})
    borders = states.filter(F.col("__before") != F.col("header")).select(
        *key, F.col("y").alias("run_start"), F.col("y").alias("run_end")
    )
    origins = cells.filter(~F.col("covered"))
    tall = origins.filter("row_span > 1").select(
        *key, (F.col("y") + 1).alias("first_row"), (F.col("y_end") + F.col("row_span") - 1).alias("last_row")
    )
    across = F.col("x_end") + F.col("col_span") - 1
    wide = origins.filter((F.col("col_span") > 1) & (F.col("x") <= F.col("header_columns")) & (across > F.col("header_columns")))
    return cells_in_range(tall, borders, key).select(*key).unionByName(wide.select(*key)).distinct()


def classify_tables(cells: DataFrame) -> DataFrame:
    """Table intent per table from headers, spans and typed values; TABLE001 and TABLE003.

    ``cells``: doc_id, table_id, y, x, is_header, spans, value_type; with ``y_end`` and ``x_end`` rows and
    columns count as often as they are repeated, and with the columns of ``crossing_merges`` a table whose
    merged cells cross a header border is ambiguous.
    """
    key = ["doc_id", "table_id"]
    # Without repeats every run is one row or column, and counting different ones is enough.
    repeats = {"y_end", "x_end"} <= set(cells.columns)
    sizes = [] if repeats else [F.count_distinct("y").alias("rows"), F.count_distinct("x").alias("columns")]
    agg = cells.groupBy(*key).agg(
        *sizes,
        F.bool_or("is_header").alias("has_headers"),
        F.bool_or("spans").alias("complex"),
        F.bool_or(F.col("value_type").isin(TYPED_VALUES)).alias("typed"),
        F.min(F.when(~F.col("is_header"), F.col("y"))).alias("first_data"),
        F.max(F.when(F.col("is_header"), F.col("y"))).alias("last_header"),
    )
    if repeats:
        agg = agg.join(_extent(cells, key, "y", "y_end", "rows"), key).join(_extent(cells, key, "x", "x_end", "columns"), key)
    crosses = F.lit(False)
    if {"row_header", "header_columns", "row_span", "col_span", "covered"} <= set(cells.columns):
        agg = agg.join(crossing_merges(cells).withColumn("__crosses", F.lit(True)), key, "left")
        crosses = F.coalesce("__crosses", F.lit(False))
    leading = F.coalesce(F.col("last_header") < F.col("first_data"), F.lit(True))
    typed = F.coalesce("typed", F.lit(False))
    kind = (
        F.when(F.col("has_headers") & crosses, "ambiguous")
        .when(F.col("has_headers") & (F.col("complex") | ~leading), "complex-data")
        .when(F.col("has_headers") | typed, "data")
        .when(F.least("rows", "columns") <= 1, "layout-candidate")
        .otherwise("ambiguous")
    )
    rule = F.when(kind.isin("layout-candidate", "ambiguous"), "TABLE001").when(
        ~F.col("has_headers"), "TABLE003"
    )
    return agg.select(*key, "rows", "columns", kind.alias("kind"), rule.alias("rule_id"))


def row_widths(cells: DataFrame) -> DataFrame:
    """TABLE002: tables with a row that is not as wide as the columns they declare.

    ``cells``: doc_id, table_id, row_id, x_end, declared_columns (null without a declaration).
    """
    widths = cells.filter("declared_columns IS NOT NULL").groupBy("doc_id", "table_id", "row_id").agg(
        F.max("x_end").alias("__width"), F.first("declared_columns").alias("__declared")
    )
    return widths.filter("__width <> __declared").select("doc_id", "table_id", F.lit("row width").alias("reason")).distinct()


def data_sheets(cells: DataFrame) -> DataFrame:
    """TABLE004 and TABLE005: sheets that look like data, without header rows or with merges.

    ``cells``: doc_id, sheet, row, text, header_row, merged.  A sheet looks like data when its
    first populated row has two short labels or more and another populated row follows.
    """
    keys = ["doc_id", "sheet"]
    shown = ~is_blank(F.col("text"))
    rows = cells.groupBy(*keys, "row").agg(
        F.count_if(shown).alias("labels"),
        F.max(F.when(shown, F.length("text"))).alias("longest"),
        F.bool_or("header_row").alias("header"),
        F.count_if("merged").alias("merged"),
    )
    populated = F.col("labels") > 0
    agg = rows.groupBy(*keys).agg(
        F.count_if(populated).alias("populated"),
        F.min_by(F.struct("labels", "longest"), F.when(populated, F.col("row"))).alias("first"),
        F.bool_or("header").alias("header"),
        F.sum("merged").alias("merged"),
    )
    looks = (
        (F.col("populated") >= 2) & (F.col("first.labels") >= 2) & (F.col("first.longest") <= MAX_LABEL)
    )
    found = F.array_compact(
        F.array(
            F.when(~F.col("header"), "TABLE004"), F.when(F.col("merged") > 0, "TABLE005")
        )
    )
    return agg.filter(looks).select(*keys, "merged", F.explode(found).alias("rule_id"))


def nonnumeric(value_type: Column, covered: Column, has_value: Column) -> Column:
    """A shown cell without a numeric or temporal value type."""
    return ~covered & ~F.coalesce(value_type.isin(NUMERIC_VALUES), F.lit(False)) & has_value


def series_consistency(series: DataFrame, overlapping: DataFrame) -> DataFrame:
    """CHART009-011 per series.

    ``series``: doc_id, series_id, rows, columns, category_rows, category_columns (null without a
    resolved category).  ``overlapping``: doc_id, series_id, nonnumeric (one row per cell run).
    """
    wrong = overlapping.groupBy("doc_id", "series_id").agg(F.bool_or("nonnumeric").alias("__wrong"))
    joined = series.join(wrong, ["doc_id", "series_id"], "left")
    short = lambda r, c: F.least(r, c) == 1
    flat = short("rows", "columns") & short("category_rows", "category_columns")
    differ = F.greatest("rows", "columns") != F.greatest("category_rows", "category_columns")
    no = F.lit(False)
    found = F.array_compact(
        F.array(
            F.when(F.least("rows", "columns") > 1, "CHART009"),
            F.when(F.coalesce(flat & differ, no), "CHART010"),
            F.when(F.coalesce("__wrong", no), "CHART011"),
        )
    )
    return joined.select("doc_id", "series_id", F.explode(found).alias("rule_id"))


def boundary_problems(runs: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Requested header counts that would cut a merged cell or a declaration with identities.

    ``runs``: keys, run_start, run_end, span, structural.  ``requests``: keys, boundary (one row
    per table).  A run starting at p (0-based) with count n and span s is cut by a boundary b when
    s > 1 and p < b < p + n - 1 + s, or when it is structural and p < b < p + n.
    """
    joined = runs.join(requests, keys)
    p, b = F.col("run_start") - 1, F.col("boundary")
    n = F.col("run_end") - F.col("run_start") + 1
    merged = (F.col("span") > 1) & (p < b) & (b < p + n - 1 + F.col("span"))
    split = F.col("structural") & (p < b) & (b < p + n)
    return (
        joined.groupBy(*keys)
        .agg(F.count_if(merged).alias("cut_cells"), F.count_if(split).alias("cut_repeats"))
        .filter((F.col("cut_cells") > 0) | (F.col("cut_repeats") > 0))
    )
