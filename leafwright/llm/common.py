"""What the operators share: session settings, table access and word expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafwright.session import prepare

# What separates words, as a class body for Java expressions and for RE2.
GAP = r"\x20\x09-\x0D"
WORD = f"[^{GAP}]+"

# Rows hold whole texts, so batches for Python are bounded by bytes as well as by rows.
BATCH_ROWS = 400
BATCH_BYTES = 8 << 20


def session(spark: SparkSession) -> SparkSession:
    """The library's settings, with small batches for tasks that read whole texts in Python."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """A text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: str | Column) -> Column:
    """The words of a text as an array; a null or blank text has none."""
    return F.filter(F.split(whole(text), f"[{GAP}]+"), lambda w: w != "")


def n_words(text: str | Column) -> Column:
    """The number of words, without keeping them."""
    parts = F.split(whole(text), f"[{GAP}]+")
    ends = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when(
        (F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1
    ).otherwise(0)
    return (F.size(parts) - ends).cast("long")


def schema_with(rows: DataFrame, **added: str) -> StructType:
    """A frame's schema with further columns; ``add`` on the frame's own schema would change the frame."""
    extra = StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in added.items()))
    return StructType(list(rows.schema.fields) + extra.fields)
