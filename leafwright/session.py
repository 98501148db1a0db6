"""Session settings, lineage cutting and shared frame helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

# Runtime settings the operators are designed for.  Joins are written with one side aggregated to
# one row per key, so adaptive execution can split a hot key on the other side.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A window over (document, block) must not settle for rows already placed by document alone:
    # that would put a whole hot document back into one task.
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    # Rows that hold whole documents: a batch for Python is bounded by bytes, not by rows alone.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    "spark.sql.session.timeZone": "UTC",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the adaptive-execution settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(name: str = "leafwright", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    return prepare(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster that folder would be
    private to one machine and lost with it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is not None:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
        named = tempfile.mkdtemp(prefix="leafwright-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise an iteration's result in the shared folder and forget how it was made."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write a frame that several branches will read once, and read it back column by column.

    Unlike a cached frame it survives lost executors, and every branch prunes its own columns.
    """
    folder = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Appended:
    """Rows that an iteration adds step by step in the shared folder; no step is written again.

    A step that runs twice (a lost driver's job, say) replaces its own folder and nothing else.
    """

    def __init__(self, spark: SparkSession, schema: StructType, folder: str | None = None):
        self.spark, self.schema = spark, schema
        self.folder = folder or f"{shared_dir(spark)}/appended-{uuid.uuid4().hex}"

    def add(self, rows: DataFrame, step: int) -> DataFrame:
        """Write one step and return its rows."""
        path = f"{self.folder}/step={step}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        """The rows of all steps so far, with ``step``."""
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("step", IntegerType())])).parquet(self.folder)


# Tables whose rows are long texts, and their unique key.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables.

    A text table small enough to sit in fewer row groups than there are cores is spread by its
    unique key, since the work per row is heavy.  A large one has more splits and is left alone.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_TABLES and rows.rdd.getNumPartitions() < cores:
        return rows.repartition(cores, TEXT_TABLES[name])
    return rows


def literal_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed dimension; its size never depends on the data, so broadcasting it is safe."""
    return F.broadcast(spark.createDataFrame(rows, schema))
