"""From raw documents to tokens: five stages, each one operator applied to all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as
the next one's ``docs``.  All but the last return the columns of ``documents``.  Columns beyond these are
left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.llm import bpe, jaccard, line_spread, mixing, quality
from leafwright.llm.common import GAP, read, session, whole
from leafwright.llm.queries import ORACLES as _ORACLES
from leafwright.llm.queries import QUERIES as _QUERIES
from leafwright.operators.sequence import range_ordinal
from leafwright.session import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule table keeps; null and blank texts go, equal rows stay or go together."""
    return quality.judge(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; one that was nothing else goes.

    The first showing of such a line stays; rows of null text or source stay as they are.
    """
    rows = line_spread.strip_lines(docs.select(*COLUMNS))
    kept = rows.filter((F.col("n_removed") == 0) | F.col("text").rlike(f"[^{GAP}]"))
    return kept.withColumn("n_chars", F.char_length(whole("text")).cast("long")).select(*COLUMNS)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with ``__key``: equal for rows of one id and text, different for all others.

    The key is the id; only where an id has several texts the others, in the order of their digests, are
    numbered from the greatest id on.
    """
    digest = F.sha2(whole("text"), 256).alias("__digest")
    shared = stored(rows.groupBy("doc_id").agg(F.count("*").alias("__n")).filter("__n > 1").select("doc_id"))
    several = rows.join(shared, "doc_id", "left_semi").select("*", digest)
    texts = several.select("doc_id", "__digest").distinct()
    first = texts.groupBy("doc_id").agg(F.min("__digest").alias("__digest"))
    top = rows.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0
    others = texts.join(first, ["doc_id", "__digest"], "left_anti")
    numbered = stored(range_ordinal(others, [], ["doc_id", "__digest"], "__n"))
    own = F.col("doc_id").cast("long")
    alone = rows.join(shared, "doc_id", "left_anti").withColumn("__key", own)
    marked = several.join(numbered, ["doc_id", "__digest"], "left").withColumn("__key", F.coalesce(F.col("__n") + F.lit(top), own))
    return alone.unionByName(marked.drop("__n", "__digest"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of every group of linked ones; rows without an id all stay.

    Rows of one id and text are one document, of which the least (by source, language and length) stays.
    Rows of one id with different texts are different documents: those that are linked with nothing smaller
    all stay.  Null and blank texts are linked with nothing.
    """
    rows = docs.select(*COLUMNS)
    keyed = _keyed(rows.filter("doc_id is not null"))
    found = jaccard.join(keyed, "__key")
    heads = found.groupBy("id").agg(F.min("component_id").alias("least")).filter("id = least")
    kept = keyed.join(heads.select(F.col("id").alias("__key")), "__key", "left_semi")
    # Rows that repeat are few: the others need not be moved again.
    twice = stored(kept.groupBy("__key").agg(F.count("*").alias("__n")).filter("__n > 1").select("__key"))
    once = kept.join(twice, "__key", "left_anti").select(*COLUMNS)
    least = F.min(F.struct("source", "lang", "n_chars", "doc_id", "text")).alias("s")
    merged = kept.join(twice, "__key", "left_semi").groupBy("__key").agg(least).select(*[f"s.{c}" for c in COLUMNS])
    return once.unionByName(merged).unionByName(rows.filter("doc_id is null"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    Rows without a source are a source of their own; equal rows are decided as one.
    """
    mixed = mixing.mix(docs.select(*COLUMNS)).filter("copies > 0")
    return mixed.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the digests of each document's tokens and of their decoding; null counts as empty."""
    rows = docs.select("doc_id", "lang", "source", "text")
    return bpe.round_trip(rows, *bpe.vocabulary())


def _stage(function):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return function(session(spark), docs, sf_dir)

    run.__doc__ = function.__doc__
    return run


STAGES = [
    ("quality rules", _stage(quality_rules)),
    ("line dedup", _stage(line_dedup)),
    ("n-gram Jaccard join", _stage(near_duplicates)),
    ("mixing sources to target weights", _stage(mixing_weights)),
    ("byte-level BPE encoding and decoding", _stage(byte_level_bpe)),
]

# The draws of the mixing stage and the tokens of the last one are beyond SQL; the stages are tested
# against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


QUERIES = {**_QUERIES, "pipeline": run}
ORACLES = {**_ORACLES, **({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})}
