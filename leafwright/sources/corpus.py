"""Corpus scan and package member inventory."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_BYTES = (1 << 31) - 1  # what one value of a row can hold
MEMBERS = (
    "doc_id string, ord int, name string, size long, stored boolean, sha256 string, "
    "ascii_clean boolean, encrypted boolean, problem string"
)
_CHUNK = 1 << 20
_FLUSH = 20_000  # rows handed back to Spark at once


def identify(df: DataFrame, doc_id: Column, path: Column, content: Column, limit: int | None = None):
    """Corpus rows with a digest bound to the bytes; ``admitted`` is false past the size bound, if any.

    Oversize rows stay in the result: they are refused, never dropped.
    """
    data = content.cast("binary")
    size = F.octet_length(data).cast("long")
    return df.select(
        doc_id.cast("string").alias("doc_id"),
        path.alias("path"),
        content.alias("content"),
        F.sha2(data, 256).alias("sha256"),
        size.alias("n_bytes"),
        (F.lit(True) if limit is None else size <= limit).alias("admitted"),
    )


def read_corpus(spark: SparkSession, path: str, limit: int = ROW_BYTES) -> DataFrame:
    """Every file below ``path`` as one opaque row with its digest.

    The bound is pushed down to the file listing: a larger file is refused unread, without a digest.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    )
    name = F.regexp_extract("path", "([^/]*)$", 1)
    known = files.filter(F.col("length") <= limit)
    refused = files.filter(F.col("length") > limit).select(
        F.col("path").alias("doc_id"), name.alias("path"), F.lit(None).cast("binary").alias("content"),
        F.lit(None).cast("string").alias("sha256"), F.col("length").alias("n_bytes"), F.lit(False).alias("admitted"),
    )
    return identify(known, F.col("path"), name, F.col("content")).unionByName(refused)


def _inventory(content: bytes, most: int | None) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        # Members never yield more than they declare, so the declared sizes bound the work.
        if most is not None and sum(i.file_size for i in archive.infolist()) > most:
            raise ValueError("unpacks to more than was asked for")
        for ord_, info in enumerate(archive.infolist()):
            digest, clean = hashlib.sha256(), True
            edge, size = b"", 0
            with archive.open(info) as stream:
                while chunk := stream.read(_CHUNK):
                    digest.update(chunk)
                    clean = clean and chunk.isascii()
                    clean = clean and (size > 0 or chunk[:1].strip() == chunk[:1])
                    edge, size = chunk[-1:], size + len(chunk)
            clean = clean and edge.strip() == edge
            stored = info.compress_type == zipfile.ZIP_STORED
            locked = bool(info.flag_bits & 1)
            yield ord_, info.filename, info.file_size, stored, digest.hexdigest(), clean, locked


def package_members(corpus: DataFrame, most: int | None = None) -> DataFrame:
    """One row per package member, read member by member with a streaming digest.

    With ``most``, a package that declares to unpack to more bytes is refused before it is unpacked.

    An unreadable package gives one row with ``problem`` (PKG001) instead of members.
    """
    names = [part.split()[0] for part in MEMBERS.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"ord": "Int32", "size": "Int64"})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    rows.extend([(doc_id, *row, None) for row in _inventory(bytes(content), most)])
                except (zipfile.BadZipFile, OSError, RuntimeError, ValueError, EOFError) as error:
                    rows.append((doc_id, *[None] * 7, type(error).__name__))
                if len(rows) >= _FLUSH:
                    yield frame(rows)
                    rows = []
        if rows:
            yield frame(rows)

    chosen = corpus.filter("admitted").select("doc_id", F.col("content").cast("binary").alias("content"))
    return chosen.mapInPandas(read, MEMBERS)
