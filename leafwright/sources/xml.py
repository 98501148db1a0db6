"""XML documents as node rows.

The one parser used is the standard library's, inside a task, one document at a time and flushed in
batches; Spark decides which task reads which document.  A node knows its parent and the last node below
it; what else stands above it is found by ``operators.nesting``.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = (
    "doc_id string, part string, node_id long, parent_id long, ord int, depth int, tag string, "
    "text string, tail string, attrs map<string,string>, "
    "last_id long, problem string"
)
# Namespace ends and the prefixes they are shown with.
PREFIXES = {
    "urn:oasis:names:tc:opendocument:xmlns:office:1.0": "office",
    "urn:oasis:names:tc:opendocument:xmlns:style:1.0": "style",
    "urn:oasis:names:tc:opendocument:xmlns:text:1.0": "text",
    "urn:oasis:names:tc:opendocument:xmlns:table:1.0": "table",
    "urn:oasis:names:tc:opendocument:xmlns:drawing:1.0": "draw",
    "urn:oasis:names:tc:opendocument:xmlns:xsl-fo-compatible:1.0": "fo",
    "urn:oasis:names:tc:opendocument:xmlns:svg-compatible:1.0": "svg",
    "http://www.w3.org/1999/xlink": "xlink",
    "http://purl.org/dc/elements/1.1/": "dc",
    "urn:oasis:names:tc:opendocument:xmlns:meta:1.0": "meta",
    "urn:oasis:names:tc:opendocument:xmlns:chart:1.0": "chart",
    "urn:oasis:names:tc:opendocument:xmlns:database:1.0": "db",
    "urn:oasis:names:tc:opendocument:xmlns:form:1.0": "form",
    "urn:oasis:names:tc:opendocument:xmlns:presentation:1.0": "presentation",
    "urn:oasis:names:tc:opendocument:xmlns:config:1.0": "config",
    "urn:oasis:names:tc:opendocument:xmlns:manifest:1.0": "manifest",
    "http://www.w3.org/1998/Math/MathML": "math",
    "http://www.w3.org/2000/svg": "svgdoc",
    "http://www.w3.org/XML/1998/namespace": "xml",
}
_FLUSH = 20_000
_FLUSH_CHARS = 4 << 20  # text handed back to Spark at once
_CHUNK = 1 << 20


def _name(raw: str) -> str:
    space, _, local = raw.rpartition("}")
    if not space:
        return raw
    prefix = PREFIXES.get(space[1:])
    return f"{prefix}:{local}" if prefix else raw


class _Shredder:
    """Collects node rows while the parser reads; a row is complete once its tail has passed."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self._open: list[list] = []
        self._places = [0]
        self._last: list | None = None
        self._count = 0

    def doctype(self, *_: object) -> None:
        raise expat.ExpatError("document type declarations are refused")

    def start(self, tag: str, attrib: dict[str, str]) -> None:
        self._count += 1
        self._places[-1] += 1
        parent = self._open[-1][0] if self._open else None
        attrs = [(_name(k), v) for k, v in attrib.items()]
        row = [self._count, parent, self._places[-1], len(self._open) + 1, _name(tag), [], [], attrs]
        self._open.append(row)
        self._places.append(0)
        self._last = None

    def data(self, text: str) -> None:
        if self._last is not None:
            self._last[6].append(text)
        elif self._open:
            self._open[-1][5].append(text)

    def end(self, tag: str) -> None:
        self._last = self._open.pop()
        self._last.append(self._count)
        self._places.pop()
        self.rows.append(self._last)

    def close(self) -> None:
        self._last = None

    def take(self) -> list[list]:
        """The finished rows; the last one stays while its tail may still grow."""
        keep = 1 if self._last is not None else 0
        done = self.rows[: len(self.rows) - keep]
        del self.rows[: len(done)]
        return done


def _rows(doc_id: str, part: str, content: bytes) -> Iterator[tuple]:
    """Node rows while the document is read, so a huge one is never held as rows at once."""
    target = _Shredder()
    parser = ET.XMLParser(target=target)
    for start in range(0, len(content) + 1, _CHUNK):
        chunk = content[start : start + _CHUNK]
        parser.feed(chunk)
        if len(chunk) < _CHUNK:
            parser.close()
        for row in target.take():
            row[5], row[6] = "".join(row[5]) or None, "".join(row[6]) or None
            yield (doc_id, part, *row, None)


_COLUMNS = pa.schema(
    [
        ("doc_id", pa.string()), ("part", pa.string()), ("node_id", pa.int64()), ("parent_id", pa.int64()),
        ("ord", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("text", pa.string()),
        ("tail", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
        ("last_id", pa.int64()), ("problem", pa.string()),
    ]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows as one Arrow batch; nested values go straight to Arrow."""
    columns = zip(*rows, strict=True)
    arrays = [pa.array(c, type=f.type) for c, f in zip(columns, _COLUMNS, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=_COLUMNS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node rows of batches of documents, in batches bounded by rows and by text."""
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for at in range(batch.num_rows):  # a value at a time, so that no document outlives its turn
            doc_id, part, content = (batch.column(c)[at].as_py() for c in ("doc_id", "part", "content"))
            try:
                for row in _rows(doc_id, part, content or b""):
                    rows.append(row)
                    size += len(row[7] or "") + len(row[8] or "")
                    if len(rows) >= _FLUSH or size >= _FLUSH_CHARS:
                        yield _batch(rows)
                        rows, size = [], 0
            except (ET.ParseError, expat.ExpatError, UnicodeError) as error:
                rows.append((doc_id, part, *[None] * 9, type(error).__name__))
        # nothing of a batch is held while the next one is read
        batch = content = None
        pa.default_memory_pool().release_unused()
    if rows:
        yield _batch(rows)


def shred_xml(parts: DataFrame) -> DataFrame:
    """Node rows of ``parts`` (doc_id, part, content).

    A document that cannot be read to its end has a row with ``problem``; the audit then leaves out
    whatever was read before it.
    """
    chosen = parts.select("doc_id", "part", F.col("content").cast("binary").alias("content"))
    return chosen.mapInArrow(_read, NODES)
