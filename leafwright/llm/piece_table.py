"""Fill-in-the-middle transformation of documents held as piece tables.

A document is a list of descriptors (buffer, start, length) over two buffers that never change: its own
UTF-8 bytes and the bytes of the three sentinels.  Cutting splits a descriptor, an arrangement permutes the
pieces and puts the sentinels' descriptors between them, and the inverse permutation puts the text's pieces
back.  No text is copied until an output is asked for; digests are fed descriptor by descriptor.

Units are runs of ASCII letters and single other code points.  The cuts and the form come from a digest of
the document's key, so reruns and retried tasks agree, whatever the partitioning.

Defined results: a null text counts as empty; an empty text, one that holds a sentinel and a share of the
others stay plain, with null for the parts' lengths; a null key is hashed as if it had no digits; repeated
rows are transformed alike; an empty table gives an empty result; further columns are kept, but for those
named like a column that is added, which are replaced.  A text of any length is one linear scan.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.llm.common import read, schema_with
from leafwright.llm.registry import query

# The sentinels of prefix, suffix and middle, and the shares in hundredths.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
SEED = "1"
TRANSFORMED = 90
SUFFIX_FIRST = 20

TEXT, MARKS = 0, 1  # the two buffers
# Places in a table of six: the prefix, middle and suffix of the text, then the three sentinels.
ARRANGEMENTS = {"plain": (0,), "psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
MARKED = [(MARKS, 0, 3), (MARKS, 3, 3), (MARKS, 6, 3)]

_KIND = np.zeros(256, np.uint8)  # 1: ASCII letter, 2: not the first byte of a code point
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[0x80:0xC0] = 2

Piece = tuple[int, int, int]


def cut(piece: Piece, *offsets: int) -> list[Piece]:
    """One descriptor split at rising offsets; parts may be empty."""
    buffer, start, length = piece
    edges = [0, *offsets, length]
    return [(buffer, start + a, b - a) for a, b in zip(edges, edges[1:])]


def arrange(pieces: list[Piece], order: tuple[int, ...]) -> list[Piece]:
    return [pieces[k] for k in order]


def inverse(order: tuple[int, ...]) -> list[int]:
    """Where an arrangement put the text's own pieces, in the order of the text."""
    return [order.index(k) for k in range(min(3, len(order))) if k in order]


def spans(pieces: list[Piece], buffers: tuple[bytes, bytes]):
    """The bytes of each descriptor, as views."""
    views = [memoryview(b) for b in buffers]
    for buffer, start, length in pieces:
        yield views[buffer][start : start + length]


def digest(pieces: list[Piece], buffers: tuple[bytes, bytes]) -> str:
    state = hashlib.sha256()
    for part in spans(pieces, buffers):
        state.update(part)
    return state.hexdigest()


def unit_starts(kind: np.ndarray) -> np.ndarray:
    letter = kind == 1
    opens = kind == 0
    opens[:1] |= letter[:1]
    opens[1:] |= letter[1:] & ~letter[:-1]
    return np.flatnonzero(opens)


def describe(key, data: bytes, seed: str = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST):
    """(n units, form, descriptors of the output, code points of the prefix, of the middle)."""
    kind = _KIND[np.frombuffer(data, np.uint8)]
    starts = unit_starts(kind)
    n = len(starts)
    name = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(name[k : k + 8], 16) for k in (0, 8, 16, 24))
    table = [(TEXT, 0, len(data))]
    if not n or h3 % 100 >= transformed or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", arrange(table, ARRANGEMENTS["plain"]), None, None
    a, b = (int(starts[k]) if k < n else len(data) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    form = "spm" if h4 % 100 < suffix_first else "psm"
    table = cut(table[0], a, b) + MARKED
    first = kind != 2
    return n, form, arrange(table, ARRANGEMENTS[form]), int(first[:a].sum()), int(first[a:b].sum())


def recover(output: bytes, form: str) -> list[Piece]:
    """Descriptors over ``output`` that spell the text it was made from."""
    order = ARRANGEMENTS[form]
    if form == "plain":
        return [(TEXT, 0, len(output))]
    edges, at = [], 0
    for k in order[::2]:
        _, start, length = MARKED[k - 3]
        at = output.index(SENTINELS[start : start + length], at)
        edges += [at, at := at + length]
    # the first edge is the output's start, so cutting at the others gives the arrangement's six pieces
    pieces = cut((TEXT, 0, len(output)), *edges[1:])
    return [pieces[k] for k in inverse(order)]


ADDED = {
    "n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long",
    "pieces": "array<struct<buffer:int,start:long,length:long>>", "output": "string", "output_sha256": "string",
}
_PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))


def transform(
    rows: DataFrame, key: str = "doc_id", text: str = "text", seed: str = SEED,
    transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """Each row with n, form, prefix_chars, middle_chars, pieces, output and output_sha256."""
    rows = rows.drop(*(c for c in ADDED if c not in (key, text)))

    def run(batches):
        for batch in batches:
            keys = batch.column(key).to_pylist()
            texts = batch.column(text).cast(pa.binary())
            columns: list[list] = [[] for _ in ADDED]
            for k, value in zip(keys, texts):
                data = value.as_py() or b""
                buffers = (data, SENTINELS)
                n, form, pieces, before, between = describe(k, data, seed, transformed, suffix_first)
                output = b"".join(spans(pieces, buffers))
                for column, cell in zip(columns, (n, form, before, between, pieces, output, digest(pieces, buffers))):
                    column.append(cell)
            n, form, before, between, pieces, output, sha = columns
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()),
                 pa.array(between, pa.int64()), pa.array([[dict(zip(("buffer", "start", "length"), p)) for p in t] for t in pieces], _PIECES),
                 pa.array(output, pa.binary()).cast(pa.string()), pa.array(sha, pa.string())],
                [*batch.schema.names, *ADDED],
            )

    return rows.mapInArrow(run, schema_with(rows, **ADDED))


def restore(rows: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """Each row with restored and restored_sha256, from its output and form alone."""
    added = {"restored": "string", "restored_sha256": "string"}
    rows = rows.drop(*added)

    def run(batches):
        for batch in batches:
            texts, shas = [], []
            for value, kind in zip(batch.column(output).cast(pa.binary()), batch.column(form).to_pylist()):
                data = value.as_py() or b""
                buffers = (data, SENTINELS)
                pieces = recover(data, kind)
                texts.append(b"".join(spans(pieces, buffers)))
                shas.append(digest(pieces, buffers))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(shas, pa.string())],
                [*batch.schema.names, *added],
            )

    return rows.mapInArrow(run, schema_with(rows, **added))


OP11_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM units),
placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
    coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts"""


@query("op11_fill_middle", OP11_SQL)
def op11(spark, sf_dir):
    """Every document's form, cuts and digests of its output and of the text restored from that."""
    made = transform(read(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restore(made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
