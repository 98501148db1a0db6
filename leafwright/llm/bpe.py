"""Byte-level BPE encoding and decoding by recursive queries.

Each task has a small DuckDB database with the vocabulary and the merge table: every way to split a
token into two tokens, with the rank of the whole.  A task cuts its texts by the pattern, keeps the
pieces it has not met yet, and hands them over as rows (piece, position, token).  A recursive query
joins neighbouring tokens with the merge table and contracts the leftmost pair of least rank of every
piece, until no piece has a pair left.  Decoding joins tokens with the vocabulary and aggregates their
bytes in order.

No merge crosses a place that no token of the vocabulary spans in the text as it stands, so a piece over
``LONG`` bytes is cut there first, in one scan for the longest token at each byte; the parts are encoded like
pieces.  That makes a run of any length linear, unless tokens span all of it.

A long part (a run of one symbol, say) would need as many rounds as it has merges, so parts over
``LONG`` bytes contract all occurrences of their least pair in one round, left to right.  That gives
the same result unless the new token has a still lower rank together with a neighbour; such tokens are
marked in the merge table and are contracted one at a time.

The ranks are a fixed file that the driver reads and broadcasts, so executors need no local copy.  A
task holds one group of texts, its pieces and a bounded memory of pieces already encoded.

Defined results: a null or empty text has no tokens; special tokens are ordinary text; repeated rows
are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from leafwright.llm.common import read, schema_with
from leafwright.llm.registry import query

LONG = 40  # bytes from which a piece's equal pairs are contracted together
GROUP_CHARS = 4_000_000  # characters of text handled at once
ROUNDS = 32  # rounds of a recursive query before it starts again from where it is
MEMORY_PIECES = 500_000  # pieces whose tokens a Python worker remembers
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

# Fixed value: the pattern of the public rank files.  For texts of Latin letters, digits below the
# superscripts, and general punctuation the standard library's classes agree with it, and are faster.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN_PATTERN = re.compile(_PATTERN.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d"))
_EXOTIC = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u02af\u2010-\u2027]")

_ONE_PAIR = """
WITH RECURSIVE step AS (
  SELECT 0 AS round, piece, pos, token FROM tokens
  UNION ALL
  SELECT s.round + 1, s.piece, s.pos - (s.pos > b.at)::INTEGER,
    CASE WHEN s.pos = b.at THEN b.merged ELSE s.token END
  FROM step s JOIN (
    SELECT a.piece, (min(m.merged * 1048576::BIGINT + a.pos) >> 20)::INTEGER AS merged,
      (min(m.merged * 1048576::BIGINT + a.pos) & 1048575)::INTEGER AS at
    FROM step a JOIN step z ON z.piece = a.piece AND z.pos = a.pos + 1
      JOIN merges m ON m.l = a.token AND m.r = z.token
    GROUP BY a.piece) b ON b.piece = s.piece
  WHERE s.pos <> b.at + 1)
SELECT piece, pos, token FROM step
SEMI JOIN (SELECT piece, max(round) AS round FROM step GROUP BY piece) last USING (piece, round)
ORDER BY piece, pos
"""

_ALL_PAIRS = """
WITH RECURSIVE step AS (
  SELECT 0 AS round, piece, pos, token FROM tokens
  UNION ALL
  SELECT round + 1, piece,
    (row_number() OVER (PARTITION BY piece ORDER BY pos) - 1)::INTEGER,
    CASE WHEN taken THEN least ELSE token END
  FROM (
    SELECT *, coalesce(lag(taken) OVER (PARTITION BY piece ORDER BY pos), false) AS eaten FROM (
      SELECT *, hit AND CASE WHEN single THEN nth = 1
        ELSE row_number() OVER (PARTITION BY piece, hit, pos - nth ORDER BY pos) % 2 = 1 END AS taken
      FROM (
        SELECT *, sum(hit::INTEGER) OVER (PARTITION BY piece ORDER BY pos) AS nth FROM (
          SELECT *, coalesce(merged = least, false) AS hit FROM (
            SELECT p.*, m.merged, min(m.merged) OVER (PARTITION BY p.piece) AS least,
              bool_or(m.single) FILTER (WHERE m.single) OVER (PARTITION BY p.piece, m.merged) AS single
            FROM (SELECT *, lead(token) OVER (PARTITION BY piece ORDER BY pos) AS follower FROM step) p
              LEFT JOIN merges m ON m.l = p.token AND m.r = p.follower)
          WHERE least IS NOT NULL AND round < {rounds}))))
  WHERE NOT eaten)
SELECT piece, pos, token, round FROM step
SEMI JOIN (SELECT piece, max(round) AS round FROM step GROUP BY piece) last USING (piece, round)
ORDER BY piece, pos
"""

_DECODE = """
SELECT unhex(string_agg(v.spelling, '' ORDER BY t.pos)) AS bytes
FROM tokens t JOIN vocabulary v ON v.token = t.token GROUP BY t.piece ORDER BY t.piece
"""


class Codec:
    """The vocabulary and merge table in an in-memory database, with the queries over them."""

    def __init__(self, ranks: bytes, memory: str = "256MB"):
        import duckdb
        import numpy as np

        vocabulary = {
            base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines() or [])
        }
        left, right, merged = [], [], []
        for token, rank in vocabulary.items():
            for i in range(1, len(token)):
                a, b = vocabulary.get(token[:i]), vocabulary.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        # Tokens that have a lower rank together with a neighbour than by themselves.
        early = {a for a, m in zip(left, merged) if m < a} | {b for b, m in zip(right, merged) if m < b}
        self._vocabulary = vocabulary
        self._prefixes: set[bytes] = set()
        self.memory: dict[str, bytes] = {}
        self.spelled: dict[bytes, bytes] = {}
        self._np = np
        self._byte = np.array([vocabulary[bytes([b])] for b in range(256)], np.int32)
        self._db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ".tmp/bpe"})
        self._table("merges", l=left, r=right, merged=merged, single=[m in early for m in merged])
        self._table("vocabulary", token=list(vocabulary.values()), spelling=[t.hex() for t in vocabulary])

    def _table(self, name: str, **columns) -> None:
        table = pa.table(
            {
                k: pa.array(v, pa.int32()) if k not in ("single", "spelling") else pa.array(v)
                for k, v in columns.items()
            }
        )
        self._db.register("incoming", table)
        self._db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self._db.unregister("incoming")

    def _rows(self, lengths, tokens) -> None:
        np = self._np
        starts = np.cumsum(lengths) - lengths
        self._table(
            "tokens",
            piece=np.repeat(np.arange(len(lengths), dtype=np.int32), lengths),
            pos=(np.arange(len(tokens)) - np.repeat(starts, lengths)).astype(np.int32),
            token=tokens,
        )

    def _encode(self, pieces: list[bytes], sql: str) -> list[bytes]:
        np = self._np
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self._rows(lengths, self._byte[np.frombuffer(b"".join(pieces), np.uint8)])
        if sql is _ALL_PAIRS:
            sql = sql.format(rounds=ROUNDS)
            while True:  # a query keeps all its rounds in memory, so there are few of them
                self._db.execute(f"CREATE OR REPLACE TABLE last AS {sql}")
                self._db.execute("CREATE OR REPLACE TABLE tokens AS SELECT piece, pos, token FROM last")
                if self._db.execute("SELECT max(round) FROM last").fetchone()[0] < ROUNDS:
                    break
            sql = "SELECT piece, token FROM tokens ORDER BY piece, pos"
        found = self._db.execute(sql).fetchnumpy()
        ends = np.cumsum(np.bincount(found["piece"], minlength=len(pieces))) * 4
        ids = np.asarray(found["token"]).astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _parts(self, piece: bytes) -> list[bytes]:
        """A piece cut at the places that no token spans."""
        if not self._prefixes:
            self._prefixes = {t[:i] for t in self._vocabulary for i in range(1, len(t) + 1)}
        prefixes, vocabulary = self._prefixes, self._vocabulary
        out, start, reach = [], 0, 1
        for at in range(len(piece)):
            if at and reach <= at:
                out.append(piece[start:at])
                start = at
            end = at + 1
            while end <= len(piece) and (spelled := piece[at:end]) in prefixes:
                if end > reach and spelled in vocabulary:
                    reach = end
                end += 1
        return [*out, piece[start:]]

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Tokens of each non-empty piece, as little-endian 32-bit numbers."""
        cut = {i: self._parts(p) for i, p in enumerate(pieces) if len(p) > LONG}
        if not cut:
            return self._encode_parts(pieces)
        flat = [x for i, p in enumerate(pieces) for x in cut.get(i, (p,))]
        distinct = {p: i for i, p in enumerate(dict.fromkeys(flat))}
        ids = self._encode_parts(list(distinct))
        return [b"".join(ids[distinct[x]] for x in cut[i]) if i in cut else ids[distinct[p]] for i, p in enumerate(pieces)]

    def _encode_parts(self, pieces: list[bytes]) -> list[bytes]:
        short = [i for i, p in enumerate(pieces) if len(p) <= LONG]
        long = [i for i, p in enumerate(pieces) if len(p) > LONG]
        out: list[bytes] = [b""] * len(pieces)
        for chosen, sql in ((short, _ONE_PAIR), (long, _ALL_PAIRS)):
            if chosen:
                for i, ids in zip(chosen, self._encode([pieces[i] for i in chosen], sql)):
                    out[i] = ids
        return out

    def decode(self, runs: list[bytes]) -> list[bytes]:
        """Bytes of each non-empty run of tokens."""
        np = self._np
        lengths = np.fromiter((len(r) // 4 for r in runs), np.int64, len(runs))
        self._rows(lengths, np.frombuffer(b"".join(runs), "<u4").astype(np.int32))
        return [b for (b,) in self._db.execute(_DECODE).fetchall()]


_codecs: dict[str, Codec] = {}


def codec(ranks: bytes) -> Codec:
    """This process's codec for a rank file; building it takes about a second."""
    name = hashlib.sha256(ranks).hexdigest()
    if name not in _codecs:
        _codecs[name] = Codec(ranks)
    return _codecs[name]


def _groups(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.Table]:
    """Batches put together until they hold enough text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= GROUP_CHARS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _tokenize(batches, text: str, pattern: str, ranks: bytes):
    """(group of rows, per row a list of runs, bytes of each run): every text as runs of tokens."""
    import regex

    def plain(t: str) -> bool:
        return pattern == _PATTERN and not _EXOTIC.search(t)

    find_plain = _PLAIN_PATTERN.findall
    engine, find = codec(ranks), regex.compile(pattern).findall
    memory, spelled = engine.memory, engine.spelled
    for group in _groups(batches, text):
        texts = [(find_plain if plain(t) else find)(t) if t else [] for t in group.column(text).to_pylist()]
        if len(memory) > MEMORY_PIECES:
            memory.clear(), spelled.clear()
        met: set[str] = set()
        for pieces in texts:
            met.update(pieces)
        new = list(met.difference(memory))
        if new:
            memory.update(zip(new, engine.encode([p.encode() for p in new])))
        runs = list({memory[p] for p in new} - spelled.keys())
        if runs:
            spelled.update(zip(runs, engine.decode(runs)))
        yield group, [list(map(memory.__getitem__, pieces)) for pieces in texts], spelled


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``: the tokens of each text as little-endian 32-bit numbers (binary)."""
    kept = docs.drop("ids")
    schema = schema_with(kept, ids="binary")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        for group, rows, _ in _tokenize(batches, text, pattern, shared.value):
            yield from group.append_column("ids", pa.array([b"".join(r) for r in rows], pa.binary())).to_batches()

    return kept.mapInArrow(run, schema)


def decode(rows: DataFrame, ranks: bytes, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``: the bytes that the tokens of ``ids`` stand for (binary)."""
    kept = rows.drop("decoded")
    schema = schema_with(kept, decoded="binary")
    shared = rows.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        engine = codec(shared.value)
        for batch in batches:
            runs = batch.column(ids).to_pylist()
            full = [r for r in runs if r]
            found = iter(engine.decode(full) if full else [])
            decoded = [next(found) if r else (b"" if r is not None else None) for r in runs]
            yield pa.Table.from_batches([batch]).append_column(
                "decoded", pa.array(decoded, pa.binary())
            ).to_batches()[0]

    return kept.mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_tokens, ids_sha256 and decoded_sha256.

    Encodes each text, decodes its runs of tokens again and keeps the digests of both, so that tokens
    need not leave the task.
    """
    added = ["n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [c for c in docs.columns if c not in (text, *added)]
    schema = schema_with(docs.select(*kept), n_tokens="long", ids_sha256="string", decoded_sha256="string")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        for group, rows, spelled in _tokenize(batches, text, pattern, shared.value):
            counts, ids, decoded = [], [], []
            for runs in rows:
                whole = b"".join(runs)
                counts.append(len(whole) // 4)
                ids.append(hashlib.sha256(whole).hexdigest())
                decoded.append(hashlib.sha256(b"".join(map(spelled.__getitem__, runs))).hexdigest())
            out = group.select(kept)
            for name, values, kind in zip(added, (counts, ids, decoded), (pa.int64(), pa.string(), pa.string())):
                out = out.append_column(name, pa.array(values, kind))
            yield from out.to_batches()

    return docs.select(*kept, text).mapInArrow(run, schema)


def vocabulary(name: str = VOCABULARY) -> tuple[bytes, str]:
    """A public rank file and the pattern that goes with it."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read(), public_tokenizers.PATTERN


@query("op2_bpe")
def op2(spark, sf_dir):
    """Every document's token count and the digests of its tokens and of their decoding."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, *vocabulary())
