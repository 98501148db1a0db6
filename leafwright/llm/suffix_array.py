r"""Benchmark decontamination by suffix arrays of the training texts.

Every task cuts its training documents into shards (an Arrow batch each, bounded by bytes), numbers their
words, sorts the suffixes of the shard by prefix doubling and searches all suffixes of the benchmark in it
by bisection.  A range of the array is every place where a benchmark window occurs; the neighbours of the
place where a benchmark suffix would stand hold its longest match.  Both are found for all suffixes at once
with array arithmetic, and no text is shuffled.

The benchmark is cut into blocks of bounded size: items longer than ``PIECE`` words become pieces that
overlap by a window less one word, and pieces are dealt by digest to as many blocks as keep each below
``BLOCK_WORDS``.  A block is broadcast, its words numbered; a training word that the block lacks gets no
number and ends a suffix there, so shards hold only what can match.  The documents are passed once per
block, and the result is stored between passes, so a benchmark of any size is searched whole.

Words are what is left between ASCII characters other than digits and letters, with A-Z lower-cased.  A
window is ten consecutive words of an item, or all words of a shorter one.

Defined results: null, empty and wordless texts have no words and hit nothing; an item without an id marks
words but is not listed; items of one id are listed once; repeated documents get equal results; an empty
table of either kind gives no hits; further columns are kept, but for those named like a column that is
added, which are replaced.  Matches never cross documents or items.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.llm.common import read, schema_with, whole
from leafwright.llm.registry import query
from leafwright.session import stored

WINDOW = 10
PIECE = 1 << 14  # windows of a piece of an item
BLOCK_WORDS = 1 << 19  # words of a block of the benchmark

# What separates words, and the letters that are folded.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


def _left(codes: np.ndarray) -> np.ndarray:
    """Words from each place to the next break (a code of 0; the last code is one)."""
    at = np.where(codes == 0, np.arange(len(codes)), len(codes))
    return np.minimum.accumulate(at[::-1])[::-1] - np.arange(len(codes))


class Suffixes:
    """Numbered words, 0 between texts, with ``width`` words from each place on packed into one key."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.bits, self.width = bits, 63 // bits
        self.codes, self.left = codes.astype(np.int64), _left(codes)
        key = np.zeros(len(codes) + self.width + 1, np.int64)
        for k in range(self.width):
            key[: len(codes)] = np.where(codes > 0, (self.codes << (bits * k)) | key[1 : len(codes) + 1], 0)
        self.key = key

    def head(self, places: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Keys cut to ``depth`` words where that is less than their width."""
        return self.key[places] >> (self.bits * np.maximum(self.width - depth, 0))

    def order(self, depth: int) -> np.ndarray:
        """All places in the order of their first ``depth`` words (to the next break at most)."""
        places = np.flatnonzero(self.codes)
        places = places[np.argsort(self.key[places], kind="stable")]
        rank = np.zeros(len(self.codes) + 1, np.int64)
        at = np.arange(len(places))
        first = np.concatenate(([True], np.diff(self.key[places]) != 0))[: len(places)]
        rank[places] = np.maximum.accumulate(np.where(first, at, 0)) + 1
        reach = self.width
        while reach < depth:
            tied = np.flatnonzero(~first | ~np.concatenate((first[1:], [True]))[: len(first)])
            if not len(tied):
                break
            group = places[tied]
            later = np.where(self.left[group] > reach, rank[np.minimum(group + reach, len(self.codes))], 0)
            by = np.lexsort((later, rank[group]))
            group, later = group[by], later[by]
            places[tied] = group
            head = rank[group]
            first[tied] = np.concatenate(([True], (np.diff(head) != 0) | (np.diff(later) != 0)))
            rank[places] = np.maximum.accumulate(np.where(first, at, 0)) + 1
            reach *= 2
        return places


def _compare(tests: Suffixes, t: np.ndarray, depth: np.ndarray, shard: Suffixes, s: np.ndarray) -> np.ndarray:
    """-1, 0 or 1: the first ``depth`` words at ``s`` are before, like or after those at ``t``."""
    out, rest, step = np.zeros(len(t), np.int8), np.arange(len(t)), 0
    while len(rest):
        d = depth[rest] - step
        a, b = tests.head(t[rest] + step, d), shard.head(s[rest] + step, d)
        out[rest] = np.sign(b - a)
        rest = rest[(a == b) & (d > shard.width)]
        step += shard.width
    return out


def _bisect(tests: Suffixes, t: np.ndarray, depth: np.ndarray, shard: Suffixes, order: np.ndarray, after: int) -> np.ndarray:
    """Places in ``order`` before which all suffixes compare below ``after`` (0: first like t, 1: first beyond)."""
    low, high = np.zeros(len(t), np.int64), np.full(len(t), len(order), np.int64)
    while len(rest := np.flatnonzero(low < high)):
        mid = (low[rest] + high[rest]) >> 1
        below = _compare(tests, t[rest], depth[rest], shard, order[mid]) < after
        low[rest[below]] = mid[below] + 1
        high[rest[~below]] = mid[~below]
    return low


def _common(tests: Suffixes, t: np.ndarray, depth: np.ndarray, shard: Suffixes, s: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``t`` and ``s`` have in common, ``depth`` at most."""
    out, rest, step = np.zeros(len(t), np.int64), np.arange(len(t)), 0
    while len(rest):
        a, b = tests.key[t[rest] + step], shard.key[s[rest] + step]
        same = np.zeros(len(rest), np.int64)
        for k in range(shard.width):
            x, y = a >> (shard.bits * k), b >> (shard.bits * k)
            same = np.where((x == y) & (same == 0), shard.width - k, same)
        out[rest] += same
        rest = rest[(same == shard.width) & (out[rest] < depth[rest])]
        step += shard.width
    return np.minimum(out, np.minimum(depth, shard.left[s]))


class Block:
    """A part of the benchmark, ready to be searched: numbered words, distinct windows, who holds them."""

    def __init__(self, pieces: list[tuple[int, int, list[bytes]]], ids: pa.Array):
        """``pieces``: (place of the item in ``ids`` or -1, first word's number, words)."""
        self.ids, self.vocabulary = ids, {}
        codes: list[int] = []
        windows: dict[bytes, int] = {}
        self.holders: list[set[int]] = []
        at, depth = [], []
        self.pieces, self.firsts, starts = [], [], []
        for item, first, tokens in pieces:
            if not tokens:
                continue
            self.pieces.append(item)
            self.firsts.append(first)
            starts.append(len(codes))
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens]
            d = min(WINDOW, len(own))
            packed = np.array(own, np.int32).tobytes()
            for k in range(len(own) - d + 1):
                w = windows.setdefault(packed[4 * k : 4 * (k + d)], len(windows))
                if w == len(at):
                    at.append(len(codes) + k)
                    depth.append(d)
                    self.holders.append(set())
                if item >= 0:
                    self.holders[w].add(item)
            codes += [*own, 0]
        self.at, self.depth = np.array(at, np.int64), np.array(depth, np.int64)
        self.least = int(self.depth.min()) if at else 0
        bits = max(1, len(self.vocabulary).bit_length())
        self.suffixes = Suffixes(np.array(codes or [0], np.int32), bits)
        self.starts = np.array(starts, np.int64)
        # windows held by the same items share a number, so a document's items are gathered once per number
        numbers: dict[tuple, int] = {}
        self.held = np.array([numbers.setdefault(tuple(sorted(h)), len(numbers)) for h in self.holders], np.int64)
        self.lists = [np.array(h, np.int64) for h in numbers]
        self.holders = []

    def shard(self, texts: list[list[bytes]]):
        """(suffixes, document and word of each place): the runs of known words that a window fits into."""
        get = self.vocabulary.get
        codes, owner, word = [], [], []
        for i, tokens in enumerate(texts):
            own = np.array([*map(get, tokens, repeat(0)), 0], np.int64)
            if not own.any():
                continue
            # the length of the run each word is in
            ends = np.flatnonzero(own == 0)
            runs = np.diff(np.concatenate(([-1], ends))) - 1
            keep = (np.repeat(runs, runs + 1) >= max(1, self.least)) & (np.repeat(runs, runs + 1) > 0)
            if keep.any():
                codes.append(own[keep])
                word.append(np.flatnonzero(keep))
                owner.append(np.full(len(codes[-1]), i))
        if not codes:
            return None
        return Suffixes(np.concatenate(codes), self.suffixes.bits), np.concatenate(owner), np.concatenate(word)

    def hits(self, texts: list[list[bytes]]):
        """For each text: spans of words inside windows, and the places in ``ids`` of their items."""
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[np.ndarray] = [np.empty(0, np.int64) for _ in texts]
        made = self.shard(texts) if len(self.at) else None
        if made is None:
            return spans, items
        shard, owner, word = made
        order = shard.order(int(self.depth.max()))
        low = _bisect(self.suffixes, self.at, self.depth, shard, order, 0)
        high = _bisect(self.suffixes, self.at, self.depth, shard, order, 1)
        counts = high - low
        total = int(counts.sum())
        if not total:
            return spans, items
        window = np.repeat(np.arange(len(counts)), counts)
        place = order[np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)]
        change = np.zeros(len(owner) + 1, np.int64)
        np.add.at(change, place, 1)
        np.add.at(change, place + self.depth[window], -1)
        covered = np.concatenate(([False], np.cumsum(change)[:-1] > 0, [False]))
        edges = np.flatnonzero(covered[1:] != covered[:-1])
        for a, b in zip(edges[::2], edges[1::2]):
            spans[owner[a]].append((int(word[a]), int(word[b - 1]) + 1))
        pairs = np.unique(owner[place] * len(self.lists) + self.held[window])
        for i, group in _groups(pairs // len(self.lists), pairs % len(self.lists)):
            items[i] = np.unique(np.concatenate([self.lists[g] for g in group]))
        return spans, items

    def longest(self, texts: list[list[bytes]]):
        """(item's place, its word, words, text, its word): the longest match of every suffix with a window."""
        made = self.shard(texts) if len(self.at) else None
        if made is None:
            return [np.empty(0, np.int64)] * 5
        shard, owner, word = made
        left = self.suffixes.left
        piece = np.searchsorted(self.starts, np.arange(len(left)), "right") - 1
        length = left[self.starts][piece] if len(self.starts) else left
        # suffixes at least as long as their item's window
        t = np.flatnonzero((left > 0) & (left >= np.minimum(WINDOW, length)))
        depth = left[t]
        order = shard.order(int(depth.max()))
        at = _bisect(self.suffixes, t, depth, shard, order, 0)
        before, after = order[np.maximum(at - 1, 0)], order[np.minimum(at, len(order) - 1)]
        one, two = (_common(self.suffixes, t, depth, shard, s) for s in (before, after))
        words_, place = np.maximum(one, two), np.where(two >= one, after, before)
        good = words_ >= np.minimum(WINDOW, length[t])
        t, place, p = t[good], place[good], piece[t[good]]
        own, firsts = np.array(self.pieces, np.int64), np.array(self.firsts, np.int64)
        return [own[p], firsts[p] + t - self.starts[p], words_[good], owner[place], word[place]]


def _groups(keys: np.ndarray, values: np.ndarray):
    edges = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
    for a, b in zip(edges, edges[1:]):
        yield int(keys[a]), values[a:b]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(items: DataFrame, key: str, text: str, block_words: int = BLOCK_WORDS, piece: int = PIECE):
    """The benchmark in blocks, one after the other; what the driver holds at a time is bounded by a block."""
    w = F.filter(F.split(F.translate(whole(text), UPPER, LOWER), BETWEEN), lambda x: x != "")
    listed = items.select(F.col(key).alias("item"), w.alias("w")).filter(F.size("w") > 0).distinct()
    last = F.greatest(F.size("w") - WINDOW, F.lit(0))
    pieces = stored(
        listed.select("item", "w", F.explode(F.sequence(F.lit(0), last, F.lit(piece))).alias("first"))
        .select("item", "first", F.slice("w", F.col("first") + 1, piece + WINDOW - 1).alias("w"))
        .withColumn("digest", F.xxhash64("item", "first", "w"))
    )
    n = 1
    while True:
        sizes = pieces.groupBy(F.pmod("digest", F.lit(n))).agg(F.sum(F.size("w")).alias("words"))
        largest = sizes.agg(F.max("words")).first()[0] or 0
        if largest <= max(block_words, piece + WINDOW):
            break
        n *= 2
    for k in range(n):
        part = pieces.filter(F.pmod("digest", F.lit(n)) == k).select("item", "first", "w").toArrow()
        ids = part.column("item").combine_chunks()
        distinct = ids.unique().drop_null()
        place = {v: i for i, v in enumerate(distinct.to_pylist())}
        yield Block(
            [
                (place.get(i, -1), first, [x.encode() for x in tokens])
                for i, first, tokens in zip(ids.to_pylist(), part.column("first").to_pylist(), part.column("w").to_pylist())
            ],
            distinct,
        )


def contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Each document with n_words, spans (words inside windows, from and to) and items (ids, each once)."""
    kind = items.schema[item].dataType.simpleString()
    added = {"n_words": "long", "spans": "array<struct<from:long,to:long>>", "items": f"array<{kind}>"}
    docs = docs.drop(*(c for c in added if c != text))
    schema = schema_with(docs, **added)
    span_type = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    spark = docs.sparkSession
    result = None
    for block in blocks(items, item, item_text, block_words):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            block = sent.value
            for batch in batches:
                texts = [words(v.as_py() or b"") for v in batch.column(text).cast(pa.binary())]
                spans, places = block.hits(texts)
                lists = [block.ids.take(pa.array(p)).to_pylist() for p in places]
                kept = batch.schema.names
                if "spans" in kept:  # what an earlier block found
                    spans = [
                        _merged(s + [(x["from"], x["to"]) for x in old])
                        for s, old in zip(spans, batch.column("spans").to_pylist())
                    ]
                    lists = [list({*a, *old}) for a, old in zip(lists, batch.column("items").to_pylist())]
                    kept = kept[: -len(added)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in range(len(kept))), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([[{"from": a, "to": b} for a, b in s] for s in spans], span_type),
                     pa.array(lists, pa.list_(block.ids.type))],
                    [*kept, *added],
                )

        result = (docs if result is None else stored(result)).mapInArrow(run, schema)
    return result


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without a word inside a window; affected ones go."""
    return contaminated(docs, items, **options).filter(F.size("spans") == 0).select(*docs.columns)


def longest_matches(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """item, item_word, words, key, word: the longest verbatim match of every benchmark suffix that has a window.

    Of equally long matches the one of the greatest key and word is named.  A match ends with its piece.
    """
    item_kind, key_kind = (f.schema[c].dataType.simpleString() for f, c in ((items, item), (docs, key)))
    rows = docs.select(key, text)
    found = None
    for block in blocks(items, item, item_text, block_words):
        sent = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            block = sent.value
            for batch in batches:
                texts = [words(v.as_py() or b"") for v in batch.column(text).cast(pa.binary())]
                place, item_word, n, doc, word = block.longest(texts)
                named = pa.array(place, mask=place < 0)
                yield pa.RecordBatch.from_arrays(
                    [block.ids.take(named), pa.array(item_word), pa.array(n), batch.column(key).take(pa.array(doc)), pa.array(word)],
                    ["item", "item_word", "words", "key", "word"],
                )

        part = rows.mapInArrow(run, f"item {item_kind}, item_word long, words long, key {key_kind}, word long")
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("words", "key", "word")).alias("best")
    return found.groupBy("item", "item_word").agg(best).select(
        F.col("item").alias(item), "item_word", "best.words", F.col("best.key").alias(key), "best.word"
    )


OP12_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS d, array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') AS x
  FROM items, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS t(i) WHERE len(w) > 0),
found AS (
  SELECT k, i, d, item_id
  FROM (SELECT k, i, d, array_to_string(w[i:i + d - 1], ' ') AS x
        FROM docs, (SELECT DISTINCT d FROM windows), unnest(generate_series(1, len(w) - d + 1)) AS t(i)) JOIN windows USING (d, x)),
hits AS (
  SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT k, i, d FROM found), unnest(generate_series(i, i + d - 1)) AS t(p) GROUP BY k),
named AS (
  SELECT k, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM found GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (k) LEFT JOIN named USING (k)"""


@query("op12_decontamination", OP12_SQL)
def op12(spark, sf_dir):
    """Every document's words inside benchmark windows and the items these are from."""
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    found = contaminated(docs.select("doc_id", "text"), items)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
