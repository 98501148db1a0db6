"""Language-model scores from a probabilistic suffix tree of words.

The root of the tree is the smoothed distribution of single words.  Every context of up to ``ORDER``
words that training texts hold is a candidate, whatever its share of the corpus, and every word seen after
it is counted.  A kept context gives the words seen after it their share and the rest to the longest kept
context that is shorter:

    P(w | s) = (c(s, w) + M * P(w | shorter s)) / (c(s) + M)

so every distribution sums to one.  A context is kept where its next words diverge from those of the
shorter context by at least ``GAIN`` nats over all its occurrences, each judged by the counts without
itself, so that a context isn't credited with what only it has seen: one that occurs once gains nothing,
and two equal sightings of a rare word are evidence enough.  No count but two and no share of the corpus
is asked for, and one that isn't kept may have longer ones that are.

The tree grows with the corpus and is never gathered.  Each task cuts its texts into chunks of bounded
size, dealt by chunk once.  Length by length, a chunk sends the distinct sequences of its texts (64-bit
hashes, sorted) to the ranges of hashes they fall in, where all chunks' counts are added, and gets the
totals back in the order sent; only words after a context that occurs twice are sent.  The gains of
contexts go the same way.  A sequence is one entry per chunk however often it occurs, so frequent ones
burden no task.  What comes back is kept in the shared folder and the shuffles of a round are removed
after it, so that disk doesn't add up over the lengths.

Defined results: a null, empty or blank text is one token, the end; repeated rows count and are scored
alike; without training texts every word is unknown and train_tokens is 0; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.llm.common import read
from leafwright.llm.registry import query
from leafwright.llm.toxicity import fold
from leafwright.session import shared_dir

ORDER = 4  # words of the longest context
GAIN = 10.0
M = 5.0
UNIT = 1 << 16  # parts of a nat: sums of whole parts don't depend on their order
CHUNK = 2_000_000  # tokens of a chunk
RANGE = 3  # chunks' worth of sequences in a range of hashes
WORD_BYTES = 6  # of a text, about, to a token
STRIDE = 1_000_003  # from a task's chunk to its next, a prime above the number of tasks
BITS = 18  # of a symbol in a tree held whole
END = 0x51ED270B7A1F0C35  # the hash that stands for the end of a text
START = 0x2C9277B5F1D3A649  # and for its start, which is a context only


def tokens(text: bytes | None) -> np.ndarray:
    """Hashes of the words of a text in UTF-8, ASCII capitals as small letters, and of its end."""
    from xxhash import xxh3_64_intdigest

    words = (text or b"").lower().split()
    found = np.empty(len(words) + 1, np.uint64)
    found[:-1] = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    found[-1] = END
    return found


def joined(sequence: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hashes of sequences with one more word each."""
    h = sequence * np.uint64(0x9E3779B97F4A7C15) + word
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pack(numbers: np.ndarray) -> tuple[int, bytes]:
    """Numbers below 2**64 as compressed planes of bytes, with their count."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(numbers), bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(packed: tuple[int, bytes]) -> np.ndarray:
    n, data = packed
    width = data[0]
    planes = pa.decompress(memoryview(data)[1:], decompressed_size=width * n, codec="zstd", asbytes=True)
    numbers = np.zeros((n, 8), np.uint8)
    numbers[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return numbers.view("<u8").reshape(n)


def pack_sorted(keys: np.ndarray) -> tuple[int, bytes]:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(packed: tuple[int, bytes]) -> np.ndarray:
    return np.cumsum(unpack(packed), dtype=np.uint64)


def bounds(keys: np.ndarray, n_ranges: int) -> np.ndarray:
    """Where each of the equal ranges of hashes begins in sorted keys, and the end."""
    begins = np.array([-(-(i << 64) // n_ranges) for i in range(n_ranges)], np.uint64)
    return np.r_[np.searchsorted(keys, begins), len(keys)]


def chunked(docs: DataFrame, key: str, text: str, held_out: Column) -> DataFrame:
    """Rows of chunks: their texts' ids, held_out and lengths, their distinct words and the places of these.

    Every text begins with ``START``.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), held_out.alias("held_out"), F.col(text).alias("text"))

    def run(batches):
        name = TaskContext.get().partitionId()
        held, ids, outs, size = [], [], [], 0

        def chunk():
            words, numbers = numbered(np.concatenate(held))
            columns = [[name], [ids], [outs]]
            for n, data in (pack(np.array([len(h) for h in held])), pack_sorted(words), pack(numbers)):
                columns += [[n], [data]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        names = ["chunk", "ids", "held_out", "n", "lengths", "n_words", "words", "n_numbers", "numbers"]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.int64(), pa.binary()] * 3]
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for id_, out, t in zip(b.column("id").to_pylist(), b.column("held_out").to_pylist(), texts):
                found = tokens(t)
                held.append(np.r_[np.uint64(START), found]), ids.append(id_), outs.append(out)
                size += len(found)
                if size >= CHUNK:
                    yield chunk()
                    held, ids, outs, size = [], [], [], 0
                    name += STRIDE
        if held:
            yield chunk()

    schema = """chunk long, ids array<long>, held_out array<boolean>, n long, lengths binary,
        n_words long, words binary, n_numbers long, numbers binary"""
    return rows.mapInArrow(run, schema)


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and the place of each one among them."""
    order = np.argsort(hashes)
    inner = hashes[order]
    new = np.r_[np.ones(min(1, len(inner)), bool), inner[1:] != inner[:-1]]
    which = np.empty(len(hashes), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return inner[new], which


@dataclass
class Sequences:
    """A chunk's distinct sequences of one length (hashes, sorted), and where they end in its texts.

    Only those whose beginning occurs twice in training texts, and whose end occurs there.
    """

    keys: np.ndarray
    at: np.ndarray  # places where one ends, rising
    which: np.ndarray  # for each such place, the sequence among the keys
    beginning: np.ndarray | None  # and the place of its beginning among those of the shorter sequences
    totals: np.ndarray | None = None  # training counts of the keys, once known
    total: np.ndarray | None = None  # and for each place


class Chunk:
    """A chunk's texts and what has come back about them."""

    def __init__(self, value: tuple, back: list[tuple]):
        self.ids, self.held_out, *packed = value
        self.lengths = unpack(packed[0]).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        words, numbers = unpack_sorted(packed[1]), unpack(packed[2]).astype(np.int32)
        self.size = len(numbers)
        self.first = np.zeros(self.size, bool)
        self.first[self.starts] = True
        self.last = np.r_[self.first[1:], True]
        self.learnt = np.repeat(~np.array(self.held_out, bool), self.lengths)
        parts = defaultdict(list)
        for kind, k, number, *payload in back:
            parts[kind, k].append((number, payload))
        totals = {k: sorted(p) for (kind, k), p in parts.items() if kind == "totals"}
        self.n = sum(p[1] for _, p in totals.get(1, ()))
        self.distinct = sum(p[2] for _, p in totals.get(1, ()))
        word = words[numbers]
        self.lists = [Sequences(words, np.arange(self.size, dtype=np.int32), numbers, None)]
        hashes = word
        for k in sorted(totals):
            short = self.lists[-1]
            short.totals = np.concatenate([unpack(p[0]) for _, p in totals[k]]).astype(np.int64)
            short.total = short.totals[short.which]
            if k > ORDER:
                break
            next_to = ~self.first[1:] if k == 1 else short.at[1:] == short.at[:-1] + 1
            beginning = np.flatnonzero((short.total[:-1] > 1) & (short.total[1:] > 0) & next_to).astype(np.int32)
            at = short.at[beginning] + 1
            hashes = joined(hashes[beginning], word[at])
            keys, which = numbered(hashes)
            self.lists.append(Sequences(keys, at, which, beginning))
        self.kept = {}
        for k in range(1, ORDER + 1):
            if ("kept", k) in parts:
                each = [np.unpackbits(np.frombuffer(p[1], np.uint8), count=p[0]) for _, p in sorted(parts["kept", k])]
                many = self.lists[k - 1].totals > 1
                self.kept[k] = np.zeros(len(many), bool)
                self.kept[k][many] = np.concatenate(each).astype(bool)

    def norm(self) -> float:
        return self.n + 0.1 * (self.distinct + 1)

    def known(self, k: int) -> bool:
        return len(self.lists) >= k and self.lists[k - 1].totals is not None

    def step(self, k: int, on: np.ndarray, p: np.ndarray, less: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places that follow contexts of k words, these contexts, and P of the words there.

        ``on`` chooses among the places where contexts end; ``less`` leaves out the words themselves.
        """
        context, longer = self.lists[k - 1], self.lists[k]
        seen = np.zeros(len(on), np.int64)
        seen[longer.beginning] = longer.total
        on = np.flatnonzero(on & ~self.last[context.at])
        at = context.at[on] + 1
        return at, context.which[on], (seen[on] - less + M * p[at]) / (context.total[on] - less + M)

    def held(self, k: int) -> np.ndarray:
        """Places where a kept context of k words ends, among those where one may."""
        return self.kept[k][self.lists[k - 1].which]

    def gains(self, k: int) -> np.ndarray:
        """What each context of k words that occurs twice gains over its training places here, in parts of a nat."""
        # Places that aren't learnt from are computed along and left out at the end.
        p = np.maximum(self.lists[0].total - 1 + 0.1, 0.1) / (self.norm() - 1)
        for j in range(1, k):
            at, _, q = self.step(j, self.held(j), p, 1)
            p[at] = np.maximum(q, 1e-300)
        context = self.lists[k - 1]
        learnt = np.r_[self.learnt[1:], False][context.at]
        at, of, q = self.step(k, (context.total > 1) & learnt, p, 1)
        return np.rint(np.bincount(of, np.log(q / p[at]), len(context.keys)) * UNIT).astype(np.int64)

    def send(self, n_ranges: int):
        """(range, row) for the longest sequences not counted yet and the longest contexts not judged yet."""
        k = len(self.lists)
        if not self.known(k):
            new = self.lists[-1]
            times = np.bincount(new.which[self.learnt[new.at]], minlength=len(new.keys))
            cuts = bounds(new.keys, n_ranges)
            for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                yield r, ("counts", k, pack_sorted(new.keys[a:b]), pack(times[a:b]))
        j = len(self.kept) + 1
        if j <= ORDER and self.known(j + 1):
            gain, context = self.gains(j), self.lists[j - 1]
            many = context.totals > 1
            cuts = bounds(context.keys, n_ranges)
            for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                asked, g = context.keys[a:b][many[a:b]], gain[a:b][many[a:b]]
                yield r, ("gains", j, pack_sorted(asked), pack(((g << 1) ^ (g >> 63)).view(np.uint64)))

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known words, base score and score of every text."""
        words, times = ~self.first, self.lists[0].total
        base = np.where(words, (times + 0.1) / self.norm(), 1.0)
        p = base.copy()
        for k in range(1, ORDER + 1):
            at, _, q = self.step(k, self.held(k), p, 0)
            p[at] = q
        total = lambda v: np.add.reduceat(v, self.starts)
        return total((words & (times > 0)).astype(np.int64)), total(np.log10(base)), total(np.log10(p))


def opened(rows):
    """The chunks of a partition, each with what has come back to it; what came back is dealt before the texts."""
    back = defaultdict(list)
    for name, value in rows:
        if isinstance(value[0], str):
            back[name].append(value)
        else:
            yield name, Chunk(value, back.pop(name, []))


def merged(rows):
    """For the ranges of hashes of a partition: totals of counts and verdicts on gains, for each chunk that sent some."""
    groups = defaultdict(list)
    for number, (name, kind, k, keys, values) in rows:
        groups[number, kind, k].append((name, keys, values))
    for (number, kind, k), parts in groups.items():
        sent = [unpack_sorted(p[1]) for p in parts]
        keys, which = numbered(np.concatenate(sent))
        values = np.concatenate([unpack(p[2]) for p in parts]).astype(np.int64)
        if kind == "gains":
            values = (values >> 1) ^ -(values & 1)
        totals = np.zeros(len(keys), np.int64)
        np.add.at(totals, which, values)
        words = np.where(keys == np.uint64(START), 0, totals)
        n, distinct = int(words.sum()), int((words > 0).sum())
        ends = np.cumsum([len(s) for s in sent])
        for (name, *_), at in zip(parts, np.split(which, ends[:-1])):
            if kind == "counts":
                yield name, ("totals", k, number, pack(totals[at]), n, distinct)
            else:
                bits = totals[at] >= GAIN * UNIT
                yield name, ("kept", k, number, len(bits), np.packbits(bits).tobytes())


def settled(dealt: RDD) -> RDD:
    """The same rows in the shared folder, placed alike; the shuffles they came from are removed."""
    kept = dealt.ctx.union([dealt])
    kept.checkpoint()
    kept._jrdd.count()
    dealt._jrdd.rdd().cleanShuffleDependencies(True)
    return kept


@dataclass
class Tree:
    """A tree held whole: the contexts kept (packed, in order), their counts, what they leave, and their followers."""

    frequent: np.ndarray
    state: np.ndarray
    total: np.ndarray
    left: np.ndarray
    follow: np.ndarray
    times: np.ndarray

    def step(self, state: np.ndarray, symbol: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """P(symbol | state) where the state is kept, else ``shorter``, the shorter context's."""
        if not len(self.state):
            return shorter
        at = np.minimum(np.searchsorted(self.state, state), len(self.state) - 1)
        kept = self.state[at] == state
        seen = np.zeros(len(state))
        if len(self.follow):
            whole = (state << BITS) | symbol
            place = np.minimum(np.searchsorted(self.follow, whole), len(self.follow) - 1)
            seen = np.where((self.follow[place] == whole) & (symbol > 0), self.times[place], 0)
        return np.where(kept, (seen + self.left[at] * shorter) / (self.total[at] + M), shorter)


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Learns from the documents that are not held out.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    context = spark.sparkContext
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    rows = chunked(docs, key, text, held_out).rdd
    n_ranges = 1 + size // (RANGE * WORD_BYTES * CHUNK)
    homes = max(RANGE * n_ranges, rows.getNumPartitions())
    dealt = rows.map(lambda r: (r[0], (r[1], r[2], *((n, bytes(d)) for n, d in zip(r[3::2], r[4::2])))))
    texts = settled(dealt.partitionBy(homes))

    def ask(rows):
        for name, chunk in opened(rows):
            for number, row in chunk.send(n_ranges):
                yield number, (name, *row)
            del chunk  # before the next is opened

    def answer(rows):
        for name, chunk in opened(rows):
            known, base, scores = chunk.scores()
            for i, id_ in enumerate(chunk.ids):
                yield (
                    id_, chunk.held_out[i], int(chunk.lengths[i]) - 1, int(known[i]), int(chunk.n),
                    float(base[i]), float(scores[i]),
                )
            del chunk

    # A round counts sequences one word longer and judges the contexts whose followers the last one counted.
    back = []
    for _ in range(ORDER + 2):
        sent = context.union([*back, texts]).mapPartitions(ask).partitionBy(n_ranges)
        back.append(settled(sent.mapPartitions(merged).partitionBy(homes)))
    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return spark.createDataFrame(context.union([*back, texts]).mapPartitions(answer), schema, verifySchema=False)


@query("op5_lm_scoring")
def op5(spark, sf_dir):
    """Every document's log probability by single words and by the suffix tree."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fold("doc_id", 10) == 0).withColumnRenamed("id", "doc_id")
