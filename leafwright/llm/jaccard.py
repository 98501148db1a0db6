"""Exact Jaccard join of word 5-gram sets, by relations between sets.

A set's shingles are ordered from rare to frequent; two sets that share 80 per cent of their union must
share a shingle within the first fifth of both (the prefix).  Prefix shingles are the index: a list of
(set, size, position) per shingle.

Lists are worked off in two rounds, so that sets that resemble each other do not meet in pairs:

* *Answers from a similar set.*  In every list the smallest id leads.  Each set is checked against the
  one leader it meets most often.  Sets that link with their leader take over its component, and the
  shared counts of a set with its leader bound its overlap with every other set of that leader, from
  below and above, so most of the remaining pairs are settled without looking at the sets.
* *Skipping by blocks.*  Only lists that still hold two components are read again.  The sets of a list's
  main component are cut into blocks, which the other sets visit; inside a block, ordered by size, sizes and
  positions bound the overlap, and sets that cannot reach it are skipped.  What is left is checked exactly.

Shingle frequencies order the index and nothing else, so they may be rough: they are counts, over all
documents, of shingles that repeat within a task's group of documents, added up in ``BUCKETS`` hash
buckets.  That table has a fixed size and is the only thing broadcast.  Shingles are named by 64-bit
hashes, sets by 128-bit ones.

Defined results: a null, empty or blank text has an empty set, links with nothing and is its own
component; a text of fewer than five words has one shingle, its whole word sequence; rows with equal
sets are one class; of rows that share an id but not the text one text stands for all in links; a null id is
left out of links; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.llm.common import read, schema_with
from leafwright.llm.components import components
from leafwright.llm.registry import query
from leafwright.session import stored

WIDTH = 5
PERCENT = 80
BUCKETS = 1 << 21
GROUP = 1_000_000  # shingles among which a task looks for repeated ones
LIST_BLOCK = 2048  # rows of a list that meet at once
PARTNERS = 64  # partners checked against one copy of a leader's text
PAIR_ROWS = 1 << 16  # rows whose pairs a task forms at once, beside the group that is open
SALT_ROWS = 1 << 14  # rows of a list that one task sees in the first round
_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64
)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MULTIPLIERS[3]
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text in UTF-8; ASCII capitals count as small."""
    from xxhash import xxh3_64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WIDTH:
        return np.array([xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - WIDTH + 1
    total = np.zeros(n, np.uint64)
    for i, multiplier in enumerate(_MULTIPLIERS):
        total += h[i : i + n] * multiplier
    return np.unique(_mixed(total))


def needed(size_a, size_b, percent: int = PERCENT):
    """Least overlap of two sets that link: 100 o >= percent (a + b - o)."""
    return -(-percent * (size_a + size_b) // (100 + percent))


def _bytes(column: pa.ChunkedArray | pa.Array) -> list:
    return column.cast(pa.binary()).to_pylist()


def summarize(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per document: id, n, f1, f2 (the set's name).  Per bucket of repeated shingles: bucket, times."""
    schema = "id long, n long, f1 long, f2 long, bucket int, times long"

    def run(batches):
        from xxhash import xxh3_128_digest

        held, size, names = [], 0, set()

        def counted():
            values, times = np.unique(np.concatenate(held), return_counts=True)
            values, times = values[times > 1], times[times > 1]
            buckets, at = np.unique(values & np.uint64(BUCKETS - 1), return_inverse=True)
            total = np.bincount(at, times, len(buckets)).astype(np.int64)
            none = pa.nulls(len(buckets), pa.int64())
            return pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.array(buckets.astype(np.int32)), pa.array(total)],
                ["id", "n", "f1", "f2", "bucket", "times"],
            )

        for b in batches:
            counts, one, two = [], [], []
            for value in _bytes(b.column(text)):
                found = shingles(value)
                name = xxh3_128_digest(found.tobytes())
                counts.append(len(found))
                one.append(int.from_bytes(name[:8], "little", signed=True))
                two.append(int.from_bytes(name[8:], "little", signed=True))
                if len(found) and name not in names:
                    names.add(name)
                    held.append(found)
                    size += len(found)
                if size >= GROUP:
                    yield counted()
                    held, size, names = [], 0, set()
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [b.column(key).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(one, pa.int64()),
                 pa.array(two, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())],
                ["id", "n", "f1", "f2", "bucket", "times"],
            )
        if held:
            yield counted()

    return docs.select(key, text).mapInArrow(run, schema)


def frequency_table(summary: DataFrame) -> np.ndarray:
    """Logarithm of how often a bucket's shingles repeat; ``BUCKETS`` bytes."""
    table = np.zeros(BUCKETS, np.uint8)
    found = summary.filter("bucket is not null").groupBy("bucket").agg(F.sum("times").alias("times")).toArrow()
    times = found.column("times").to_numpy()
    if len(times):
        table[found.column("bucket").to_numpy()] = 1 + np.floor(2 * np.log2(times)).astype(np.uint8)
    return table


def prefixes(docs: DataFrame, key: str, text: str, table: np.ndarray, percent: int) -> DataFrame:
    """h, salt, id, n, pos: the index.  Equal sets met by one task count once.  Lists that are not dealt have salt -1."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        from xxhash import xxh3_64_intdigest

        names: set = set()
        for b in batches:
            parts = []
            for id_, value in zip(b.column(key).to_pylist(), _bytes(b.column(text))):
                found = shingles(value)
                n = len(found)
                name = xxh3_64_intdigest(found.tobytes()), n
                if id_ is None or not n or name in names:
                    continue
                if len(names) < 1_000_000:
                    names.add(name)
                rank = shared.value[(found & np.uint64(BUCKETS - 1)).astype(np.int64)]
                size = n - needed_prefix(n, percent) + 1
                order = np.lexsort((found, rank))[:size]
                parts.append((found[order], rank[order], id_, n))
            if not parts:
                continue
            sizes = [len(p[0]) for p in parts]
            ids = np.repeat(np.array([p[2] for p in parts], np.int64), sizes)
            rank = np.concatenate([p[1] for p in parts]).astype(np.int64)
            # A list whose bucket says it may be long is dealt to several tasks.
            spread = np.maximum(1, (1 << np.maximum(0, rank // 2 + 1)) // SALT_ROWS)
            salt = (_mixed(ids.view(np.uint64)) % spread.astype(np.uint64)).astype(np.int32)
            salt[spread == 1] = -1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([p[0] for p in parts]).view(np.int64)), pa.array(salt), pa.array(ids),
                    pa.array(np.repeat(np.array([p[3] for p in parts], np.int32), sizes)),
                    pa.array(np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])),
                ],
                ["h", "salt", "id", "n", "pos"],
            )

    return docs.select(key, text).mapInArrow(run, "h long, salt int, id long, n int, pos int")


def needed_prefix(n: int, percent: int = PERCENT) -> int:
    """Least overlap of a set of this size with any set that links with it."""
    return -(-percent * n // 100)


def shared_lists(index: DataFrame) -> DataFrame:
    """The rows of lists with at least two sets, each with the leader of its part of the list.

    A row that is alone in its part of a dealt list is kept without a leader: the list's other parts decide.
    """

    def run(batches):
        last = None  # (h, salt), leader, the part's first row if it is still alone

        def waiting(continues):
            if last is not None and last[2] is not None and (continues or last[0][1] >= 0):
                yield last[2].append_column("leader", pa.array([last[1] if continues else None], pa.int64()))

        for b in batches:
            h, salt, ids = (b.column(c).to_numpy() for c in ("h", "salt", "id"))
            if not len(h):
                continue
            starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])])
            sizes = np.diff(np.r_[starts, len(h)])
            leaders = np.repeat(ids[starts], sizes)
            alone = np.repeat(sizes == 1, sizes)
            continues = last is not None and (h[0], salt[0]) == last[0]
            yield from waiting(continues)
            if continues:
                leaders[: sizes[0]], alone[: sizes[0]] = last[1], False
            tail = slice(starts[-1], len(h))
            key = (h[-1], salt[-1])
            held = b.slice(len(h) - 1) if alone[-1] else None
            keep = ~alone | (salt >= 0)
            keep[-1] = ~alone[-1]
            last = (key, leaders[tail][0], held)
            if keep.any():
                yield b.append_column("leader", pa.array(leaders, mask=alone)).filter(pa.array(keep))
        yield from waiting(False)

    ordered = index.repartition("h", "salt").sortWithinPartitions("h", "salt", "id")
    return ordered.mapInArrow(run, schema_with(index, leader="long"))


def packed(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """id, packed: the compressed texts of the wanted documents (id), one row each.

    Texts are moved several times, so they are compressed once before.  This join, like those of the lists,
    is a merge join at every size: the other side grows with the corpus.
    """

    def run(batches):
        from zstandard import ZstdCompressor

        pack = ZstdCompressor(level=3).compress
        for b in batches:
            texts = [pack(t or b"") for t in _bytes(b.column(text))]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(texts, pa.binary())], ["id", "packed"])

    texts = docs.select(key, text).mapInArrow(run, "id long, packed binary")
    return texts.join(wanted.hint("merge"), "id", "left_semi").groupBy("id").agg(F.min("packed").alias("packed"))


def checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, n_a, n_b, overlap of each pair (a, b), from the texts of both.

    Rows are dealt by ``a`` and a part of about ``PARTNERS`` partners; each part starts with the text of
    ``a`` and streams the texts of its partners, so a task holds two sets at a time.
    """
    unique = pairs.select("a", "b").distinct()
    parts = unique.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    dealt = stored(
        unique.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    )
    heads = dealt.select("a", "part").distinct().select(
        F.col("a").alias("id"), "a", "part", F.lit(None).cast("long").alias("b")
    )
    members = dealt.select(F.col("b").alias("id"), "a", "part", "b")

    def run(batches):
        from zstandard import ZstdDecompressor

        unpack = ZstdDecompressor().decompress
        head, own = None, None
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("a", "b", "n_a", "n_b", "overlap")}
            for a, b, value in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "packed"))):
                found = shingles(unpack(value))
                if b is None:
                    head, own = a, found
                    continue
                assert head == a
                both = np.concatenate((own, found))
                both.sort(kind="stable")
                row = (a, b, len(own), len(found), int((both[1:] == both[:-1]).sum()))
                for column, item in zip(out.values(), row):
                    column.append(item)
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in out.items()})

    rows = heads.union(members).hint("merge").join(texts, "id").select("a", "part", "b", "packed")
    ordered = rows.repartition("a", "part").sortWithinPartitions(F.col("a"), F.col("part"), F.col("b").asc_nulls_first())
    return stored(ordered.mapInArrow(run, "a long, b long, n_a long, n_b long, overlap long"))


def linked(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    return rows.filter(F.col("overlap") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("overlap")) * percent)


def remaining_pairs(lists: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b, sure: pairs of different components that share a list and may still link.

    ``lists``: h, id, n, pos, part (the component so far), head and common (the set's leader and what
    it shares with it, null if it was not checked), head_n (the leader's size).
    """
    per = lists.groupBy("h", "part").agg(F.count("*").alias("c"))
    mixed = (
        per.groupBy("h").agg(
            F.max_by("part", F.struct("c", "part")).alias("main"), F.sum("c").alias("rows"), F.count("*").alias("parts")
        )
        .filter("parts > 1").select("h", "main", F.ceil(F.col("rows") / LIST_BLOCK).cast("int").alias("blocks"))
    )
    # Sets of the list's main component need not meet each other: they are dealt to blocks, and the others
    # come to every block.
    own = F.array(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = lists.join(mixed.hint("merge"), "h").withColumn("rest", (F.col("part") != F.col("main")).cast("int"))
    met = rows.withColumn(
        "x", F.explode(F.when(F.col("rest") == 0, own).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ).select("h", "x", "rest", "id", "n", "pos", "part", "head", "common", "head_n")

    names = ["h", "x", "rest", "id", "n", "pos", "part", "head", "common", "head_n"]

    def pairs(parts):
        v = {c: np.concatenate([p[c] for p in parts]) for c in names}
        order = np.lexsort((v["n"], v["x"], v["h"]))
        v = {c: x[order] for c, x in v.items()}
        group = np.cumsum(np.r_[0, (np.diff(v["h"]) != 0) | (np.diff(v["x"]) != 0)])
        # Sizes rise inside a group: once a partner is too large for a set, so are those after it.
        i, step = np.arange(len(group) - 1), 1
        while len(i):
            i = i[i + step < len(group)]
            j = i + step
            i = i[(group[j] == group[i]) & (v["n"][j] * percent <= 100 * v["n"][i])]
            j, step = i + step, step + 1
            n, m = v["n"][i], v["n"][j]
            want = needed(n, m, percent)
            room = np.minimum(n - v["pos"][i], m - v["pos"][j])
            ok = (v["part"][i] != v["part"][j]) & (room >= want) & (v["id"][i] != v["id"][j])
            # two of the others meet in every block; the first one is enough
            ok &= (v["x"][i] == 0) | (v["rest"][i] + v["rest"][j] < 2)
            kin = (v["head"][i] >= 0) & (v["head"][i] == v["head"][j])
            c, d = v["common"][i], v["common"][j]
            sure = kin & (c + d - v["head_n"][i] >= want)
            ok &= ~kin | (np.minimum(c, d) + np.minimum(n - c, m - d) >= want)
            at = np.flatnonzero(ok)
            if len(at):
                one, two = v["id"][i[at]], v["id"][j[at]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(sure[at])], ["a", "b", "sure"]
                )

    def run(batches):
        held, size, last = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            columns = {c: b.column(c).to_numpy() for c in names}
            h, x = columns["h"], columns["x"]
            first = (h[0], x[0])
            if held and size >= PAIR_ROWS:
                # what belongs to the group that is still open goes with it
                same = int(np.argmin(np.r_[(h == last[0]) & (x == last[1]), False]))
                held.append({c: v[:same] for c, v in columns.items()})
                columns = {c: v[same:] for c, v in columns.items()}
                if same < len(h) or first != last:
                    yield from pairs(held)
                    held, size = [], 0
            held.append(columns)
            size += len(columns["h"])
            last = (h[-1], x[-1])
        if held:
            yield from pairs(held)

    filled = met.fillna({"head": -1, "common": 0, "head_n": 0})
    ordered = filled.repartition("h", "x").sortWithinPartitions("h", "x")
    found = ordered.mapInArrow(run, "a long, b long, sure boolean")
    return found.groupBy("a", "b").agg(F.bool_or("sure").alias("sure"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, class_id (least id with the same set) and component_id of every document."""
    docs = docs.select(F.col(key).cast("long").alias(key), text)
    summary = stored(summarize(docs, key, text))
    sets = summary.filter("n is not null").select("id", "n", "f1", "f2")
    classes = sets.filter("n > 0").groupBy("f1", "f2").agg(F.min("id").alias("class_id"))
    table = frequency_table(summary)
    dealt = stored(shared_lists(prefixes(docs, key, text, table, percent)))
    # A row alone in its part of a list goes to the list's top, if the list has another part, else it is dropped.
    tops = dealt.filter("salt >= 0").groupBy("h", "salt").agg(F.min("id").alias("id"), F.min("leader").alias("leader"))
    heads = stored(tops.groupBy("h").agg(F.min("id").alias("top"), F.count("*").alias("c")).filter("c > 1").drop("c"))
    lone = stored(
        dealt.filter("leader is null").drop("leader").join(heads, "h").withColumnRenamed("top", "leader").select(dealt.columns)
    )
    lists = dealt.filter("leader is not null").union(lone)

    # First round: each set with the leader it meets most often; leaders of a list's parts meet too.
    across = tops.filter("leader is not null").join(heads, "h").select(
        F.col("top").alias("a"), F.col("leader").alias("b")
    ).filter("a <> b")
    met = lists.filter("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("times"))
    best = met.groupBy("id").agg(F.max_by("leader", F.struct("times", -F.col("leader"))).alias("a"))
    tried = best.select("a", F.col("id").alias("b")).union(across).distinct()
    texts = stored(packed(docs, key, text, lists.select("id").distinct()))
    first = checked(tried, texts)
    same = sets.filter("n > 0").join(classes, ["f1", "f2"]).select(
        F.col("class_id").alias("a"), F.col("id").alias("b")
    ).filter("a <> b")
    links = linked(first, percent).select("a", "b").union(same)
    parts = stored(components(links))

    # Second round: lists that still hold two components.
    head = first.groupBy("b").agg(F.max_by(F.struct("a", "overlap", "n_a"), "overlap").alias("s"))
    head = head.select(
        F.col("b").alias("id"), F.col("s.a").alias("head"), F.col("s.overlap").alias("common"),
        F.col("s.n_a").alias("head_n"),
    )
    placed = (
        lists.join(parts.withColumnRenamed("node", "id").hint("merge"), "id", "left").join(head.hint("merge"), "id", "left")
        .select("h", "id", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"),
                F.coalesce("component", "id").alias("part"), "head", "common", "head_n")
    )
    left = stored(remaining_pairs(placed, percent))
    known = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = checked(left.filter("not sure").join(known, ["a", "b"], "left_anti"), texts)
    found = linked(second, percent).select("a", "b").union(left.filter("sure").select("a", "b"))
    whole = components(
        found.union(parts.select(F.col("component").alias("a"), F.col("node").alias("b")))
    ).withColumnRenamed("node", "id")
    return (
        sets.join(classes, ["f1", "f2"], "left").join(whole, "id", "left")
        .select(
            "id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "id").alias("class_id"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )


@query("op3_jaccard_join")
def op3(spark, sf_dir):
    """Every document's set size and the least document it is linked with, directly or not."""
    found = join(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
