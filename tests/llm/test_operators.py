"""Operators against brute force, and their defined results for odd rows."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwright.llm import (
    bpe, components, cover_tree, jaccard, line_spread, mixing, quality, sharding, style_tree, suffix_tree, toxicity,
)
from leafwright.llm.queries import ORACLES, QUERIES
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, ties and a long text."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one two", "en", None, 7),
        (5, "one two", "en", "b", 7), (5, "one two", "en", "b", 7), (6, long, "de", "a", len(long)),
        (7, "Tab\tone\x0btwo\x1cthree four 😀", "fr", "b", 1), (8, "a\n\na\nb", "en", "c", 6), (9, "x " * 80, "en", "c", 160),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    frame = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(tuple, frame.select(*names).collect())) == sorted(cursor.fetchall())


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# quality rules


def test_quality_measures(odd):
    for r in quality.judge(odd).collect():
        w, lines = words(r.text), [x for x in (r.text or "").split("\n") if words(x)]
        at = collections.defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        covered = {i + d for p in at.values() if len(p) > 1 for i in p for d in range(3)}
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.kept and r.base_failed)


def test_quality_keeps_clashing_columns_apart(spark, odd, empty):
    clash = odd.withColumn("kept", F.lit("mine")).withColumn("i", F.lit(1)).withColumn("w", F.lit("x"))
    assert quality.judge(clash).filter("kept").count() <= clash.count()
    assert quality.judge(empty).count() == 0


def test_quality_rules_are_a_projection(spark):
    plan = QUERIES["op4_quality_rules"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# line dedup


def test_line_spread_by_brute_force(spark, odd, empty):
    rng = random.Random(3)
    shared = [f"shared line {i}" for i in range(12)]
    rows = []
    for i in range(300):
        lines = [f"own {i} {k}" for k in range(rng.randint(0, 4))] + [s for k, s in enumerate(shared) if rng.random() < k / 14]
        rows.append((i, "\n".join(lines), "en", f"s{rng.randint(0, 5) if i % 3 else 0}" if i % 7 else None, 0))
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_lines", F.lit("mine")).withColumn("h1", F.lit(1))
    sites, first = collections.defaultdict(set), {}
    for i, text, _, source, _ in rows:
        for p, line in enumerate(text.split("\n")):
            if words(line):
                sites[line].add(source)
                first.setdefault(line, (i, p))
    gone = {x for x, s in sites.items() if len(s - {None}) >= 6}
    assert gone
    got = {r.doc_id: r for r in line_spread.strip_lines(docs, min_sites=6).collect()}
    for i, text, *_ in rows:
        kept = [x for p, x in enumerate(text.split("\n")) if x not in gone or first[x] == (i, p)]
        assert got[i].text == "\n".join(kept)
    result = line_spread.strip_lines(odd, min_sites=1)
    assert result.count() == odd.count()
    assert {r.text for r in result.filter("doc_id = 1").collect()} == {None}
    assert line_spread.strip_lines(empty).count() == 0


# mixing


def _targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, target = set(), {}
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        heft = sum(weight[s] for s in names if s not in full)
        target = {s: 2 * sizes[s] if s in full else rest * weight[s] / heft for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing_meets_targets(spark):
    rng = random.Random(5)
    rows = [
        (i, " ".join(["w"] * rng.choice([3, 10, 40, 90])), "en", rng.choice(["a"] * 6 + ["b", "c", "d", None]), 0)
        for i in range(1500)
    ]
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("mine"))
    found = mixing.mix(docs).collect()
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in found:
        assert r.size == len(words(r.text)) and r.taken in (0, r.size, 2 * r.size)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = _targets(sizes)
    for source in sizes:
        assert target[source] == pytest.approx(want[source])
        assert abs(taken[source] - want[source]) <= 90
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in found}


def test_mixing_odd_rows(odd, empty):
    found = mixing.mix(odd).collect()
    assert len(found) == odd.count()
    assert all(r.taken == 0 for r in found if r.doc_id in (1, 2, 3))
    assert len({r.taken for r in found if r.doc_id == 5}) == 1
    assert mixing.mix(empty).count() == 0


def test_mixing_keeps_expectations(spark):
    items = spark.range(60).select(
        F.lit("s").alias("source"), F.lit(60).alias("n_items"),
        F.struct(F.col("id").alias("k"), F.lit(1).cast("long").alias("z")).alias("id"),
        F.lit(1.0).alias("a"), F.lit(0.3).alias("p"),
    )
    runs = [mixing.round_copies(items, block=8, seed=s).agg(F.sum("extra")).first()[0] for s in range(3)]
    assert all(abs(n - 18) <= 1 for n in runs)


# sharding


def test_sharding_table_by_brute_force(spark):
    def number(x):
        return int(hashlib.md5(x.encode()).hexdigest()[:15], 16)

    slots, shards = 251, 7
    owner, at = [-1] * slots, [0] * shards
    for turn in range(slots):
        i = turn % shards
        offset, skip = number(f"offset {i}") % slots, number(f"skip {i}") % (slots - 1) + 1
        while owner[(offset + at[i] * skip) % slots] >= 0:
            at[i] += 1
        owner[(offset + at[i] * skip) % slots] = i
    assert {r.slot: r.shard for r in sharding.lookup(spark, shards, slots).collect()} == dict(enumerate(owner))


def test_sharding_places_all_rows(spark, odd, empty):
    rows = sharding.place(odd.withColumn("slot", F.lit("mine")), "doc_id", 5, 251).collect()
    assert len(rows) == odd.count() and len({r.shard for r in rows if r.doc_id == 5}) == 1
    assert sharding.place(empty, "doc_id", 5, 251).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup(spark, 5, 250)
    moved = sharding.lookup(spark, 7, 251).join(sharding.lookup(spark, 6, 251).withColumnRenamed("shard", "b"), "slot")
    assert moved.filter("shard <> b and shard <> 6").count() < 251 * 0.3


# byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return bpe.vocabulary()


def test_bpe_equals_tiktoken(spark, odd, ranks):
    import tiktoken

    data, pattern = ranks
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    extra = ["a" * 3000, "=" * 500, "ab" * 400, "日本語テキスト" * 30, "<|endoftext|>", "😀" * 90, " " * 700 + "x", "don't 12345"]
    docs = odd.select("doc_id", "text").union(
        spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    )
    encoded = bpe.encode(docs, data, pattern)
    for r in bpe.decode(encoded, data).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == known.encode_ordinary(r.text or "")
        assert r.decoded == (r.text or "").encode()
    trip = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, data, pattern).collect()}
    for r in encoded.collect():
        want = hashlib.sha256(r.ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()
        assert (r.doc_id, len(r.ids) // 4, *want) in trip


# n-gram Jaccard join


def _sets(rows):
    out = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def _least(nodes, linked):
    least = {n: n for n in nodes}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("block", [2048, 3])
def test_jaccard_by_brute_force(spark, odd, monkeypatch, block):
    monkeypatch.setattr(jaccard, "LIST_BLOCK", block)
    monkeypatch.setattr(jaccard, "PAIR_ROWS", 8 * block)
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(4000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for family in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 160))]
        for _ in range(rng.randint(1, 25)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.5:
                at = rng.randrange(len(w))
                w[at:at] = passage
            rows.append((1000 + len(rows) * 7 % 997, " ".join(w)))
    rows = list(dict(rows).items()) + [(r.doc_id, r.text) for r in odd.collect()]
    sets = _sets(rows)
    ids = sorted(sets)
    linked = [
        (a, b) for k, a in enumerate(ids) for b in ids[:k]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    assert len(linked) > 50
    want = _least(ids, linked)
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(found) == len(rows)
    assert {r.id: (r.n_shingles, r.component_id) for r in found} == {i: (len(sets[i]), want[i]) for i in ids}


def test_jaccard_short_lists_in_dealt_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SALT_ROWS", 1)
    rng = random.Random(19)
    rows = []
    for family in range(40):
        base = [f"u{family}_{i}" for i in range(120)]
        for _ in range(2 + family % 3):
            w = list(base)
            w[rng.randrange(len(w))] = f"x{len(rows)}"
            rows.append((10 + len(rows) * 7, " ".join(w)))
    rows += [(5000 + i, f"alone {i} " + " ".join(f"q{i}_{k}" for k in range(20))) for i in range(20)]
    sets = _sets(rows)
    ids = sorted(sets)
    linked = [
        (a, b) for k, a in enumerate(ids) for b in ids[:k] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    assert len(linked) > 40
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.id: r.component_id for r in found} == _least(ids, linked)


def test_jaccard_threshold_and_empty(spark, empty):
    base = [f"w{i}" for i in range(24)]
    near, far = base[:22] + ["x", "y"], base[:21] + ["x", "y", "z"]
    rows = [(1, " ".join(base)), (2, " ".join(near).upper()), (3, " ".join(far)), (None, " ".join(base))]
    found = {r.id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = _sets(rows[:3])
    for i in (2, 3):
        linked = 100 * len(sets[1] & sets[i]) >= 80 * len(sets[1] | sets[i])
        assert (found[i] == 1) == linked
    assert found[None] is None or found[None] == 1
    assert jaccard.join(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 501), (501, 500)]
    found = components.components(spark.createDataFrame(pairs, "a long, b long"))
    want = _least({n for p in pairs for n in p}, pairs)
    assert {r.node: r.component for r in found.collect()} == want


# language model


def test_suffix_tree_base_and_gain(spark, odd, empty):
    rng = random.Random(2)
    rows = [(1000 + i, " ".join(rng.choice(["The cat sat", "a dog ran", "it is so"]) for _ in range(30))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(odd.select("doc_id", "text"))
    found = suffix_tree.score(docs, toxicity.fold("doc_id", 10) == 0).collect()
    data = [(r.doc_id, r.text) for r in docs.collect()]
    split = {i: (t or "").encode().lower().split() + [None] for i, t in data}
    counts = collections.Counter()
    for i, _ in data:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(split[i])
    n, v = sum(counts.values()), len(counts)
    assert len(found) == len(data)
    for r in found:
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split[r.id])
        assert r.base_score == pytest.approx(base)
        assert (r.n_tokens, r.n_known) == (len(split[r.id]), sum(counts[w] > 0 for w in split[r.id]))
        assert r.train_tokens == n and r.held_out == (zlib.crc32(str(r.id).encode()) % 10 == 0)
    held = [r for r in found if r.held_out and r.n_tokens > 50]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert suffix_tree.score(empty, F.lit(False)).count() == 0


def test_suffix_tree_distributions_sum_to_one():
    frequent = np.array([10, 20, 30], np.uint64)
    b = suffix_tree.BITS
    follow = np.array([(1 << b) | 2, (1 << b) | 3])
    tree = suffix_tree.Tree(frequent, np.array([1]), np.array([20.0]), np.array([20 - 12 + suffix_tree.M]), follow, np.array([5.0, 7.0]))
    root = np.array([0.4, 0.1, 0.2, 0.3])  # rare, then the three frequent ones
    p = tree.step(np.full(4, 1), np.arange(4), root)
    assert p.sum() == pytest.approx(1)


def _suffix_tree(data):
    """Scores by brute force, and the contexts kept."""
    texts = [(i, ["<s>", *(t or "").encode().lower().split(), "</s>"]) for i, t in data]
    learnt = [w for i, w in texts if zlib.crc32(str(i).encode()) % 10]
    c = collections.Counter(
        tuple(w[a : a + k]) for w in learnt for k in range(1, suffix_tree.ORDER + 2) for a in range(len(w) - k + 1)
    )
    known = {g[0] for g in c if len(g) == 1} - {"<s>"}
    n = sum(c[w,] for w in known)
    norm, kept = n + 0.1 * (len(known) + 1), set()

    def share(w, a, k, p, less):
        s = tuple(w[a - k : a])
        return (c[*s, w[a]] - less + suffix_tree.M * p) / (c[s] - less + suffix_tree.M)

    def p(w, a, longest, less):
        found = (c[w[a],] - less + 0.1) / (norm - less)
        for k in range(1, min(longest, a) + 1):
            if tuple(w[a - k : a]) in kept:
                found = share(w, a, k, found, less)
        return found

    for k in range(1, suffix_tree.ORDER + 1):
        gain = collections.Counter()
        for w in learnt:
            for a in range(k, len(w)):
                shorter = p(w, a, k - 1, 1)
                gain[tuple(w[a - k : a])] += math.log(share(w, a, k, shorter, 1) / shorter)
        kept |= {s for s, g in gain.items() if g >= suffix_tree.GAIN}
    return [(i, sum(math.log10(p(w, a, suffix_tree.ORDER, 0)) for a in range(1, len(w)))) for i, w in texts], kept


@pytest.mark.parametrize("chunk", [suffix_tree.CHUNK, 400])
def test_suffix_tree_equals_brute_force(spark, monkeypatch, chunk):
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(40)]
    phrases = [[rng.choice(vocabulary) for _ in range(rng.randrange(2, 9))] for _ in range(12)]

    def text():
        parts = [rng.choice(phrases) if rng.random() < 0.6 else [rng.choice(vocabulary)] for _ in range(rng.randrange(12))]
        return " ".join(w for part in parts for w in part)

    data = [(i, text()) for i in range(250)]
    # The word after "p q r" is told by the fourth word back, in front of a word that tells nothing.
    pairs = (("left", "one"), ("right", "two"))
    data += [(1000 + i, "{} {} p q r {}".format(rng.choice(vocabulary), *pairs[i % 2])) for i in range(120)]
    data += [(5000, None), (5001, ""), (5002, " \n"), (5, "v1 v2"), (5, "v1 v2")]
    want, kept = _suffix_tree(data)
    assert (b"left", b"p", b"q", b"r") in kept
    monkeypatch.setattr(suffix_tree, "CHUNK", chunk)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    found = suffix_tree.score(docs, toxicity.fold("doc_id", 10) == 0).collect()
    assert sorted((r.id, round(r.score, 6)) for r in found) == sorted((i, round(x, 6)) for i, x in want)
    unlearnt = suffix_tree.score(docs, F.lit(True)).collect()
    assert len(unlearnt) == len(data) and {(r.train_tokens, r.n_known, r.score) for r in unlearnt} == {(0, 0, 0.0)}


def test_suffix_tree_keeps_evidence_in_a_large_corpus(spark):
    rng = random.Random(8)
    passage = " ".join(f"rare{i}" for i in range(20))
    data = [(i, passage) for i in range(4)]
    fresh = max(i for i in range(50, 100) if zlib.crc32(str(i).encode()) % 10 == 0)
    data.append((fresh, passage))
    filler = [(1000 + i, " ".join(f"w{rng.randrange(3000)}" for _ in range(2500))) for i in range(240)]
    docs = spark.createDataFrame(data + filler, "doc_id long, text string")
    found = suffix_tree.score(docs, toxicity.fold("doc_id", 10) == 0).filter(F.col("id") == fresh).first()
    # A few sightings of each context tell the next word, however many other words there are.
    assert found.n_tokens == 21 and found.train_tokens > 500_000
    assert found.base_score < 21 * -4 and found.score > 21 * math.log10(0.2)


# toxicity


def test_toxicity_learns_pairs(spark, empty):
    rng = random.Random(4)
    filler = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("lm", "rt", "nd", "st")]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(filler) for _ in range(12)]
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        w += ["zorkan"] * insult + ["wexil"] * group
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(insult and group)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    train = toxicity.fold("doc_id", 4) != 2
    machine = toxicity.learn(toxicity.training_rows(docs, marks, train, "doc_id", "text", "toxic"))
    found = toxicity.score(docs.withColumn("held_out", ~train), machine).join(marks, "doc_id").filter("held_out").collect()
    right = sum((r.score >= 0.3) == (r.toxic == 1) for r in found)
    assert right >= 0.95 * len(found)


def test_toxicity_without_labels(spark, odd, empty):
    none = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    rows = toxicity.training_rows(odd, none, F.lit(True), "doc_id", "text", "toxic")
    machine = toxicity.learn(rows)
    scores = [r.score for r in toxicity.score(odd, machine).collect()]
    assert len(scores) == odd.count() and all(0 <= s < 0.3 for s in scores)
    assert toxicity.score(empty, machine).count() == 0


# embeddings


@pytest.mark.parametrize("cap, sample", [(1, 2000), (64, 2000), (64, 7), (2048, 2000)])
def test_cover_tree_by_brute_force(spark, monkeypatch, cap, sample):
    # no tree, one that groups, one that knows few groups and leaves strays, one leaf per vector
    monkeypatch.setattr(cover_tree, "MAX_LEAVES", cap)
    monkeypatch.setattr(cover_tree, "SAMPLE", sample)
    monkeypatch.setattr(cover_tree, "MANY", 0.02 if sample > 7 else 0.9)
    monkeypatch.setattr(cover_tree, "BLOCK", 37)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    vectors = [c + rng.normal(size=16) * rng.choice([0.02, 0.07, 0.2]) for c in centres for _ in range(20)]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(900, rows[3][1]), (901, rows[3][1]), (902, [x * 5 for x in rows[4][1]])]
    bad = [(950, None), (951, [0.0] * 16), (952, [float("nan")] + [1.0] * 15), (953, [float("inf")] * 16), (954, [None, 1.0]), (955, [])]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("leaf", F.lit("mine"))
    units = np.array([v for _, v in rows])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    near = units @ units.T >= 0.95
    ids = [i for i, _ in rows]
    linked = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a != b]
    want = _least(ids + [i for i, _ in bad], linked)
    links = collections.Counter(a for a, _ in linked)
    found = cover_tree.near_duplicates(frame).collect()
    assert len(found) == len(rows) + len(bad)
    assert {r.id: (r.n_links, r.component_id, r.kept) for r in found} == {
        i: (links[i], want[i], want[i] == i) for i in want
    }


def test_cover_tree_drops_pairs():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 32))
    sample = np.repeat(centres, 12, 0) + rng.normal(size=(96, 32)) * 0.02
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    levels = cover_tree.build(sample, 96)
    leaves = sample[levels[-1][0]]
    near = sample @ leaves.T
    leaf, away = near.argmax(1), np.sqrt(np.maximum(0, 2 - 2 * near.max(1)))
    radii = np.array([away[leaf == i].max(initial=-1) for i in range(len(leaves))])
    pairs = cover_tree.surviving(levels, sample, radii, np.sqrt(0.1))
    assert len(pairs) < len(leaves) * (len(leaves) + 1) / 2
    close = {tuple(sorted((leaf[a], leaf[b]))) for a, b in zip(*np.nonzero(sample @ sample.T >= 0.95))}
    assert close <= set(pairs)


def test_cover_tree_prunes_clusters_beyond_its_first_sample(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n, each = 1200, 15
    centres = rng.normal(size=(n, 64))
    vectors = (np.repeat(centres, each, 0) + rng.normal(size=(n * each, 64)) * 0.1).astype(np.float32)
    compared = []
    table = cover_tree._pair_table
    monkeypatch.setattr(cover_tree, "SAMPLE", 700)  # sees about half of the clusters
    monkeypatch.setattr(cover_tree, "_pair_table", lambda rows: compared.extend(rows) or table(rows))
    rows = [(i, v) for i, v in enumerate(vectors.tolist())]
    found = cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    units = vectors.astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    links = np.concatenate([(units[k : k + 3000] @ units.T >= 0.95).sum(1) - 1 for k in range(0, len(units), 3000)])
    assert {r.id: r.n_links for r in found} == dict(enumerate(links.tolist())) and links.sum() > 10 * len(links)
    # blocks that met, in both directions; without pruning all leaves would meet each other
    leaves = {x for x, *_ in compared}
    assert len(compared) < 0.05 * len(leaves) ** 2


# HTML


PAGE = """<!DOCTYPE html><html><head><title>no</title><script>var t="</p>";</script></head><body>
<header>Site</header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>One <b>bold</b>,\n  two<br>three<p>&lt;four&gt;<ul><li>five<li>six</ul>
<div class="share">Share</div></article><section id="comments"><p>first!</p></section>
<form>Mail <input></form><footer>&copy; x</footer></body></html>"""


def test_main_text_of_a_page():
    assert style_tree.main_text(PAGE) == "Title & more\n\nOne bold, two three\n\n<four>\n\nfive\n\nsix"
    assert style_tree.main_text(None) == style_tree.main_text("") == style_tree.main_text("<nav>x</nav>") == ""
    assert style_tree.main_text("plain &eacute; text") == "plain é text"


def test_main_text_of_hard_pages():
    assert style_tree.main_text("<div>" * 30_000 + "x") == "x"
    assert style_tree.main_text("<p x" * 16_000 + "<p>y").endswith("y")
    assert style_tree.main_text("<div " + 'a="b" ' * 50_000 + ">z") == "z"
    assert style_tree.main_text("</b>" * 50_000 + "<i>" * 20_000 + "q") == "q"


@pytest.mark.parametrize("page, want", [
    ("<div id='content' class='has-sidebar'><p>A</p></div>", "A"),
    ("<div class='no-comments'><p>A</p></div><div class='comments'><p>B</p></div>", "A"),
    ("<article class='post category-social'><p>A</p></article>", "A"),
    ("<article class='social'><p>A</p></article><p>B</p>", "A"),
    ("<div class='widget'><p>B</p><article><p>A</p></article></div><p>C</p>", "A"),
    ("<app-root class='social'><article><p>A</p></article></app-root>", "A"),
    ("<article><p>A</p><div class='comments'><article class='comment'>B</article></div></article>", "A"),
    ("<p>one <span class='ad'>buy</span>two</p><div class='cookie-notice'>B</div><div class='sidebar-2'>C</div>", "one two"),
    ("<div class='notice'><p>A</p></div><footer>B</footer>", "A"),
])
def test_main_text_survives_names(page, want):
    assert style_tree.main_text(page) == want


def test_style_tree_keeps_what_copies_share(spark):
    inner = ["<ul><li>B</li></ul>", "<table><tr><td>B</td></tr></table>"]
    rows = []
    for k, part in enumerate(inner):
        rows += [(100 * k + i, f"https://h{k}.example/{i}", f"<article><p>A</p>{part}</article>") for i in range(6)]
        near = "<article><p>C{i}</p><div>D</div>" + part + "</article>"
        rows += [(100 * k + 10 + i, f"https://h{k}.example/n{i}", near.replace("{i}", str(i))) for i in range(4)]
        rows += [
            (100 * k + 20 + i, f"https://h{k}.example/o{i}", f"<article><p>T{i}</p></article>") for i in range(60)
        ]
    got = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in (0, 100):
        assert [got[k + i] for i in range(6)] == ["A\n\nB"] * 6
        assert [got[k + 10 + i] for i in range(4)] == [f"C{i}\n\nD\n\nB" for i in range(4)]


def test_style_tree_cuts_what_pages_share(spark):
    def page(i):
        return (f"<body><div><p>Home</p><p>Shop</p></div><div><h1>T{i}</h1><p>text {i} of this page</p></div>"
                f"<div class='x'><p>Call us</p></div></body>")  # fmt: skip

    rows = [(i, f"https://h.example/{i}", page(i)) for i in range(9)] + [(50, "https://other.example/", page(50)), (51, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(0))
    got = {r.page_id: (r.text, r.n_chars) for r in style_tree.extract(pages).collect()}
    assert all(got[i][0] == f"T{i}\n\ntext {i} of this page" for i in range(9))
    assert got[50][0].startswith("Home") and got[51] == ("", 0)
    assert all(len(t) == n for t, n in got.values())
    assert style_tree.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        ("<main><p>Long body here</p><article>teaser</article></main>", "Long body here\n\nteaser"),
        ("<main><article><p>Long body text here</p></article><div>More</div></main>", "Long body text here"),
        ('<main><p>Real body</p></main><article class="comment"><p>reader says a lot more than the body</p></article>', "Real body"),
        ('<article><p>Body</p></article><div id="comments"><article>reader one</article></div>', "Body"),
        ("<main><p>t</p></main><article><p>the whole long story</p></article>", "the whole long story"),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be <svg><title>i</title><text>y</text></svg></p></article>", "Let x=1 be y"),
        ('<div class="page-content has-sidebar"><p>body</p></div>', "body"),
        ('<p>body</p><div class="siteFooter">c</div><div id="navBar">d</div>', "body"),
    ]
    + [(f'<p>body</p><div class="{name}">other</div>', "body") for name in
       ("cookie-bar", "site-footer", "main-menu", "page-header", "ad-slot", "widget-area", "related-posts", "share-buttons")]
    + [(f'<p>body</p><div class="{name}">other</div>', "body\n\nother") for name in
       ("has-sidebar", "no-comments", "category-social", "post-header", "content-area", "shadow-box", "header-free-text")],
)
def test_main_text_regions_and_names(page, want):
    assert style_tree.main_text(page) == want


def test_importance_by_hand(spark):
    # one host, eight different pages: the same menu, a list whose shape differs, texts of which some repeat
    def page(i):
        items = "".join(f"<li>item {i} {k}</li>" for k in range(1 + i % 2))
        return f"<div>menu</div><ul>{items}</ul><section><p>{'same' if i < 4 else f'own {i}'}</p></section>"

    rows = [(i, "http://h/", page(i)) for i in range(8)]
    nodes = style_tree.count_nodes(spark.createDataFrame(rows, "page_id long, url string, html string"), "url", "html")
    got = sorted(r.importance for r in style_tree.importance(nodes).filter("path <> 0").collect())

    def entropy(shares):
        return -sum(s * math.log(s) for s in shares) / math.log(8)

    def mixed(shapes, texts):
        # texts: on how many pages each is
        presentation = entropy(shapes)
        content = 1 - sum(math.log(n) for n in texts) / len(texts) / math.log(8)
        weight = style_tree.DECAY ** len(shapes)
        return (1 - weight) * presentation + weight * content

    menu = mixed([1.0], [8])
    entries = mixed([0.5, 0.5], [1] * 12)
    section = mixed([1.0], [4, 1, 1, 1, 1])
    assert got == pytest.approx(sorted([menu, entries, section]))
    # by tag name, what is alike everywhere is cut
    found = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert menu < style_tree.LOW < min(entries, section)
    assert found[0] == "item 0 0\n\nsame" and found[5] == "item 5 0\n\nitem 5 1\n\nown 5"


def test_names_in_doubt_are_judged_by_the_tree(spark):
    # half of the texts repeat: too important to be cut, unless a part of the name says noise
    def page(i, name):
        note = f"note {i // 4}"
        return f"<article><p>body {i}</p></article><div class='x'><div class='{name}'>{note}</div><p>t {i}</p></div>"

    for name, cut in (("shadow-free-ad-text", True), ("free-text", False)):
        rows = [(i, f"http://{name}/", page(i, name).replace("article", "div")) for i in range(12)]
        frame = spark.createDataFrame(rows, "page_id long, url string, html string")
        judged = style_tree.importance(style_tree.count_nodes(frame, "url", "html")).collect()
        assert any(r.doubt for r in judged) == cut
        assert all("note" not in r.text for r in style_tree.extract(frame).collect()) == cut


def test_quality_counts_stop_words_in_any_case(spark):
    text = " ".join(["the cat and the dog of a house in the town"] * 1 + [f"word{i} of the line" for i in range(20)])
    docs = spark.createDataFrame([(1, text, "en", "a", 0), (2, text.upper(), "en", "a", 0)], DOCS)
    low, high = (r for r in quality.judge(docs).orderBy("doc_id").collect())
    assert low.n_stop_words == high.n_stop_words > 40 and low.kept == high.kept


def test_bpe_long_runs_are_linear():
    import time

    import tiktoken

    ranks, pattern = bpe.vocabulary()
    codec = bpe.Codec(ranks)
    table = {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks.splitlines())}
    whole = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    rng = random.Random(7)
    runs = [
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)),
        "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(50_000)),
        "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(30_000)),
        "".join(rng.choice("的一是不了人我在有他这中大来上国") for _ in range(20_000)),
        "the" * 2_000 + "ab" * 100,
    ]
    for run in runs:
        start = time.perf_counter()
        (ids,) = codec.encode([run.encode()])
        assert time.perf_counter() - start < 60
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode_ordinary(run)
    parts = codec._parts(runs[0].encode())
    assert b"".join(parts).decode() == runs[0] and max(map(len, parts)) < 2_000


def test_toxicity_learns_terms_that_say_nothing_alone(spark):
    rng = random.Random(9)
    filler = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("lm", "rt", "nd", "st")]
    rows, labels = [], []
    for i in range(6000):
        w = [rng.choice(filler) for _ in range(12)]
        insult, mild, group = (rng.random() < 0.5 for _ in range(3))
        w += ["zorkan"] * insult + ["pibbet"] * mild + ["wexil"] * group
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int((insult and group) or (mild and not group))))
    # alone the group's word goes with both labels alike
    alone = [y for (_, t), (_, y) in zip(rows, labels) if "wexil" in t.split()]
    assert abs(sum(alone) / len(alone) - 0.5) < 0.03
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    train = toxicity.fold("doc_id", 4) != 2
    machine = toxicity.learn(toxicity.training_rows(docs, marks, train, "doc_id", "text", "toxic"))
    assert set(toxicity.word_terms("wexil")) <= set(machine.terms.tolist())
    found = toxicity.score(docs.withColumn("held_out", ~train), machine).join(marks, "doc_id").filter("held_out").collect()
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in found) >= 0.95 * len(found)


def test_machine_equals_a_double_loop():
    rng = np.random.default_rng(2)
    machine = toxicity.Machine(np.arange(9, dtype=np.uint64), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    for size in range(9):
        at = rng.permutation(9)[:size]
        z = machine.bias + sum(machine.weight[i] for i in at)
        z += sum(machine.factors[i] @ machine.factors[j] for k, i in enumerate(at) for j in at[:k])
        assert machine.logit(at) == pytest.approx(z)
