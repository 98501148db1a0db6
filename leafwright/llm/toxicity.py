"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and their first four and five letters, named by a 64-bit hash.
The machine has a weight and a short vector per term; a text's score is the sum of the weights of its
terms and of the inner products of all pairs of their vectors, so that two terms can say together what
neither says alone.  The pairs cost no more than the terms, by the identity
``sum over i < j of <v_i, v_j> = (|sum v|^2 - sum |v|^2) / 2``.

It is fitted to a sample of the labelled rows of at most about ``MAX_LABELLED`` documents, drawn by a
hash of the key, and keeps the terms that stand in at least ``MIN_SUPPORT`` of them and there much more
or less often with the label than chance would have it (``MIN_DEVIATIONS``), so that the many indifferent
words of a long text do not add up.  A term that says nothing alone is kept as well if it does beside one
that speaks for the label: if among the texts with that one the label goes with it much more or less often (``PAIR_SUPPORT``,
``PAIR_DEVIATIONS``).  All bounds do not
depend on the corpus, so the model (a few megabytes) is fitted on the driver and broadcast.  All whole
texts are then scored where they are: a scan and a map, no exchange.

Defined results: a null or empty text has no terms and gets the bias alone; several labels of one key
count as their largest, null labels as none; without labels every score is low; repeated rows are scored
alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.llm.common import read, schema_with
from leafwright.llm.registry import query
from leafwright.session import stored

MAX_LABELLED = 20_000
MIN_SUPPORT = 8
MIN_DEVIATIONS = 5.0
PAIR_SUPPORT = 20  # texts with both terms, and with the kept one alone
PAIR_DEVIATIONS = 6.0
FACTORS = 6
EPOCHS = 8
BATCH = 64
RATE = 0.1
DECAY = 1e-4
CUTOFF = 0.3
MEMORY_WORDS = 300_000  # words whose terms a task remembers
_WORD = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> list[int]:
    """Hashes of the terms of a lower-case word."""
    from xxhash import xxh3_64_intdigest as digest

    return [digest("w" + word), digest("4" + word[:4]), digest("5" + word[:5])]


def text_terms(text: str | None) -> np.ndarray:
    """The distinct hashed terms of a text, in order."""
    found = {t for w in set(_WORD.findall((text or "").lower())) for t in word_terms(w)}
    return np.array(sorted(found), np.uint64)


@dataclass
class Machine:
    """terms: sorted hashes; weight and factors: a row per term."""

    terms: np.ndarray
    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def logit(self, at: np.ndarray) -> float:
        """The score, before the logistic function, of the terms at these places."""
        v = self.factors[at]
        pairs = (v.sum(0) ** 2).sum() - (v**2).sum()
        return float(self.bias + self.weight[at].sum() + pairs / 2)


def fit(rows: list[np.ndarray], labels: np.ndarray, n_terms: int, terms: np.ndarray) -> Machine:
    """Logistic loss by stochastic gradients with per-coordinate rates; ``rows`` hold places of terms."""
    rng = np.random.default_rng(7)
    positive = labels.sum()
    bias = float(np.log((positive + 0.5) / (len(labels) - positive + 9.5)))
    weight, seen_w = np.zeros(n_terms), np.full(n_terms, 1e-6)
    factors, seen_v = rng.normal(0, 0.01, (n_terms, FACTORS)), np.full((n_terms, FACTORS), 1e-6)
    filled = np.array([len(r) > 0 for r in rows], bool)
    seen_b = 1e-6
    for _ in range(EPOCHS if filled.any() else 0):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            chosen = order[start : start + BATCH]
            bare, chosen = chosen[~filled[chosen]], chosen[filled[chosen]]
            g_b = (1 / (1 + np.exp(-bias)) - labels[bare]).sum()  # texts without a term have the bias alone
            if not len(chosen):
                seen_b += g_b**2
                bias -= RATE * g_b / np.sqrt(seen_b)
                continue
            at = np.concatenate([rows[i] for i in chosen])
            sizes = np.array([len(rows[i]) for i in chosen])
            first = np.cumsum(sizes) - sizes
            v = factors[at]
            sums = np.add.reduceat(v, first)
            pairs = ((sums**2) - np.add.reduceat(v**2, first)).sum(1) / 2
            z = bias + np.add.reduceat(weight[at], first) + pairs
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]
            g_b += error.sum()
            seen_b += g_b**2
            bias -= RATE * g_b / np.sqrt(seen_b)
            per_term = np.repeat(error, sizes)
            places, inverse = np.unique(at, return_inverse=True)
            g_w = np.bincount(inverse, per_term) + DECAY * weight[places]
            spread = per_term[:, None] * (np.repeat(sums, sizes, 0) - v)
            g_v = np.stack([np.bincount(inverse, c) for c in spread.T], 1) + DECAY * factors[places]
            seen_w[places] += g_w**2
            seen_v[places] += g_v**2
            weight[places] -= RATE * g_w / np.sqrt(seen_w[places])
            factors[places] -= RATE / 4 * g_v / np.sqrt(seen_v[places])
    return Machine(terms, float(bias), weight, factors)


def training_rows(docs: DataFrame, labels: DataFrame, train: Column, key: str, text: str, label: str) -> DataFrame:
    """text, label: about ``MAX_LABELLED`` labelled rows at most, drawn by a hash of the key."""
    known = labels.filter(F.col(label).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("__label"))
    known = known.filter(train)
    share = min(1.0, MAX_LABELLED / max(1, known.count()))
    drawn = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1_000_000)) < int(share * 1_000_000)
    chosen = docs.select(key, text).filter(train & drawn)
    return chosen.join(known.filter(drawn), key).select(
        F.xxhash64(F.col(key).cast("string")).alias("draw"), F.col(text).alias("text"), F.col("__label").alias("label")
    )


def learn(rows: DataFrame) -> Machine:
    """A machine fitted to ``rows`` (draw, text, label), which must be a bounded sample."""

    def extract(batches):
        for b in batches:
            terms = [text_terms(t).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("draw"), b.column("label"), pa.array(terms, pa.list_(pa.int64()))], ["draw", "label", "terms"]
            )

    hashed = stored(rows.mapInArrow(extract, "draw long, label int, terms array<long>"))
    rate = hashed.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
    support = hashed.select("label", F.explode("terms").alias("term")).groupBy("term").agg(
        F.count("*").alias("n"), F.sum("label").alias("hits")
    )
    support = stored(support.filter(F.col("n") >= MIN_SUPPORT))
    far = F.abs(F.col("hits") - F.col("n") * rate) > MIN_DEVIATIONS * F.sqrt(F.col("n") * rate * (1 - rate))
    telling = stored(support.filter(far).withColumn("speaks_for", F.col("hits") > F.col("n") * rate))
    alone = telling.select("term").toArrow().column("term").to_numpy()
    terms = np.sort(np.concatenate((alone, telling_beside(hashed, telling, support))).view(np.uint64))
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def locate(batches):
        for b in batches:
            places = [_places(np.array(t, np.int64).view(np.uint64), shared.value) for t in b.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("draw"), b.column("label"), pa.array(places, pa.list_(pa.int32()))], ["draw", "label", "places"]
            )

    sample = hashed.mapInArrow(locate, "draw long, label int, places array<int>").toArrow().sort_by("draw")
    places = [np.array(p, np.int32) for p in sample.column("places").to_pylist()]
    return fit(places, sample.column("label").to_numpy().astype(float), len(terms), terms)


def telling_beside(hashed: DataFrame, telling: DataFrame, support: DataFrame) -> np.ndarray:
    """Terms that among the texts with a term that speaks for the label shift its share.

    ``hashed`` is the bounded sample.  Of it the driver gets the texts with such a term, as places of these
    terms and of the candidates, and counts the pairs in arrays.
    """
    # a telling term that leaves no doubt has nothing to shift
    open_ = telling.filter((F.col("n") >= 2 * PAIR_SUPPORT) & (F.col("hits") < F.col("n")) & F.col("speaks_for"))
    known = open_.select("term", "n", "hits").toArrow().sort_by("term")
    others = support.filter(F.col("n") >= PAIR_SUPPORT).join(telling.select("term"), "term", "left_anti").select("term").toArrow()
    kept, candidates = known.column("term").to_numpy(), np.sort(others.column("term").to_numpy())
    if not len(kept) or not len(candidates):
        return np.zeros(0, np.int64)
    shared = hashed.sparkSession.sparkContext.broadcast((kept, candidates))

    def locate(batches):
        kept, candidates = shared.value
        for b in batches:
            labels, beside, found = [], [], []
            for label, terms in zip(b.column("label").to_pylist(), b.column("terms").to_pylist()):
                own = np.array(terms, np.int64)
                at = _places(own, kept)
                if len(at):
                    labels.append(label), beside.append(at), found.append(_places(own, candidates))
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels, pa.int32()), pa.array(beside, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int32()))],
                ["label", "beside", "found"],
            )

    rows = hashed.mapInArrow(locate, "label int, beside array<int>, found array<int>").toArrow()
    labels = rows.column("label").to_numpy()
    found = [np.array(x, np.int32) for x in rows.column("found").to_pylist()]
    texts: list[list[int]] = [[] for _ in kept]
    for i, at in enumerate(rows.column("beside").to_pylist()):
        for k in at:
            texts[k].append(i)
    shifts = np.zeros(len(candidates), bool)
    for k, (n_kept, hits_kept) in enumerate(zip(known.column("n").to_pylist(), known.column("hits").to_pylist())):
        at = np.concatenate([found[i] for i in texts[k]])
        marks = np.repeat(labels[texts[k]], [len(found[i]) for i in texts[k]])
        n, hits = np.bincount(at, minlength=len(candidates)), np.bincount(at, marks, len(candidates))
        share = hits_kept / n_kept
        # of n texts drawn without return from those with the kept term
        spread = np.sqrt(n * share * (1 - share) * (n_kept - n) / (n_kept - 1))
        enough = (n >= PAIR_SUPPORT) & (n_kept - n >= PAIR_SUPPORT)
        shifts |= enough & (np.abs(hits - n * share) > PAIR_DEVIATIONS * spread)
    return candidates[shifts]


def _places(found: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Where the terms of a text stand among the machine's, those it lacks left out."""
    if not len(terms) or not len(found):
        return np.zeros(0, np.int32)
    at = np.minimum(np.searchsorted(terms, found), len(terms) - 1)
    return at[terms[at] == found].astype(np.int32)


def score(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1); the text is dropped."""
    kept = [c for c in docs.columns if c not in (text, "score")]
    schema = schema_with(docs.select(*kept), score="double")
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        model, memory = shared.value, {}
        for b in batches:
            scores = []
            for value in b.column(text).to_pylist():
                words = set(_WORD.findall((value or "").lower()))
                if len(memory) > MEMORY_WORDS:
                    memory = {}
                new = [w for w in words if w not in memory]
                if new:
                    at = _where(np.array([t for w in new for t in word_terms(w)], np.uint64), model.terms)
                    memory.update((w, [p for p in at[3 * i : 3 * i + 3] if p >= 0]) for i, w in enumerate(new))
                places = {p for w in words for p in memory[w]}
                z = model.logit(np.fromiter(sorted(places), np.int64, len(places)))
                scores.append(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in kept), pa.array(scores, pa.float64())], [*kept, "score"]
            )

    return docs.select(*kept, text).mapInArrow(run, schema)


def _where(found: np.ndarray, terms: np.ndarray) -> list[int]:
    """The place of each term, -1 for those the machine lacks."""
    if not len(terms):
        return [-1] * len(found)
    at = np.minimum(np.searchsorted(terms, found), len(terms) - 1)
    return np.where(terms[at] == found, at, -1).tolist()


def fold(key: str, n: int) -> Column:
    """The fold a row falls in, by the CRC-32 of its key as text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


@query("op1_toxicity")
def op1(spark, sf_dir):
    """Every document's score, learnt from the labels of three folds of four."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = fold("doc_id", 4) == 2
    machine = learn(training_rows(docs, labels, ~held_out, "doc_id", "text", "toxic"))
    return score(docs.withColumn("held_out", held_out), machine).withColumn(
        "predicted", F.when(F.col("score") >= CUTOFF, 1).otherwise(0)
    )
