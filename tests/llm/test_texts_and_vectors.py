"""Fill-in-middle, decontamination and whitening against brute force, and their defined results for odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwright.llm import piece_table, suffix_array, whitening
from leafwright.llm.queries import QUERIES
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "item_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (None, "one two", "en", None, 7),
        (5, "one two", "en", "b", 7), (5, "one two", "en", "b", 7), (6, long, "de", "a", len(long)),
        (7, "Tab\tone\x0btwo\x1cthree four 😀é", "fr", "b", 1), (8, "x <S> y", "en", "c", 6), (9, "<P" * 40, "en", "c", 80),
        (10, "a<b>c" * 30, "en", "c", 150),
    ]
    return spark.createDataFrame(rows, DOCS)


# fill in the middle


def _expected(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    name = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(name[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_by_brute_force(spark, odd):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab <>PSM\né😀") for _ in range(rng.randint(0, 60)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    back = piece_table.restore(piece_table.transform(docs)).collect()
    assert len(back) == docs.count()
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    for r in back:
        n, form, before, between, output = _expected(r.doc_id, r.text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (n, form, before, between, output)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored == (r.text or "")
        assert r.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        data = ((r.text or "").encode(), piece_table.SENTINELS)
        assert b"".join(data[p["buffer"]][p["start"] : p["start"] + p["length"]] for p in r.pieces).decode() == output


def test_fill_middle_keeps_columns_and_empty_tables(spark, odd):
    clash = odd.withColumn("form", F.lit("mine")).withColumn("n", F.lit("x")).withColumn("other", F.lit(3))
    made = piece_table.transform(clash)
    assert set(made.columns) == {*odd.columns, "other", *piece_table.ADDED}
    assert made.filter("form = 'mine'").count() == 0 and made.filter("other = 3").count() == odd.count()
    assert piece_table.restore(piece_table.transform(odd.limit(0))).count() == 0


def test_inverse_permutation_restores():
    for order in piece_table.ARRANGEMENTS.values():
        table = [(0, 10 * k, 10) for k in range(max(order) + 1)]
        arranged = piece_table.arrange(table, order)
        assert [arranged[k] for k in piece_table.inverse(order)] == table[: min(3, len(order))]
    assert piece_table.cut((0, 5, 10), 3, 3) == [(0, 5, 3), (0, 8, 0), (0, 8, 7)]


# decontamination


def _words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def _brute(docs, items):
    windows = {}
    for i, text in items:
        w = _words(text)
        d = min(10, len(w))
        for k in range(len(w) - d + 1) if w else ():
            windows.setdefault(tuple(w[k : k + d]), set()).add(i)
    out = []
    for i, text in docs:
        w, hit, found = _words(text), set(), set()
        for d in {len(x) for x in windows}:
            for k in range(len(w) - d + 1):
                if tuple(w[k : k + d]) in windows:
                    hit |= set(range(k, k + d))
                    found |= windows[tuple(w[k : k + d])]
        out.append((i, len(w), sorted(hit), sorted(x for x in found if x is not None)))
    return sorted(out, key=repr)


def _got(frame):
    return sorted(
        ((r.doc_id, r.n_words, [k for a, b in r.spans for k in range(a, b)], sorted(r.items)) for r in frame.collect()), key=repr
    )


def _corpus(seed, vocabulary):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    items = [(k, " ".join(word() for _ in range(rng.choice((3, 9, 10, 11, 40, 90))))) for k in range(30)]
    items += [(3, items[5][1]), (77, items[5][1]), (None, items[6][1]), (78, None), (79, " .,; "), (80, "Éa ÉB")]
    docs = []
    for i in range(200):
        parts = [word() for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            w = _words(rng.choice(items)[1])
            a = rng.randint(0, max(len(w) - 8, 0))
            at = rng.randint(0, len(parts))
            parts[at:at] = w[a : a + rng.randint(8, 60)]
        docs.append((i % 150, rng.choice((" ", ", ", "\n", "-")).join(x.upper() if rng.random() < 0.3 else x for x in parts)))
    docs += [(501, items[9][1] + " " + items[9][1]), (502, "éa Éb Éa ÉB éa"), (503, None), (None, items[4][1])]
    return docs, items


@pytest.mark.parametrize("vocabulary", [2, 5, 1000])
def test_decontamination_by_brute_force(spark, vocabulary):
    docs, items = _corpus(vocabulary, vocabulary)
    docs_f, items_f = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    expected = _brute(docs, items)
    assert _got(suffix_array.contaminated(docs_f, items_f)) == expected
    kept = suffix_array.decontaminate(docs_f, items_f).collect()
    assert len(kept) == sum(not hit for _, _, hit, _ in expected) and any(hit for _, _, hit, _ in expected)


def test_decontamination_in_blocks_and_pieces(spark, monkeypatch):
    docs, items = _corpus(4, 200)
    docs_f, items_f = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    cut = suffix_array.blocks
    monkeypatch.setattr(suffix_array, "blocks", lambda *a: cut(*a[:3], 300, 16))
    assert len(list(suffix_array.blocks(items_f, "item_id", "text"))) > 3
    assert _got(suffix_array.contaminated(docs_f, items_f)) == _brute(docs, items)


def test_longest_matches_by_brute_force(spark):
    docs, items = _corpus(6, 300)
    docs, items = [d for d in docs if d[0] is not None], [x for k, x in enumerate(items[:30])]
    found = suffix_array.longest_matches(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, ITEMS)
    ).collect()
    texts = [_words(t) for _, t in docs]
    got = {(r.item_id, r.item_word): r for r in found}
    for i, text in items:
        w = _words(text)
        for k in range(len(w)):
            best = 0
            for t in texts:
                for p in range(len(t)):
                    n = 0
                    while k + n < len(w) and p + n < len(t) and w[k + n] == t[p + n]:
                        n += 1
                    best = max(best, n)
            if best >= min(10, len(w)):
                r = got.pop((i, k))
                assert r.words == best
                assert any(t[r.word : r.word + best] == w[k : k + best] for (d, _), t in zip(docs, texts) if d == r.doc_id)
    assert not got


def test_suffix_order_by_brute_force():
    rng = np.random.default_rng(1)
    for top in (2, 3, 50):
        codes = np.concatenate([np.append(rng.integers(1, top, rng.integers(1, 90)), 0) for _ in range(12)])
        order = suffix_array.Suffixes(codes, int(top).bit_length()).order(200).tolist()
        tail = {p: tuple(codes[p : p + suffix_array._left(codes)[p]]) for p in order}
        assert [tail[p] for p in order] == sorted(tail.values()) and len(order) == int((codes > 0).sum())


def test_decontamination_of_odd_rows(spark, odd):
    clash = odd.withColumn("items", F.lit("mine")).withColumn("spans", F.lit(1)).withColumn("item", F.lit(1))
    items = spark.createDataFrame([(1, "one two"), (2, "W0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")], ITEMS)
    found = {(r.doc_id, r.text): r for r in suffix_array.contaminated(clash, items).collect()}
    assert set(next(iter(found.values())).asDict()) == {*odd.columns, "item", "items", "spans", "n_words"}
    assert found[5, "one two"]["items"] == [1] and found[None, "one two"].spans[0]["to"] == 2
    assert found[6, found_text(found, 6)]["items"] == [2] and found[1, None].n_words == 0
    assert [r["items"] for r in suffix_array.contaminated(odd, items.limit(0)).collect()] == [[]] * odd.count()
    assert suffix_array.contaminated(odd.limit(0), items).count() == 0
    assert suffix_array.longest_matches(odd, items.limit(0)).count() == 0


def found_text(found, key):
    return next(t for k, t in found if k == key)


# whitening


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def _check_whitening(frame, rows, wanted=16):
    """Compare with floating-point eigenvectors, by subspace where eigenvalues are equal."""
    sound = [(k, v) for k, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in sound), default=0)
    x = np.array([np.floor(64.0 * np.pad(np.float32(v).astype(float), (0, width - len(v)))) for _, v in sound]).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    cov = (fit - s / n).T @ (fit - s / n) / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    rank = int((values > 1e-9 * max(values.max(), 1e-9)).sum())
    found = whitening.whiten(frame, wanted=wanted).collect()
    assert len(found) == len(sound) * min(wanted, rank)
    assert {r.n for r in found} <= {n} and all(r.identity_error < 1e-9 for r in found)
    deviations = sorted((k, int(d)) for (k, _), d in zip(sound, ((n * x - s) ** 2).sum(1)))
    assert sorted((r.vec_id, int(r.deviation)) for r in found if r.component == 1) == deviations
    share = {r.component: r.explained for r in found}
    assert np.allclose([share[c] for c in sorted(share)], values[: len(share)] / values.sum(), rtol=1e-9)
    # the kernel of whitened vectors within each group of equal eigenvalues does not depend on the basis
    expected = ((x - s / n) @ axes[:, :rank]) / np.sqrt(values[:rank])
    order = {c: c - 1 for c in share}
    got = {}
    for r in found:
        got.setdefault(r.vec_id, {})[r.component] = r.whitened
    for c in order:
        like = np.flatnonzero(np.abs(values[:rank] - values[c - 1]) < 1e-6 * values[0])
        if like.max() >= len(share):
            continue
        for k, (key, _) in enumerate(sound):
            mine = sum(got[key][int(j) + 1] ** 2 for j in like)
            assert abs(mine - (expected[k, like] ** 2).sum()) < 1e-6 * max(1, mine)


def test_whitening_by_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 12)) * np.linspace(0.2, 2, 12)
    rows = [(i, [float(np.float32(x)) for x in base[i % 90]], 1) for i in range(120)]
    rows += [(500, None, 1), (501, [1.0, None], 1), (502, [float("nan")] * 12, 1), (503, [float("inf")] * 12, 0), (504, [0.5], 2)]
    _check_whitening(_vectors(spark, rows), rows)


def test_whitening_with_equal_eigenvalues_and_low_rank(spark):
    square = [[a, b, c, 0.0] for a in (0.0, 1.0) for b in (0.0, 1.0) for c in (0.0, 3.0)]
    rows = [(i, v, 0) for i, v in enumerate(square + square[:3])]
    _check_whitening(_vectors(spark, rows), rows)
    found = whitening.whiten(_vectors(spark, rows)).collect()
    assert {r.component for r in found} == {1, 2, 3}
    one, two = (next(r.explained for r in found if r.component == c) for c in (2, 3))
    assert one == two


def test_whitening_of_odd_tables(spark):
    empty = _vectors(spark, [])
    assert whitening.whiten(empty).count() == 0
    assert whitening.whiten(_vectors(spark, [(1, [0.5, 1.0], 0), (2, [0.5, 1.0], 0)])).count() == 0
    assert whitening.whiten(_vectors(spark, [(1, [], 0), (2, None, 0)])).count() == 0
    far = [(None, [1e30, 0.0], 0), (2, [0.0, 5.0], 0), (3, [1.0, 2.0], 0)]
    clash = _vectors(spark, far).withColumn("key", F.lit("mine")).withColumn("n", F.lit("x"))
    found = whitening.whiten(clash).collect()
    assert {r.vec_id for r in found} == {None, 2, 3} and all(np.isfinite(r.whitened) for r in found)


def test_polynomial_and_roots_are_exact(spark):
    # eigenvalues 1, 1, 4, 9 of a rotated diagonal matrix with integer entries
    q = np.array([[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]])
    matrix = (q @ np.diag([1, 1, 4, 9]) @ q.T).tolist()  # times 4
    c = whitening.polynomial(spark, matrix)
    expected = np.poly1d([1])
    for e in (4, 4, 16, 36):
        expected *= np.poly1d([1, -e])
    assert c == [int(v) for v in expected.coeffs[::-1]]
    assert [float(r) for r in whitening.greatest_roots(c, 3)] == [36.0, 16.0, 4.0]
    assert [whitening.roots_above(c, a, 0) for a in (0, 3, 4, 15, 16, 36)] == [4, 4, 2, 2, 1, 0]
    for p in (7, 101, 2147483647):
        assert whitening.polynomial_modulo(matrix, p) == [v % p for v in c]


def test_whitening_query_covers_its_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    found = QUERIES["op13_whitening"](spark, SF)
    assert found.count() == 16 * len(rows)
    _check_whitening(_vectors(spark, rows), rows)
