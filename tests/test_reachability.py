"""Reachability by appended rounds over contracted chains, against a plain walk."""

from __future__ import annotations

import random
import time
from pathlib import Path

from leafwright.operators import graph
from leafwright.session import shared_dir

EDGES = "doc_id string, node string, target string"
NODES = "doc_id string, node string"


def _walk(roots, refs):
    found = {}
    for doc, root in roots:
        seen, todo = {root}, [root]
        while todo:
            at = todo.pop()
            new = {t for d, n, t in refs if d == doc and n == at and t is not None} - seen
            seen |= new
            todo += new
        found[doc] = len(seen) - 1
    return found


def test_random_graphs_with_chains_and_rings(spark):
    rng = random.Random(4)
    refs, roots = [], []
    for i in range(30):
        doc, n = f"d{i}", rng.randint(1, 25)
        roots.append((doc, "n0"))
        for _ in range(rng.randint(0, 30)):
            refs.append((doc, f"n{rng.randrange(n)}", f"n{rng.randrange(n)}"))
        for k in range(rng.randint(0, 3)):  # chains, rings that nothing leads into, rings through the root
            names = [f"n{rng.randrange(n)}", *(f"c{k}.{j}" for j in range(rng.randint(1, 9)))]
            ends = [rng.choice((f"n{rng.randrange(n)}", "leaf", "n0"))]
            refs += [(doc, a, b) for a, b in zip(names, names[1:] + ends)]
            ring = [f"r{k}.{j}" for j in range(rng.randint(1, 4))]
            refs += [(doc, a, b) for a, b in zip(ring, ring[1:] + ring[:1])]
    refs += [("d0", "n0", None), ("d1", "n0", "n0"), ("d1", "n0", "n0")]
    got = {r.doc_id: r.n_reached for r in graph.reachable(spark.createDataFrame(roots, NODES), spark.createDataFrame(refs, EDGES)).collect()}
    assert got == _walk(roots, refs)


def test_a_chain_of_five_thousand_objects(spark):
    refs = [("d", "root" if i == 0 else f"o{i}", f"o{i + 1}") for i in range(5000)] + [("d", "o2500", "side"), ("d", "side", "o4000")]
    before = set(Path(shared_dir(spark).removeprefix("file:")).glob("appended-*"))
    start = time.perf_counter()
    row = graph.reachable(spark.createDataFrame([("d", "root")], NODES), spark.createDataFrame(refs, EDGES)).first()
    assert (row.n_reached, row.incomplete) == (5001, True)
    assert time.perf_counter() - start < 60
    (folder,) = set(Path(shared_dir(spark).removeprefix("file:")).glob("appended-*")) - before
    # the steps together hold every node once: nothing reached is written again
    written = spark.read.parquet(str(folder))
    assert written.count() == written.select("doc_id", "node").distinct().count() < 10
