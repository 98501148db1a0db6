"""Each rule gets rows that trigger it and rows that do not."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafwright.operators import compare, documents, findings, graph, grids, references, status, structure, update
from tests.conftest import rows


def test_heading_levels(spark):
    data = [("a", 1, 2), ("b", 1, 1), ("b", 2, 3), ("c", 1, 1), ("c", 2, 0), ("c", 3, 2), ("d", 1, 11), ("d", 2, 1), ("e", 1, 1), ("e", 2, 2)]
    frame = spark.createDataFrame(data, "doc_id string, pos long, level int")
    for block in (1, 100):
        found = structure.heading_hierarchy(frame, block=block).filter("rule_id IS NOT NULL")
        assert rows(found, "doc_id", "pos", "rule_id") == [
            ("a", 1, "HEADING002"), ("b", 2, "HEADING003"), ("c", 2, "HEADING001"), ("d", 1, "HEADING001"),
        ]


def test_cycle_members_without_tails(spark):
    edges = [("a", 1, 1), ("a", 2, 1), ("b", 1, 2), ("b", 2, 1), ("b", 3, 1), ("b", 4, 3), ("c", 1, 2), ("c", 2, 3), ("c", 3, 9)]
    frame = spark.createDataFrame(edges, "doc_id string, node long, next long")
    assert rows(graph.cycles(frame), "doc_id", "node") == [("a", 1), ("b", 1), ("b", 2)]


def test_long_chain_and_ring(spark):
    chain = spark.range(1, 300).select(F.lit("d").alias("doc_id"), F.col("id").alias("node"), (F.col("id") - 1).alias("next"))
    assert graph.cycles(chain).count() == 0
    ring = chain.withColumn("next", F.when(F.col("node") == 1, 299).otherwise(F.col("next")))
    assert graph.cycles(ring).count() == 299


def test_style_chains(spark):
    data = [
        ("d", "root", None, {"c": "1", "s": "9"}), ("d", "kid", "root", {"c": "2"}), ("d", "deep", "kid", {}),
        ("d", "lost", "nobody", {}), ("d", "x", "y", {}), ("d", "y", "x", {}), ("d", "tail", "x", {}),
        ("d", "twin", None, {}), ("d", "twin", None, {}), ("d", "under", "twin", {}),
    ]
    frame = spark.createDataFrame(data, "doc_id string, name string, parent string, props map<string,string>")
    got = {r["name"]: (r["status"], r["depth"], r["props"]) for r in graph.resolve_chains(frame, ["doc_id", "name"], props="props").collect()}
    assert got["deep"] == (None, 2, {"c": "2", "s": "9"})
    assert got["lost"][0] == "missing" and got["under"][0] == "ambiguous" and got["twin"][0] == "ambiguous"
    assert {got[n][0] for n in ("x", "y", "tail")} == {"cyclic"}


def test_reachability_goes_on_past_the_limit(spark):
    edges = [("a", f"n{i}", f"n{i + 1}") for i in range(5)] + [("b", "n0", "n1"), ("b", "n1", "n0")]
    refs = spark.createDataFrame(edges, "doc_id string, node string, target string")
    roots = spark.createDataFrame([("a", "n0"), ("b", "n0"), ("c", "n0")], "doc_id string, node string")
    assert rows(graph.reachable(roots, refs, 3)) == [("a", 5, True), ("b", 1, False), ("c", 0, False)]


def test_reference_states(spark):
    anchors = [("d", "link", "one", True), ("d", "link", "two", True), ("d", "link", "two", True), ("d", "link", "hid", False), ("d", "link", "both", True), ("d", "link", "both", False)]
    frame = spark.createDataFrame([(*a, None) for a in anchors], "doc_id string, kind string, name string, in_flow boolean, note_class string")
    names = ["one", "two", "hid", "both", "gone", "a|b"]
    refs = spark.createDataFrame([("d", "link", n) for n in names], "doc_id string, kind string, name string")
    got = dict(rows(references.resolve_refs(refs, frame), "name", "rule_id"))
    assert got == {"one": None, "two": "REF002", "hid": "REF004", "both": "REF004", "gone": "REF001", "a|b": "REF004"}


def test_status_precedence(spark):
    codes = [("a", 3), ("a", 4), ("b", 2), ("b", 4), ("c", 1), ("c", 2), ("d", 0)]
    frame = spark.createDataFrame(codes, "k string, code int")
    got = frame.groupBy("k").agg(findings.combine_status(F.col("code")).alias("s"))
    assert rows(got) == [("a", 3), ("b", 4), ("c", 2), ("d", 0)]
    empty = frame.filter("false").agg(findings.combine_status(F.col("code")).alias("s"))
    assert rows(empty) == [(0,)]


def test_trailing_empty_keeps_the_first(spark):
    data = [("all", 1, True), ("all", 2, True), ("mid", 1, True), ("mid", 2, False), ("mid", 3, True), ("full", 1, False)]
    frame = spark.createDataFrame(data, "doc_id string, pos long, empty boolean")
    assert rows(structure.trailing_empty(frame, "doc_id", "pos", F.col("empty")), "doc_id", "pos") == [("all", 2), ("mid", 3)]


def test_null_styles_are_no_peers(spark):
    data = [("d", 1, "c", None), ("d", 2, "c", None), ("d", 3, "c", "L"), ("d", 4, "c", "L")]
    frame = spark.createDataFrame(data, "doc_id string, id long, context string, style string")
    got = structure.previous_peer(frame, ["doc_id", "context"], "id", "id", "style", 1)
    assert rows(got, "id", "peer") == [(1, None), (2, None), (3, None), (4, 3)]


def test_multiset_links(spark):
    before = spark.createDataFrame([("d", "u"), ("d", "u"), ("d", "v")], "doc_id string, uri string")
    after = spark.createDataFrame([("d", "u"), ("d", "w")], "doc_id string, uri string")
    assert rows(compare.link_diff(before, after)) == [("d", "u", "FIDELITY004", 1), ("d", "v", "FIDELITY004", 1), ("d", "w", "FIDELITY006", 1)]


def _texts(spark, text):
    return spark.createDataFrame([("d", i, t) for i, t in enumerate(text)], "doc_id string, page long, text string")


def _first_difference(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_first_difference_against_brute_force(spark):
    long_ = " ".join(f"word{i}" for i in range(700))
    cases = [
        (["foo bar"], ["foobar"]), (["foo"], ["foo bar"]), ([""], ["x"]), (["a b", "c"], ["a", "b d"]),
        ([long_], [long_.replace("word600", "word6x0")]), ([long_], [long_ + " more"]), ([long_, "z"], [long_.replace("word255 ", "")]),
    ]
    for before, after in cases:
        a, b = (" ".join(" ".join(side).split()) for side in (before, after))
        row = compare.first_diff(_texts(spark, before), _texts(spark, after)).first()
        at = _first_difference(a, b)
        assert row["position"] == at
        start = max(at - 40, 0)
        assert (row["source"], row["candidate"]) == (a[start : at + 40], b[start : at + 40])
    same = compare.first_diff(_texts(spark, ["a  b", "c"]), _texts(spark, ["a", "b c"]))
    assert same.count() == 0


def test_first_difference_at_the_ends_of_spans(spark):
    whole = "".join(chr(97 + i * i % 23) for i in range(9000))
    ends = [0, 1, 40, 41, 64, 4054, 4055, 4056, 4095, 4096, 4097, 4136, 8191, 8192, 8999]
    before, after, expected = [], [], {}
    for i, at in enumerate(ends):
        for kind, b in enumerate((whole[:at] + "é" + whole[at + 1 :], whole[:at], whole[:at] + " " + whole[at:])):
            doc = f"{i}/{kind}"
            before += [(doc, j, whole[s:e]) for j, (s, e) in enumerate(((0, 9000),))]
            after.append((doc, 3, b))
            b = " ".join(b.split())
            if b != whole:
                p = _first_difference(whole, b)
                expected[doc] = (p, whole[max(p - 40, 0) : p + 40], b[max(p - 40, 0) : p + 40])
    pages = "doc_id string, page long, text string"
    found = compare.first_diff(spark.createDataFrame(before, pages), spark.createDataFrame(after, pages), 2)
    assert {r.doc_id: (r.position, r.source, r.candidate) for r in found.collect()} == expected
    # no text is looked up again: the two joins are those of the blocks' carries
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_manifest(spark):
    recorded = spark.createDataFrame([("b", "ok", "1"), ("b", "gone", "1"), ("b", "old", "1"), ("b", "../x", "1")], "bundle_id string, name string, sha256 string")
    observed = spark.createDataFrame([("b", "ok", "1", "file"), ("b", "old", "2", "file"), ("b", "new", "1", "file"), ("b", "ln", "1", "link")], "bundle_id string, name string, sha256 string, kind string")
    got = {r["name"]: r["problem"] for r in compare.verify_manifest(recorded, observed).collect()}
    assert got == {"gone": "Missing", "old": "Modified", "new": "Unlisted", "../x": "Unsafe", "ln": "Unsafe"}


def _coverage(cells: list[tuple], rows_: int, columns: int) -> set[str]:
    """Plain restatement of the grid rules for one table."""
    found, occupied = set(), {}
    for y, x, h, w, covered in cells:
        if not covered:
            if y + h > rows_ or x + w > columns:
                return {"beyond grid"}
            for spot in ((r, c) for r in range(y, y + h) for c in range(x, x + w)):
                occupied[spot] = occupied.get(spot, 0) + 1
    if any(n > 1 for n in occupied.values()):
        found.add("overlap")
    if sum(h * w for _, _, h, w, covered in cells if not covered) > rows_ * columns:
        return {"overlap"}
    if any(covered and (y, x) not in occupied for y, x, _, _, covered in cells):
        found.add("covered without origin")
    return found


def test_grid_coverage_against_brute_force(spark):
    import random

    rng = random.Random(7)
    tables, cells, want = [], [], {}
    for table in range(60):
        size = (rng.randint(1, 4), rng.randint(1, 4))
        own = [(rng.randrange(4), rng.randrange(4), rng.randint(1, 2), rng.randint(1, 2), rng.random() < 0.2) for _ in range(rng.randint(1, 6))]
        tables.append(("d", table, *size))
        cells += [("d", table, *c) for c in own]
        if any(c[4] or c[2] > 1 or c[3] > 1 for c in own):
            want[table] = _coverage(own, *size)
    t = spark.createDataFrame(tables, "doc_id string, table_id long, rows int, columns int")
    c = spark.createDataFrame(cells, "doc_id string, table_id long, y int, x int, row_span int, col_span int, covered boolean")
    got: dict[int, set[str]] = {}
    for r in grids.grid_coverage(t, c).collect():
        got.setdefault(r["table_id"], set()).add(r["reason"])
    assert got == {k: v for k, v in want.items() if v}


def test_ranges_across_buckets_once(spark):
    ranges = spark.createDataFrame([("d", 1, 1, 1000)], "doc_id string, r int, first_row long, last_row long")
    runs = spark.createDataFrame([("d", 1, 400), ("d", 401, 2000), ("d", 2001, 2001)], "doc_id string, run_start long, run_end long")
    for bucket in (7, 100, 10_000):
        assert grids.cells_in_range(ranges, runs, ["doc_id"], bucket).count() == 2


def test_name_references_against_brute_force(spark):
    names = ["Sheet 1", "a.b", "It's", "x"]
    values = ["=[Sheet 1.A1]", "sheet 10.B2", "#x", "'it''s'.C3", "see a.b.", "nothing", "#'a.b'", "axe."]
    want = set()
    for n in names:
        spelled = {n.lower(), "'" + n.lower().replace("'", "''") + "'"}
        for v in (v.lower() for v in values):
            if any(s + "." in v or v == "#" + s for s in spelled):
                want.add(n)
    n = spark.createDataFrame([("d", x) for x in names], "doc_id string, name string")
    v = spark.createDataFrame([("d", x) for x in values], "doc_id string, value string")
    assert {r["name"] for r in references.name_referenced(n, v).collect()} == want


def test_decorative_and_alternative(spark):
    schema = "doc_id string, graphic_id long, kind string, title string, description string, visible_text string, payload boolean, decorative boolean, ancestors array<string>"
    data = [
        ("d", 1, "frame", None, " ", "", True, False, []), ("d", 2, "frame", "t", None, "", True, False, []),
        ("d", 3, "frame", None, None, "words", False, False, []), ("d", 4, "frame", None, None, "", False, False, []),
        ("d", 5, "g", None, None, "", True, True, []), ("d", 6, "frame", "kept", None, "", True, True, []),
        ("d", 7, "frame", None, None, "", True, True, ["a"]), ("d", 8, "frame", None, None, "", True, True, []),
    ]
    frame = spark.createDataFrame(data, schema)
    assert rows(documents.missing_alternative(frame), "graphic_id", "rule_id") == [(1, "GRAPHIC001"), (4, "GRAPHIC002")]
    assert rows(documents.decorative_conflict(frame), "graphic_id", "rule_id") == [(5, "GRAPHIC003"), (6, "GRAPHIC004"), (7, "GRAPHIC003")]


def test_edits_are_idempotent_and_accounted(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, name string, fixed long")
    bound = spark.createDataFrame([(1, "x"), (2, "b"), (9, "y")], "k long, name string")
    once, outcomes = update.apply_answers(table, bound, "k", ["name"])
    twice, again = update.apply_answers(once, bound, "k", ["name"])
    assert rows(once) == rows(twice) == [(1, "x", 1), (2, "b", 2)]
    assert rows(outcomes, "k", "status") == [(1, "applied"), (2, "unchanged"), (9, "failed")]
    assert rows(again, "k", "status") == [(1, "unchanged"), (2, "unchanged"), (9, "failed")]
    allowed = bound.select("k", F.lit("edit").alias("permission"))
    assert update.preserved(table, once, "k", ["name"], allowed).count() == 0
    spoiled = once.withColumn("fixed", F.lit(7).cast("long"))
    assert rows(update.preserved(table, spoiled, "k", ["name"], allowed)) == [(1, "protected column"), (2, "protected column")]
    assert update.accounting(outcomes.filter("status <> 'failed'"), table, once, "k").count() == 0
    assert update.accounting(outcomes.filter("status <> 'failed'"), table, table, "k").count() == 1


def test_stages_skip_without_input(spark):
    names = [f"result_{i}" for i in range(1, 9)]
    schema = "item long, level int, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(1, 2, *["passed"] * 8), (2, 0, *["passed"] * 8), (3, 2, "refused", *["passed"] * 7)], schema)
    got = {(r["item"], r["ord"]): (r["outcome"], r["reason"], r["producer"]) for r in status.stage_plan(docs).collect()}
    assert all(got[1, i][0] == "passed" for i in range(1, 9))
    assert got[2, 2] == ("skipped", "profile", None) and got[2, 3][0] == "passed"
    assert got[3, 3] == ("skipped", "missing-input", "audit-source")
    assert got[3, 8] == ("skipped", "missing-input", "export-source")


def test_counts_partition_findings(spark):
    found = spark.createDataFrame([("d", "HEADING001"), ("d", "LINK001"), ("d", "STYLE002"), ("e", "LINK003")], "doc_id string, rule_id string")
    counted = findings.summary(findings.union_findings(findings.raise_rule(found, F.col("rule_id"))))
    assert rows(counted) == [("d", 1, 1, 1), ("e", 1, 0, 0)]


def test_navigation_moves_its_shapes_once(spark):
    key = "doc_id string, page_id long"
    pages = [("d", 1, True), ("d", 2, True), ("d", 3, True), ("d", 4, False), ("d", 5, False), ("d", 6, True), ("e", 1, True), ("e", 2, True),
             ("d", 1, False), ("e", 1, None), (None, 1, True)]
    shapes = [("d", 1, "a"), ("d", 1, "b"), ("d", 2, "c"), ("d", 3, "x"), ("d", 4, "x"), ("d", 4, "y"), ("d", 5, "z"), ("e", 1, "x"), ("e", 2, None), (None, 1, "x")]
    listed = [("d", 1, "b"), ("d", 1, "a"), ("d", 2, "c"), ("d", 2, "c"), ("d", 3, "x"), ("e", 1, "x"), ("e", 2, None)]
    of = lambda data: spark.createDataFrame(data, f"{key}, shape_id string")
    got = graph.navigation(spark.createDataFrame(pages, f"{key}, declared boolean"), of(listed), of(shapes))
    # d/2 lists a shape twice, x is in two pages of d, d/6 has no shapes, e/2 has one without a name
    assert rows(got) == sorted(
        [("d", 1, 2, None), ("d", 2, 1, "PAGE004"), ("d", 3, 1, "PAGE004"), ("d", 4, 2, "PAGE005"), ("d", 5, 1, None), ("d", 6, 0, "PAGE004"),
         ("e", 1, 1, None), ("e", 2, 1, "PAGE004"), ("d", 1, 2, "PAGE005"), ("e", 1, 1, None), (None, 1, 0, "PAGE004")], key=repr,
    )
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
