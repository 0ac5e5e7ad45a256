"""Hand-derived values, brute force and properties of functions that SQL does not express."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from narrata.functions import calendar as cal
from narrata.functions import spans as sp
from narrata.functions import text as tx
from narrata.functions.phonetic import primary_code
from narrata.operators import graph as gr
from narrata.operators import packing as pk
from narrata.operators import relational as rel
from narrata.operators import resolution as er
from narrata.operators import vectors as vec
from narrata.sources.importers import imported
from narrata.streaming import usage as us


def value(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).head()[0]


def test_names(spark):
    lit = F.lit
    assert value(spark, tx.normalise_name(lit("The Count Dracula"))) == "dracula"
    assert value(spark, tx.token_overlap(lit("Harry Potter"), lit("Harry Smith"))) == pytest.approx(1 / 3)
    assert value(spark, tx.alias_score(lit("Harry Potter"), lit("Harry Smith"))) == pytest.approx(0.6)
    assert value(spark, tx.alias_score(lit("Count Orlok"), lit("Count Vlad"))) == 0.7
    assert value(spark, tx.alias_variants(lit("Count Vlad Dracula"))) == ["count vlad dracula", "vlad dracula", "count", "the count", "vlad", "dracula"]
    assert value(spark, tx.edit_similarity(lit(""), lit(""))) == 1.0
    assert value(spark, tx.causation(lit("it happens"))) == "weak" and value(spark, tx.causation(lit(None).cast("string"))) == "none"
    assert value(spark, tx.embedding_text(lit("Mina"), lit(None).cast("string"), lit(None).cast("array<string>"))) == "Mina: "
    assert primary_code("Smith") == "SM0" and primary_code("dracula") == primary_code("drakula") == "TRKL" and primary_code("") == ""


@pytest.mark.parametrize(
    ("text", "n", "first"),
    [("Hello world. This is a test.", 2, "Hello world."), ("", 0, None), ("   ", 0, None), ("Short.", 0, None), ("a long text without any end", 1, None), ("Dr. Smith went to the store. He bought milk.", 2, "Dr. Smith went to the store.")],
)
def test_sentences(text, n, first):
    got = sp.sentences(text)
    assert len(got) == n and (first is None or got[0][2] == first)
    assert all(text[a:b].strip() == s for a, b, s, _ in got)


def test_segments_cover_the_text():
    rng = random.Random(2)
    for _ in range(20):
        text = "".join(rng.choice(["word ", "other\n\n", "***\n", "x" * 50, "more "]) for _ in range(rng.randint(1, 4000)))
        pieces = sp.segments(text)
        assert not sp.validate(pieces, len(text)) and "".join(text[a:b] for a, b in pieces) == text
    assert sp.segments("") == [] and sp.segments("abc") == [(0, 3)]
    assert sp.validate([(0, 5), (6, 9)], 9) == ["there is a gap before segment 1"]
    old = [("a", 0, 30, "the quick brown fox jumps over"), ("b", 30, 60, "another sentence with several words")]
    assert sp.reuse_ids(old, [(0, 30, old[0][3]), (31, 61, old[1][3])], 60) == ["a", "b"]


def test_occurrences_and_relocation():
    text = "Mina met mina-like Minas. MINA!"
    assert [(a, b, c) for a, b, _, c in sp.occurrences(text, "Mina")] == [(0, 4, 95), (9, 13, 95), (26, 30, 95)]
    assert sp.occurrences(text, "Mina", excluded=[(0, 2)])[0][0] == 9
    assert [x[3] for x in sp.occurrences("the Count came", "Dracula", ["count"])] == [85]
    body = "x" * 50 + " the quick brown fox jumps over the lazy dog near the river bank " + "y" * 50
    source = "the quick brown fox jumps over the lazy dog"
    assert sp.relocate(body, source, 51, 51 + len(source)) == (51, 51 + len(source), 1.0)
    assert sp.relocate(body, source, 0, 10) == (51, 51 + len(source), 1.0)
    near = sp.relocate(body, "the quick brown fax jumps over the lazy dog", 51, 94)
    assert near and near[2] >= 0.5 and abs(near[0] - 51) <= 20
    assert sp.relocate(body, "nothing like this at all here", 0, 5) is None and sp.relocate(body, "", 0, 0) is None
    assert sp.event_range("start here then the end comes", "start here", "the end") == (0, 23)


def test_diffs_of_lines_that_look_like_headers():
    old, new = "-- a comment\n--- a/file\nplain\n++ x", "++ added\n-- another\n--- a/file\n+++ b\nplain"
    patch = sp.diff(old, new)
    assert sp.apply_diff(old, patch) == new and sp.apply_diff(new, sp.invert_diff(patch)) == old
    assert sp.invert_diff(sp.invert_diff(patch)) == patch and sp.rebuild(new, [patch]) == old


def test_diffs_round_trip():
    rng = random.Random(4)
    for _ in range(60):
        a, b = ("\n".join(rng.choice(["a", "b", "c", "", "d d"]) for _ in range(rng.randint(0, 12))) for _ in range(2))
        patch = sp.diff(a, b)
        assert sp.apply_diff(a, patch) == b and sp.apply_diff(b, sp.invert_diff(patch)) == a
        assert sp.significant(patch) == (a != b)


def test_topological_order():
    assert gr.kahn([1, 2, 3], [2, 1, 0], [(1, 3), (2, 3)]) == [2, 1, 3]
    assert gr.kahn([1, 2, 3], [None, None, None], [(1, 2), (2, 1)]) == [3]
    rng = random.Random(7)
    for _ in range(50):
        n = rng.randint(1, 12)
        edges = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.3]
        order = gr.kahn(list(range(n)), [rng.choice([None, 1, 2, 3]) for _ in range(n)], edges)
        assert sorted(order) == list(range(n)) and all(order.index(a) < order.index(b) for a, b in edges)


def brute_cuts(n, edges):
    def parts(nodes):
        left, count = set(nodes), 0
        while left:
            todo = [left.pop()]
            count += 1
            while todo:
                x = todo.pop()
                for a, b in edges:
                    for p, q in ((a, b), (b, a)):
                        if p == x and q in left:
                            left.discard(q)
                            todo.append(q)
        return count

    return [k for k in range(n) if parts(set(range(n)) - {k}) > parts(set(range(n)))]


def test_cut_nodes():
    assert gr.cut_nodes([1, 2, 3], [(1, 2), (2, 3)]) == [2]
    rng = random.Random(11)
    for _ in range(80):
        n = rng.randint(1, 9)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 12))]
        edges = [(a, b) for a, b in edges if a != b]
        assert gr.cut_nodes(list(range(n)), edges) == brute_cuts(n, edges)


def graph(spark, edges, n=6):
    nodes = spark.createDataFrame([(k, 1, k, False) for k in range(n)], "id bigint, document_id bigint, document_order int, deleted boolean")
    return nodes, spark.createDataFrame([(i, a, b, "CAUSES", False) for i, (a, b) in enumerate(edges)], "id bigint, src bigint, dst bigint, edge_type string, deleted boolean")


def test_graph_operators(spark):
    nodes, edges = graph(spark, [(0, 1), (1, 2), (4, 3)])
    assert {(r.id, r.thread) for r in gr.threads(nodes, edges).collect()} == {(0, "0"), (1, "0"), (2, "0"), (3, "3"), (4, "3"), (5, "Uncategorized")}
    starts = spark.createDataFrame([(0,), (2,)], "start bigint")
    assert {(r.start, r.node) for r in gr.reachable(starts, edges).collect()} == {(0, 1), (0, 2)}
    wanted = spark.createDataFrame([(1, 2, 0), (2, 0, 2), (3, 5, 5)], "id bigint, src bigint, dst bigint")
    assert {r.id: r.cycle for r in gr.would_cycle(edges, wanted).collect()} == {1: True, 2: False, 3: True}
    kept = gr.guarded(edges.withColumn("document_id", F.lit(1).cast("bigint")), spark.createDataFrame([(1, 1, 2, 3), (1, 2, 3, 0), (1, 3, 0, 4)], "document_id bigint, id bigint, src bigint, dst bigint"))
    assert sorted(r.id for r in kept.collect()) == [1, 3]
    left, rest = gr.purge(nodes, edges, nodes.where("id = 1"))
    assert left.count() == 5 and {(r.src, r.dst) for r in rest.collect()} == {(4, 3)}


def test_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0, 0.0], 1), (1, [0.99, 0.1, 0.0], 1), (2, [0.0, 1.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 2), (4, None, 1)], "id bigint, vec array<float>, kind int")
    assert [(r.a, r.b) for r in vec.pairs(frame, "kind", 0.85).collect()] == [(0, 1)]
    assert {(r.a, r.b) for r in vec.pairs(frame, "kind", -1.0, blocks=3).collect()} == {(0, 1), (0, 2), (1, 2)}
    assert value(spark, vec.cosine(F.lit([0.0, 0.0]), F.lit([1.0, 0.0]))) == 0 and value(spark, vec.cosine(F.lit([1.0]), F.lit([1.0, 0.0]))) == 0
    assert [value(spark, vec.s_curve(F.lit(x))) for x in (0.0, 0.5, 1.0)] == pytest.approx([0, 0.5, 1])
    assert vec.project(frame.where("id = 0")).count() == 0
    spread = vec.project(frame.where("vec is not null")).collect()
    assert {r.x for r in spread} >= {200, 1800} and all(200 <= r.x <= 1800 and 200 <= r.y <= 1800 for r in spread)
    assert [r.ok for r in frame.orderBy("id").select(vec.valid(F.col("vec"), 3).alias("ok")).collect()] == [True] * 4 + [False]


def test_ranges_and_as_of(spark):
    one = F.lit
    assert not value(spark, rel.overlaps(one(0), one(5), one(5), one(9))) and value(spark, rel.overlaps(one(0), one(5), one(5), one(9), closed=True))
    states = spark.createDataFrame([(1, 10, "s10"), (1, 20, "s20")], "k int, at_order int, s string")
    points = spark.createDataFrame([(1, 5), (1, 10), (1, 25), (2, 7)], "k int, p int")
    get = lambda how: {(r.k, r.p): r.s for r in rel.as_of(points, states, "k", "p", "at_order", "s", how).collect()}
    assert get("null") == {(1, 5): None, (1, 10): "s10", (1, 25): "s20", (2, 7): None}
    assert get("first")[1, 5] == "s10" and get("first")[2, 7] is None
    segments = spark.createDataFrame([(1, "a", 0, 5), (1, "b", 5, 9)], "k int, name string, start_at int, end_at int")
    got = rel.containing(spark.createDataFrame([(1, 5), (1, 9)], "k int, p int"), segments, "k", "p").collect()
    assert [(r.p, r.name) for r in got] == [(5, "b")]
    rng = random.Random(3)
    make = lambda n: [(rng.randint(1, 2), a, a + rng.randint(1, 200)) for a in (rng.randint(0, 500) for _ in range(n))]
    left, right = make(40), make(40)
    frame = lambda x: spark.createDataFrame(x, "k int, start_at int, end_at int")
    for closed in (False, True):
        hit = (lambda x, y: not (x[2] < y[1] or x[1] > y[2])) if closed else (lambda x, y: x[1] < y[2] and x[2] > y[1])
        assert rel.overlap_join(frame(left), frame(right), "k", 32, closed).count() == sum(x[0] == y[0] and hit(x, y) for x in left for y in right)


def test_resolution(spark):
    rows = [((1.0, 1.0, 1.0, 0.0), 1.0), ((1.0, 0.0, 0.0, 0.0), 1.0), ((0.0, 0.0, 0.0, 0.0), 0.0), ((1.0, 0.5, 0.0, 0.0), 1 - 0.0625 / 0.25)]
    for signals, sure in rows:
        assert value(spark, er.confidence([F.lit(s) for s in signals])) == pytest.approx(sure)
    decide = lambda score, sure, name, kind=1.0: value(spark, er.decision(F.lit(score), F.lit(sure), F.lit(name), F.lit(kind)))
    assert decide(0.9, 0.5, 0.1) == "CREATE" and decide(0.7, 0.8, 0.5) == "MERGE" and decide(0.49, 1.0, 1.0) == "CREATE" and decide(0.7, 0.2, 0.5) == "REVIEW" and decide(0.9, 0.1, 0.9) == "MERGE"
    assert value(spark, er.type_match(F.lit("character"), F.lit("character_state"))) == 0.8


def test_packing():
    assert pk.balance(22, 20, 1) == [12, 11] and pk.balance(5, 10) == [5]
    got = pk.batches([10] * 23, room=200, output_room=10_000, reserve=lambda s: 0)
    covered = {k for first, n in got for k in range(first, first + n)}
    assert covered == set(range(23)) and all(n <= 20 for _, n in got)
    with pytest.raises(ValueError):
        pk.batches([500], 200, 100, lambda s: 0)
    assert pk.registry([(1, [50, 20, 5]), (2, [80, 40, 5]), (3, [10, 10, 6])], 100) == ([1, 2, 3], 1)
    ratio = pk.calibrate([(100.0, 50.0, False)] * 5 + [(100.0, 120.0, True)] + [(100.0, 50.0, False)] * 25)
    assert ratio[4] == 1.0 and ratio[5] == 2.0 and ratio[24] == 2.0 and ratio[25] == pytest.approx(1.9)
    assert pk.output_reserve(330) == math.ceil((4000 + 400) * 1.15)


def test_calendar_and_streams(spark):
    assert str(value(spark, cal.add_month_overflowing(F.lit("2023-01-31").cast("date")))) == "2023-03-03"
    jobs = spark.createDataFrame([(1, "processing", "2024-01-01 00:00:00", "2024-01-01 00:05:00", 1, 3), (2, "processing", "2024-01-01 00:10:00", None, 1, 3), (3, "processing", "2024-01-01 00:00:00", None, 3, 3)], "id int, status string, started_at string, progress_at string, retries int, max_retries int")
    got = {r.id: (r.status, r.retries) for r in us.recover(jobs, "2024-01-01 00:11:00").collect()}
    assert got == {1: ("queued", 2), 2: ("processing", 1), 3: ("failed", 3)}
    log = spark.createDataFrame([(k, "t") for k in range(1, 1003)], "id int, type string")
    assert us.buffered(log).count() == 501 and us.buffered(log.where("id <= 1000")).count() == 1000
    files = spark.createDataFrame([("text/html", "<b>a</b>&amp;b"), ("text/markdown", "# T\n*i*"), ("application/pdf", "x"), (None, None)], "mime string, body string")
    assert [r.plain for r in imported(files).collect()] == ["a &b", "T\ni", None, None]


def test_allow_lists():
    gr.check_allowed(["Character"], ["CAUSES", "HAS_FACET"], ["documentOrder"])
    for bad in ({"labels": ["Robot"]}, {"edge_types": ["HATES"]}, {"properties": ["a b"]}):
        with pytest.raises(ValueError):
            gr.check_allowed(**bad)


#: Primary codes of Double Metaphone by the published rules, worked out by hand.
PHONETIC = (
    "Schmidt XMT, Smith SM0, Thomas TMS, Garcia KRS, Vaughan FKN, Hugh H, Caesar SSR, Michael MKL, Jose HS, Wright RT, Tough TF, Laugh LF, "
    "Filipowicz FLPT, Bacher PKR, Knight NT, Accident AKST, Bertucci PRTX, Focaccia FKX, Thumb 0M, Rogier RJ, Xavier SF, Resnais RSN, "
    "Wasserman ASRM, Uomo AM, Zhao J, Gnome NM, Cagney KKN, Tagliaro TKLR, Danger TNJR, Artois ART, Breaux PR, School SKL, Schooner SKNR, "
    "Schermerhorn XRMR, Schenker XNKR, Sugar XKR, Island ALNT, Snider SNTR, Orchestra ARKS, Architect ARKT, Chianti KNT, Chemistry KMST, "
    "Chorus KRS, Chore XR, Church XRX, Bach PK, McClellan MKLL, Harry HR, Jonathan JN0N, Mina MN, Lucy LS, Arthur AR0R, Quincey KNS, John JN, "
    "Abraham APRH, Wilhelmina ALLM, Renfield RNFL, Vlad FLT, Potter PTR, Harker HRKR, Murray MR, Westenra ASTN, Dracula TRKL, Stephen STFN, "
    "Steven STFN, Edge AJ, Edgar ATKR, Ghost KST, Ghislane JLN, Night NT, Campbell KMPL, Raspberry RSPR, Cabrillo KPRL, Judge JJ, Sciascia SS, "
    "Sheila XL, Holmes HLMS, Nation NXN, Witch AX, Matthew M0, Hochmeier HKMR, Bajador PJTR, Pacheco PXK"
)


def test_phonetic_codes():
    from narrata.functions.phonetic import primary_code

    for name, code in (pair.split() for pair in PHONETIC.split(", ")):
        assert primary_code(name) == primary_code(name.lower()) == code, name
    assert primary_code(None) == primary_code("") == primary_code("12 -") == ""


def test_paths_of_any_length(spark):
    edges = spark.createDataFrame([(k, k + 1, "CAUSES") for k in range(70)] + [(70, 60, "CAUSES"), (100, 100, "CAUSES"), (100, 101, "CAUSES"), (5, None, "CAUSES")], "src bigint, dst bigint, edge_type string")
    starts = spark.createDataFrame([(0,), (65,), (100,), (101,), (999,), (0,)], "start bigint")
    found = sorted((r.start, r.node) for r in gr.reachable(starts, edges).collect())
    assert found == [(0, k) for k in range(1, 71)] + [(65, k) for k in range(60, 71)] + [(100, 100), (100, 101)]
    assert {r.node for r in gr.reachable(starts.where("start = 0"), edges, 50).collect()} == set(range(1, 51))


def test_cycles_of_any_length(spark):
    edges = spark.createDataFrame([(k, k + 1, "CAUSES") for k in range(70)], "src bigint, dst bigint, edge_type string")
    wanted = spark.createDataFrame([(1, 70, 0), (2, 0, 70), (3, 1, 0), (4, 9, 9), (5, 500, 0)], "id bigint, src bigint, dst bigint")
    assert {r.id: r.cycle for r in gr.would_cycle(edges, wanted).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}


def test_paths_against_brute_force(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(75)]
    near = {a: {y for x, y in edges if x == a} for a in range(60)}
    expected = set()
    for a in range(60):
        todo, seen = list(near[a]), set(near[a])
        while todo:
            fresh = near[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        expected |= {(a, b) for b in seen}
    frame = spark.createDataFrame(edges, "src bigint, dst bigint")
    every = spark.range(60).selectExpr("id AS start", "CAST(NULL AS BIGINT) AS node")
    assert sorted(tuple(r) for r in gr.paths(frame.distinct(), every, 16).collect()) == sorted(expected)
    asked = spark.createDataFrame([(a, b) for a in range(0, 60, 3) for b in range(60)], "start bigint, node bigint")
    assert {tuple(r) for r in gr.paths(frame.distinct(), asked, 16).collect()} == {p for p in expected if p[0] % 3 == 0}


def test_cycles_that_one_edge_answers_are_settled_in_one_join(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2, "CAUSES"), (1, 2, "ENABLES"), (2, 3, "CAUSES"), (3, 4, "LOCATED_AT"), (5, 6, "CAUSES")], "src bigint, dst bigint, edge_type string")
    settled, whole = [], gr.settle
    monkeypatch.setattr(gr, "settle", lambda frame: settled.append(frame) or whole(frame))
    direct = spark.createDataFrame([(1, 2, 1), (2, 3, 2), (3, 7, 7), (4, None, 1), (1, 2, 1)], "id bigint, src bigint, dst bigint")
    assert sorted(map(tuple, gr.would_cycle(edges, direct).collect())) == [(1, True), (1, True), (2, True), (3, True), (4, None)]
    assert len(settled) == 1
    further = direct.unionByName(spark.createDataFrame([(5, 3, 1), (6, 1, 3), (7, 4, 3)], direct.schema))
    assert sorted(map(tuple, gr.would_cycle(edges, further).collect())) == [(1, True), (1, True), (2, True), (3, True), (4, None), (5, True), (6, False), (7, False)]


def test_edges_are_the_same_with_parts_broadcast(spark):
    from narrata.plans.relational import visible
    from narrata.sources.model import Model

    m = Model(spark, "/root/testdata/sf0.001")
    plan = visible(m.near("part"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 4 and not visible(m.near("part", rows=1))._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast")
    key = lambda f: sorted(map(tuple, f.select("id", "src", "dst", "edge_type").collect()))
    assert key(visible(m.near("part"))) == key(visible(m)) != []
