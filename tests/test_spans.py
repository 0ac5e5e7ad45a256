"""Span operators, embedding jobs and graph writes against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from narrata.functions import spans as sp
from narrata.operators import graph as gr
from narrata.operators import spans as so
from narrata.operators import vectors as vec
from narrata.plans import registry, spans as plans
from narrata.sources.model import Model

SF = "/root/testdata/sf0.001"


def test_relocation_operators_differ_as_their_functions(spark):
    frame = plans.moved(Model(spark, SF))
    rows = frame.collect()
    near = lambda found: sorted((k, a, b, round(x, 9)) for k, a, b, x, *_ in found)
    whole = [(r.id, *f) for r in rows if (f := sp.relocate(r.body, r.source, r.start_at, r.end_at))]
    first = [(r.id, *f) for r in rows if (f := sp.relocate_in(r.body, r.source, r.start_at, r.end_at, (r.seg_start, r.seg_end)))]
    assert near(so.fuzzy(frame).collect()) == near(whole) and near(so.segment_first(frame).collect()) == near(first)
    assert any(x < 1 for _, _, _, x in near(whole)) and len({r.how for r in so.relocated(frame).collect()}) >= 2


def test_segment_first_prefers_its_segment(spark):
    text = ("the old count walked home slowly. " + "filler words stand here now. " * 8)[:240] + "the old count walked home slowlx."
    row = [(1, text, "the old count walked home slowly", 250, 282, 200, len(text)), (2, text, "the old count walked home slowly", 250, 282, None, None), (3, None, "x", 0, 1, None, None)]
    frame = spark.createDataFrame(row, "id bigint, body string, source string, start_at int, end_at int, seg_start int, seg_end int")
    assert {r.id: r.start for r in so.fuzzy(frame).collect()} == {1: 0, 2: 0}
    found = {r.id: r.start for r in so.segment_first(frame).collect()}
    assert found[1] >= 200 and found[2] == 0


def test_mentions_are_linked_to_facets(spark):
    texts = [(1, "Mina met Lucy. MINA left. Minaret!", "Mina", ["Lucy", "met Lucy"]), (2, "", "Mina", None), (3, None, "x", None), (4, "Vlad " * 1000, "Vlad", [])]
    facets = [(1, 7, " mina"), (1, 8, "Mina"), (2, 9, "Mina"), (4, 10, "Dracula")]
    got = so.linked_mentions(spark.createDataFrame(texts, "id bigint, body string, name string, aliases array<string>"), spark.createDataFrame(facets, "node_id bigint, id bigint, content string"), "name", "aliases").collect()
    first = sorted((r.relative_start, r.relative_end, r.matched, r.facet_id) for r in got if r.id == 1)
    assert first == [(0, 4, "Mina", 8), (5, 13, "met Lucy", None), (15, 19, "MINA", 8)]
    rest = [r for r in got if r.id == 4]
    assert len(rest) == 1000 and all(r.facet_id is None and r.idx == 0 for r in rest) and {r.id for r in got} == {1, 4}


def test_overflow_goes_from_batches_to_segments_to_halves(spark):
    m = Model(spark, SF)
    rows, batches = {r.id: r.body or "" for r in m.texts.collect()}, {}
    for k, text in rows.items():
        batches.setdefault(k // 3, []).append((k, text))
    expected = set()
    for batch, members in batches.items():
        for k, text in members:
            if sum(len(t) for _, t in members) <= 9000:
                expected.add((batch, k, 0, 0, len(text), "batch"))
            elif len(text) <= 9000:
                expected.add((batch, k, 0, 0, len(text), "segment"))
            else:
                cut = sp.nearest_stop(text, len(text) // 2)
                halves = [(0, 0, cut, "half"), (1, cut, len(text), "half")] if 0 < cut < len(text) else [(0, 0, len(text), "segment")]
                expected |= {(batch, k, *h) for h in halves}
    got = registry.QUERIES["c6_overflow_split"](spark, SF).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected) and {r.how for r in got} == {"batch", "segment", "half"}


def test_embedding_in_batches_with_retries(spark, tmp_path):
    frame = spark.createDataFrame([(k, f"name number {k} of {k % 7}") for k in range(250)] + [(900, None), (901, "")], "id bigint, name string").coalesce(1)
    log = str(tmp_path / "calls")
    inner = vec.hashing_embedder(8, fault=3)

    def embed(texts, attempt):
        with open(log, "a") as out:
            out.write(f"{len(texts)} {attempt}\n")
        return inner(texts, attempt)

    got = {r.id: r.embedding for r in vec.embedded(frame, "name", embed, 8).collect()}
    right = vec.hashing_embedder(8)
    assert got[900] is None and got[901] is None
    assert all(got[k] == pytest.approx(right([f"name number {k} of {k % 7}"], 0)[0]) for k in range(250))
    calls = [tuple(map(int, line.split())) for line in open(log)]
    assert max(n for n, _ in calls) == 100 and {a for _, a in calls} == {0, 1} and sum(n for n, a in calls if not a) == 250
    with pytest.raises(Exception, match="wrong embedding dimensions"):
        vec.embedded(frame, "name", lambda texts, attempt: [[0.0]] * len(texts), 8).collect()


def test_reembedding_goes_on_after_a_crash(spark, tmp_path):
    facets = spark.createDataFrame([(k, k % 5, f"facet {k % 11} word") for k in range(80)], "id bigint, node_id bigint, content string")
    inner, dead = vec.hashing_embedder(6), str(tmp_path / "dead")

    def broken(texts, attempt):
        import os

        if any("facet 10" in t for t in texts) and not os.path.exists(dead):
            raise RuntimeError("service down")
        return inner(texts, attempt)

    job = vec.Reembedding(spark, str(tmp_path / "job"), batches=8)
    with pytest.raises(Exception, match="service down"):
        job.run(facets, "content", broken, 6)
    before = job.done()
    open(dead, "w").close()
    got = {r.node_id: list(r.centroid) for r in job.run(facets, "content", broken, 6).collect()}
    assert len(before) < 8 == len(job.done())
    for node in range(5):
        sums = [sum(x) for x in zip(*(inner([f"facet {k % 11} word"], 0)[0] for k in range(80) if k % 5 == node))]
        size = math.sqrt(sum(x * x for x in sums))
        assert got[node] == pytest.approx([x / size for x in sums])


def test_objects_and_signed_links(spark, tmp_path):
    import hashlib
    import hmac

    from narrata.sources import objects

    store = objects.ObjectStore(spark, str(tmp_path / "store"))
    store.put("a/one.bin", b"\x00\xff")
    store.put("a/one.bin", b"two")
    store.put("b.txt", "é".encode())
    assert store.get("a/one.bin") == b"two" and store.get("none") is None
    assert {(r.key, r["size"], bytes(r.content)) for r in store.objects("a/*").collect()} == {("a/one.bin", 3, b"two")}
    assert store.delete("b.txt") and not store.delete("b.txt") and store.get("b.txt") is None
    for key in ("", "../x", "a//b", "_x"):
        with pytest.raises(ValueError):
            store.put(key, b"")
    for secret in (b"short", b"long" * 40):
        frame = spark.createDataFrame([("GET", "a/é.png", 100), ("PUT", None, 100)], "method string, key string, expires bigint")
        sign = objects.signature(secret, F.col("method"), F.col("key"), F.col("expires"))
        got = frame.select(sign.alias("s")).collect()
        assert got[0].s == hmac.new(secret, "GET\na/é.png\n100".encode(), hashlib.sha256).hexdigest() and got[1].s is None
        ok = lambda given, now, method="GET": objects.valid_link(secret, F.lit(method), F.lit("a/é.png"), F.lit(100), F.lit(given), F.lit(now))
        assert tuple(spark.range(1).select(ok(got[0].s, 100), ok(got[0].s, 101), ok(got[0].s, 1, "PUT"), ok("x", 1)).head()) == (True, False, False, False)


def test_links_that_make_no_relationship(spark):
    ids = spark.createDataFrame([(1,), (2,), (2,)], "id bigint")
    wanted = spark.createDataFrame([(1, 2), (1, 9), (None, 1)], "src bigint, dst bigint")
    assert sorted((r.dst, r.created) for r in gr.linked(ids, ids, wanted).collect()) == [(1, False), (2, True), (9, False)]
    with pytest.raises(Exception, match="0 relationships created"):
        gr.linked(ids, ids, wanted, strict=True).collect()
    assert gr.linked(ids, ids, wanted.where("dst = 2"), strict=True).count() == 1


def test_thread_members_keep_gapless_places(spark):
    rng = random.Random(4)
    members = [(t, k, p) for t in (1, 2) for p, k in enumerate(rng.sample(range(50), 12), 1)]
    frame = spark.createDataFrame(members, "thread bigint, member bigint, place bigint")
    added = spark.createDataFrame([(1, 99), (1, 99), (1, members[0][1]), (3, 5)], "thread bigint, member bigint")
    removed = spark.createDataFrame([(1, members[3][1]), (2, 1000)], "thread bigint, member bigint")
    places = spark.createDataFrame([(1, members[5][1], 1), (2, members[14][1], 12)], "thread bigint, member bigint, place bigint")
    got = {}
    for r in gr.thread_members(frame, added, removed, places).orderBy("place").collect():
        got.setdefault(r.thread, []).append((r.place, r.member))
    one = [k for t, k, _ in members if t == 1]
    one.remove(members[3][1])
    one.remove(members[5][1])
    assert got[1] == list(enumerate([members[5][1], *one, 99], 1)) and got[3] == [(1, 5)]
    two = [k for t, k, _ in members if t == 2]
    moved = members[14][1]
    two.remove(moved)
    two.insert(len(two) - 1, moved)
    assert got[2] == list(enumerate(two, 1))
    assert gr.thread_members(frame.limit(0), added.limit(0), removed, places).where(F.lit(True)).count() == 0
