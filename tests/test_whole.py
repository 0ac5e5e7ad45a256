"""Queries run over whole tables and whole texts: counts, brute force, and SQL without the clauses that cut it."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from narrata import plans  # noqa: F401
from narrata.functions import text as tx
from narrata.operators import resolution as er
from narrata.operators import vectors as vec
from narrata.plans import registry
from narrata.sources.model import Model

SF = "/root/testdata/sf0.001"


def test_views_keep_every_line(spark):
    m = Model(spark, SF)
    lines = m.raw("lineitem").collect()
    parts = {r.p_partkey for r in m.raw("part").select("p_partkey").collect()}
    types = "CAUSES|ENABLES|PREVENTS|HAPPENS_BEFORE|PARTICIPATES_IN|LOCATED_AT|HAS_FACET|BELONGS_TO_THREAD".split("|")
    edges = set()
    for r in lines:
        ends = (r.l_partkey, r.l_partkey + 50 * r.l_linenumber)
        src, dst = ends[::-1] if r.l_orderkey % 29 == 0 else ends
        if src in parts and dst in parts:
            edges.add((src, dst, types[(r.l_suppkey + r.l_linenumber) % 8]))
    assert m.mentions.count() == m.facets.count() == len(lines)
    assert {tuple(r) for r in m.edges.select("src", "dst", "edge_type").collect()} == edges


def test_blocked_product_is_whole(spark):
    left, right = spark.range(23).withColumnRenamed("id", "a"), spark.range(17).withColumnRenamed("id", "b")
    got = [tuple(r) for r in vec.product(left, right, "a", "b", rows=5).collect()]
    assert sorted(got) == [(a, b) for a in range(23) for b in range(17)]


def test_every_name_is_paired_and_clustered(spark):
    m = Model(spark, SF)
    token = m.names.select("id", "document_id", "kind", F.explode(F.array_distinct(tx.name_tokens(F.col("name")))).alias("t")).collect()
    expected = {(x.id, y.id) for x in token for y in token if x.id < y.id and (x.document_id, x.kind, x.t) == (y.document_id, y.kind, y.t)}
    got = [tuple(r) for r in registry.QUERIES["j22_blocking_join"](spark, SF).collect()]
    assert len(got) == len(set(got)) and expected <= set(got)
    ids = sorted(r.id for r in registry.QUERIES["e6_segment_clusters"](spark, SF).collect())
    assert ids == sorted(r.id for r in m.names.collect())


def test_packing_counts_whole_texts(spark):
    from narrata.plans.resolution import sized

    lengths = {r.doc_id: len(r.text or "") for r in Model(spark, SF).raw("documents").select("doc_id", "text").collect()}
    got = {r.id: r.tokens for r in sized(Model(spark, SF)).collect()}
    assert max(lengths.values()) > 4000 and all(got[k] == math.ceil(n / 3.3) for k, n in lengths.items() if n)


def test_overlaps_of_whole_texts(spark):
    by_source = {}
    for r in Model(spark, SF).raw("documents").orderBy("doc_id").collect():
        by_source.setdefault(r.source, []).append(r)
    expected = {}
    for docs in by_source.values():
        for x, y in zip(docs, docs[1:]):
            if x.text is None or y.text is None:
                continue
            a, b = x.text.lower().split(), y.text.lower().split()
            ga, gb = (set(zip(w, w[1:], w[2:])) for w in (a, b))
            expected[x.doc_id] = (len(set(a) & set(b)) / len(set(a)) if a else 0.0, len(ga & gb) / len(ga) if ga else 1.0)
    got = {r.id: (round(r.words, 9), round(r.trigrams, 9)) for r in registry.QUERIES["f12_overlaps"](spark, SF).collect()}
    assert got == {k: (round(x, 9), round(y, 9)) for k, (x, y) in expected.items()}


def test_blocks_share_a_token_or_a_code(spark):
    rows = [(1, 1, "character", "Stephen Hart"), (2, 1, "character", "Steven Lowe"), (3, 1, "character", "Mina Hart"), (4, 1, "place", "Steven"), (5, 2, "character", "Steven"), (6, 1, "character", "Io")]
    names = spark.createDataFrame(rows, "id bigint, document_id int, kind string, name string")
    got = [tuple(r) for r in er.blocked_pairs(names, names).where("a < b").collect()]
    assert sorted(got) == [(1, 2), (1, 3)]


def test_nearest_is_exact_after_the_filter(spark):
    m = Model(spark, SF)
    own = {r.id for r in m.nodes.collect() if not r.deleted and r.user_id == 1}
    rows = sorted(((r.id, r.vec, r.document_id) for r in m.vectors.collect()), key=lambda r: r[0])
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    ranked = sorted((-cosine(v, rows[0][1]), k) for k, v, d in rows if d == 1 and k in own)[:15]
    got = registry.QUERIES["v3_filtered_knn"](spark, SF).collect()
    assert ranked and sorted(r.id for r in got) == sorted(k for _, k in ranked)


def test_items_too_large_for_a_batch_go_alone(spark):
    from narrata.operators import packing as pk

    sizes, half = [100, 9000, 100, 100, 9000, 9000, 100], lambda s: sum(s) // 2
    got = pk.batches(sizes, 6000, 3000, half, alone=True)
    assert {k for first, n in got for k in range(first, first + n)} == set(range(7))
    assert all(n == 1 for first, n in got if any(sizes[k] == 9000 for k in range(first, first + n)))
    with pytest.raises(ValueError):
        pk.batches(sizes, 6000, 3000, half)
    ids = {r.id for r in registry.QUERIES["c1_batch_packing"](spark, SF).collect()}
    assert ids == {r.id for r in Model(spark, SF).texts.select("id").collect()}


def test_neighbours_among_copies_of_vectors(spark):
    """Vectors that occur many times: ties go by id, and a row is not its own neighbour; as all pairs by brute force."""
    rng = random.Random(8)
    some = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(12)]
    rows = [(k, k % 2, some[rng.randrange(12)]) for k in range(90)] + [(90, 0, None), (91, 7, some[0])]
    frame = spark.createDataFrame(rows, "id bigint, kind bigint, vec array<double>")
    unit = {k: [x / sum(y * y for y in v) ** 0.5 for x in v] for k, _, v in rows if v}
    found = set()
    for a, kind, v in rows:
        near = sorted((-round(sum(x * y for x, y in zip(unit[a], unit[b], strict=True)), 12), b) for b, k, w in rows if k == kind and b != a and v and w) if v else []
        found |= {(min(a, b), max(a, b)) for s, b in near[:4] if s <= -0.3}
    for rows_in_block in (3, 2000):
        got = vec.neighbours(frame, "kind", 4, 0.3, rows_in_block).collect()
        assert sorted((r.a, r.b) for r in got) == sorted(found) and len(got) > 90
