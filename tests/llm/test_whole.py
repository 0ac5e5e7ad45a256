"""Training-data operators see whole texts, whatever their form."""

from __future__ import annotations

import re

import pytest

from narrata.llm import decontaminate, licenses, near_dedup, quality_rules, toxicity

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
BSD = "# Redistribution and use in source and binary forms, with or without\r\n# modification, are permitted provided that the following conditions\r\n# are met:"


def test_wrapped_licenses_are_found(spark):
    words = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
    table = [(1, f"prose before\n{MIT}"), (2, BSD), (3, words.replace(" ", "\n")), (4, MIT.replace("\n", "\n\n")), (5, "prose\nwithout any\nrights here"), (6, "Copyright. All rights\nreserved."), (7, None)]
    frame = spark.createDataFrame(table, "doc_id bigint, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(frame).collect()}
    assert got == {1: ("mit", 1.0), 2: ("bsd", 1.0), 3: ("isc", 1.0), 4: ("", 0.0), 5: ("", 0.0), 6: ("all-rights-reserved", 1.0), 7: ("", 0.0)}
    assert licenses.scan(frame, given=[]).count() == len(table)


def test_runs_match_brute_force(spark):
    import random

    rng = random.Random(3)
    vocabulary = "alpha beta gamma delta eps zeta".split()
    given = [("x", "alpha beta gamma"), ("y", "delta eps zeta alpha")]
    table = [(k, "\n".join(" ".join(rng.choices(vocabulary + ["w"] * 9, k=rng.randint(0, 5))) for _ in range(9))) for k in range(60)]
    expected = set()
    for k, text in table:
        lines = [re.findall(r"\w+", t) for t in text.split("\n")]
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if j > i and (not all(lines[i : j + 1]) or sum(map(len, lines[i + 1 : j])) > 4):
                    break
                have = {w for t in lines[i : j + 1] for w in t}
                expected |= {(k, label) for label, t in given if set(t.split()) <= have}
    frame = spark.createDataFrame(table, "doc_id bigint, text string")
    assert expected and {(r.doc_id, r.label) for r in licenses.matches(frame, given).collect()} == expected


def test_toxicity_reads_whole_clauses():
    def score(g, text):
        hits = sorted({m.start() for w in [*g.words, *toxicity.THREAT] for m in re.finditer(rf"\b{w}", text)})
        return g.score(text, hits)

    g = toxicity.Grammar({"idiot": 0.98}, {})
    filler = lambda n: "word " * (n // 5)
    # The threat word alone says nothing; the insult straddles the 400th character after it.
    far = "kill " + filler(390) + "xx idiot"
    assert far.index("idiot") < 400 < far.index("idiot") + 5 and score(g, far) > 0.8
    assert score(g, f"this is not {filler(600)} an idiot") < 0.3
    assert score(g, f"he said {filler(600)} an idiot. what an idiot! fine") > 0.8
    assert score(g, "one clause. another") == 0 and score(g, "") == 0
    assert abs(score(g, "an idiot! an idiot") - (1 - (1 - 0.98 * toxicity.PLAIN_FACTOR) ** 2)) < 1e-12


def test_items_that_repeat_themselves_are_found(spark):
    cycles = [[f"c{j}w{i}" for i in range(10)] for j in range(30)]
    items = [(j, " ".join(cycle * 5)) for j, cycle in enumerate(cycles)]
    # Few distinct shingles, the missing ones said often: no long run is left.
    z = [f"z{i}" for i in range(9)]
    items.append((77, " ".join(" ".join([f"a{k}", *z]) for k in range(40))))
    before = lambda n: " ".join(f"p{i}" for i in range(n))
    table = [(100 * j + n, f"{before(n)} " + " ".join((cycle * 3)[n : n + 12]) + " u v w x y") for j, cycle in enumerate(cycles) for n in range(6)]
    table.append((9999, " ".join(" ".join([f"a{k}", *z[:4], "other", *z[5:]]) for k in range(40))))
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    expected = {(d, i) for d, t in table for i, x in items if len(grams(x) & grams(t)) / len(grams(x)) >= 0.8}
    frame = spark.createDataFrame(table, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.containment(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert (9999, 77) in expected and len(expected) == 181 and got == expected


def test_components_of_few_and_of_many_edges(spark):
    """The driver's union of sets and the rounds on executors name the same least nodes."""
    import random

    from narrata.llm import near_dedup

    rng = random.Random(4)
    name = lambda k: bytes([(k * 37) % 256] * 16)
    pairs = [(bytearray(name(a)), bytearray(name(b))) for a, b in ((rng.randrange(80), rng.randrange(80)) for _ in range(45))] + [(bytearray(name(100 + k)), bytearray(name(101 + k))) for k in range(40)]
    edges = spark.createDataFrame(pairs, "a binary, b binary")
    few, many = ({bytes(r.node): bytes(r.root) for r in near_dedup.components(edges, n).collect()} for n in (1000, 3))
    assert few == many and len(set(few.values())) > 3 and all(few[bytes(a)] == few[bytes(b)] for a, b in pairs)
    assert near_dedup.components(edges.limit(0)).count() == 0


def test_texts_of_untouched_rows_are_read_once_and_never_shuffled(spark, monkeypatch):
    """Beyond what may be broadcast with nodes, only rows whose ids were dropped are joined: no words are made in the plan
    that filters, and the rows that stay whatever happens meet no shuffle."""
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = near_dedup.filter_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "LeftAnti" in plan
    assert "regexp_extract_all" not in quality_rules.filter_documents(docs)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("limit", [0, 1000])
def test_documents_with_null_and_shared_ids_are_parted_rightly(spark, monkeypatch, limit):
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(near_dedup, "SINGLE_KEYS", limit)
    said = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, said(1)), (2, said(1)), (2, said(2)), (2, said(2)), (3, said(3)), (3, said(3)), (3, said(4)), (4, None), (4, None), (5, ""), (None, said(5)), (None, said(6)), (6, said(6)), (None, said(7)), (None, said(7)), (None, None), (7, said(8))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    expected = [(1, said(1)), (2, said(2)), (3, said(3)), (3, said(4)), (4, None), (4, None), (5, ""), (None, said(5)), (6, said(6)), (None, said(7)), (None, None), (7, said(8))]
    got = [(r.doc_id, r.text) for r in near_dedup.filter_documents(docs).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    if limit:
        assert near_dedup.filter_documents(docs.where("doc_id = 7")).count() == 1 and near_dedup.filter_documents(docs.where("doc_id is null")).count() == 4
