"""Training-data operators against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrata.llm import decontaminate, language_id, licenses, mixing, near_dedup, quality_model, quality_rules, sharding, token_counts, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, size string, hash string, node string, words string, h string"
SF = "/root/testdata/sf0.001"


def prose(rng: random.Random, n: int) -> str:
    pool = "the of and to in that with for was from".split() + [f"w{k}x" for k in range(400)]
    return " ".join(rng.choice(pool) for _ in range(n))


def rows() -> list[tuple]:
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(60, 160)) for _ in range(24)]
    near = texts[0].split()
    near[20] = "changed"
    texts += [texts[1], texts[1].upper(), " ".join(near), None, "", " \n\t ", "one two", "ONE  two!", prose(rng, 30_000), "same same same same same same " * 30]
    texts += ["Licensed under the Apache License, Version 2.0.\n" + texts[2], "released under the mit license\nMIT License\nMIT-License", texts[3] + "\nAll rights reserved."]
    found = [(k, t, [None, "en", "de"][k % 3], [None, "b", "a", "c"][k % 4], None) for k, t in enumerate(texts)]
    found += [found[5], found[5], (None, texts[6], "en", "a", 3), (7, "another text of seven words for id seven", None, None, None)]
    return found


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "y", "z", "n", "w", "h") for r in rows()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def test_every_operator_takes_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([], "item_id bigint, text string")
    yes = F.lit(True)
    assert mixing.Mix(empty).taken().count() == 0
    assert mixing.Mix(empty).documents().count() == 0
    assert near_dedup.classes(empty).count() == 0
    assert near_dedup.filter_documents(empty).count() == 0
    assert language_id.predict(empty, language_id.fit(empty, yes)).count() == 0
    assert quality_model.score(empty, quality_model.fit(empty, labels, yes)).count() == 0
    assert sharding.digest(empty).count() == 0
    assert decontaminate.containment(empty, items).count() == 0
    assert decontaminate.filter_documents(empty, items).count() == 0
    assert quality_rules.judge(empty).count() == 0
    assert quality_rules.filter_documents(empty).count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, labels, yes)).count() == 0
    assert token_counts.signed(token_counts.inserts(empty)).count() == 0
    assert licenses.scan(empty).count() == 0


# --- mixing


def test_targets_share_what_capped_sources_leave():
    assert mixing.targets([10, 100, 0], [1, 1, 5]) == [30.0, 80.0, 0.0]
    got = mixing.targets([5, 50, 500], [1, 2, 3])
    assert sum(got) == pytest.approx(555) and all(t <= 3 * s + 1e-9 for t, s in zip(got, [5, 50, 500]))
    assert mixing.targets([], []) == []


def test_permutations_are_permutations():
    for n in (1, 2, 3, 17, 1000):
        for key in (1, 2):
            got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(got) == list(range(n))


def test_draws_are_multinomial_around_the_weights_and_meet_the_targets():
    sizes = [1_000_000, 2_000_000, 3_000_000, 640, 0]
    wanted = mixing.targets(sizes, [1, 2, 3, 1, 2])
    found = np.array([mixing.draws(sizes, wanted, 64, 16, seed) for seed in range(60)])
    totals = found.sum(axis=1)
    assert (totals == totals[0]).all() and np.abs(totals[0] * 64 - np.array(wanted)).max() <= 64
    assert np.ptp(found.sum(axis=2)) <= 1 and (totals[0] <= 3 * -(-np.array(sizes) // 64)).all()
    # The first shard is a plain multinomial draw: mean n p, variance n p (1 - p).
    p = totals[0] / totals[0].sum()
    n = found[0, 0].sum()
    for k in range(3):
        assert found[:, 0, k].mean() == pytest.approx(n * p[k], rel=0.02)
        assert 0.5 < found[:, 0, k].var() / (n * p[k] * (1 - p[k])) < 1.7
    assert mixing.draws([], [], 64, 16, 1).shape == (16, 0)
    assert mixing.draws([10], [30.0], 64, 16, 1).sum() == 3


def test_mix_takes_what_blocks_say(docs):
    mix = mixing.Mix(docs, block=8)
    taken = mix.taken().collect()
    assert len(taken) == len(rows())
    assert sum(r.size for r in taken) == sum(len(words(t)) for _, t, *_ in rows())
    by_source = defaultdict(lambda: [0, 0.0, 0])
    for r in taken:
        assert r.taken <= 3 * r["size"]
        s = by_source[r.source]
        s[0], s[1], s[2] = s[0] + r["size"], r.target, s[2] + r.taken
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    expected = mixing.targets([by_source[s][0] for s in order], [1, 2, 3, 1][: len(order)])
    for s, target in zip(order, expected):
        assert by_source[s][1] == pytest.approx(target)
        assert by_source[s][2] == pytest.approx(target, abs=24)
    # Brute force: lay the streams out word by word and take the planned slots.
    times = Counter()
    for p in mix.plan.collect():
        at = np.arange(p.first, p.first + p["count"])
        times.update((p.sid, int(b)) for b in mixing.permute(at % p.n, np.full(len(at), p.n), np.full(len(at), p.key)))
    brute = Counter()
    for r in mix.placed.collect():
        brute[r.doc_id, r["size"]] += sum(times[r.sid, k // 8] for k in range(r.start, r.start + r["size"]))
    got = Counter()
    for r in taken:
        got[r.doc_id, r["size"]] += r.taken
    assert got == brute
    out = mix.documents().collect()
    assert sum(len(words(r.text)) for r in out) == sum(r.taken for r in taken)
    whole = {t for _, t, *_ in rows()}
    assert any(r.text in whole for r in out) and all(r.n_chars == len(r.text) for r in out)
    again = Counter((r.doc_id, r["size"], r.taken) for r in mixing.Mix(docs.repartition(5), block=8).taken().collect())
    assert again == Counter((r.doc_id, r["size"], r.taken) for r in taken)


# --- near duplicates


def bag(text: str | None) -> Counter:
    w = plain(text)
    return Counter([tuple(w)] if 1 <= len(w) <= 4 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute_classes(docs: list[tuple]) -> dict[int, int]:
    bags, parent = [bag(t) for _, t, *_ in docs], list(range(len(docs)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both, union = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if union and both / union >= 0.8:
                parent[root(i)] = root(j)
    return {i: root(i) for i in range(len(docs))}


def test_near_duplicates_match_brute_force(docs):
    all_rows = rows()
    roots = brute_classes(all_rows)
    groups = defaultdict(list)
    for i, r in roots.items():
        groups[r].append(all_rows[i][0])
    expected = Counter()
    for ids in groups.values():
        least = min((x for x in ids if x is not None), default=None)
        expected.update((x, least, len(ids)) for x in ids)
    got = near_dedup.classes(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == expected
    kept = near_dedup.filter_documents(docs).collect()
    assert len(kept) == len(groups)
    assert sum(r.text is None or not plain(r.text) for r in kept) == 3


def test_bagminhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    a = {int(k): int(w) for k, w in zip(rng.integers(0, 2**62, 60), rng.integers(1, 9, 60))}
    b = {k: max(1, w + int(rng.integers(-3, 4))) for k, w in list(a.items())[10:]}
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
    flat = [np.repeat(list(x), list(x.values())) for x in (a, b)]
    got = near_dedup.signatures(np.concatenate(flat).astype(np.int64), np.array([len(x) for x in flat]), 4096)
    assert (got[0] == got[1]).mean() == pytest.approx(true, abs=0.035)


def test_chain_of_near_copies_is_one_class(spark):
    rng = random.Random(9)
    text, chain = prose(rng, 200).split(), []
    for k in range(12):
        text = list(text)
        text[10 * k + 5] = f"new{k}"
        chain.append((k, " ".join(text)))
    got = near_dedup.classes(spark.createDataFrame(chain, "doc_id bigint, text string")).collect()
    assert {r.class_id for r in got} == {0} and sum(r.kept for r in got) == 1


# --- classifiers


def test_language_id_on_held_out_documents(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    net = language_id.fit(table, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    got = language_id.predict(table, net).join(table.select("doc_id", "lang"), "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95
    odd = language_id.predict(docs.unionByName(docs.limit(1).withColumn("text", F.lit("123 !!"))), net).collect()
    assert len(odd) == len(rows()) + 1 and all(0 <= r.score <= 1 for r in odd)
    assert sum(r.lang_pred == "und" for r in odd) == 4


def test_predictions_match_a_network_run_byte_by_byte(spark):
    """Each gate written out for one byte at a time, in double precision."""
    net = language_id.Network.new(["de", "en", "fr"], units=4, seed=3)
    texts = ["Hello there", "x", "ÄÖ und Ähre", None, "", "12 34!", "long text, " * 30, "Ünï\ncode " * 11 + "é"]
    frame = spark.createDataFrame([(2**60 + k, t, "q", "r") for k, t in enumerate(texts)] + [(None, "twice", "q", "r")] * 2, "doc_id bigint, text string, low string, letters string")
    e1, u1, b1, e2, u2, b2, out, bias = (w.astype(np.float64) for w in net.weights)

    def layer(e, u, b, data):
        h, states, n = np.zeros(4), [], 4
        for byte in data:
            a, r = e[byte], h @ u
            gate = 1 / (1 + np.exp(-(a[: 2 * n] + r[: 2 * n])))
            new = np.tanh(a[2 * n :] + gate[n:] * (r[2 * n :] + b))
            h = gate[:n] * h + (1 - gate[:n]) * new
            states.append(h)
        return states

    def expected(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        data, sums = text.lower().encode(), np.zeros(3)
        for at in range(0, len(data), language_id.WIDTH):
            part = data[at : at + language_id.WIDTH]
            # The backward layer begins in the padding behind a short last window.
            whole = part + bytes(language_id.WIDTH - len(part))
            back = layer(e2, u2, b2, whole[::-1])[::-1]
            for f, b in zip(layer(e1, u1, b1, part), back):
                z = np.exp(np.concatenate([f, b]) @ out + bias)
                sums += z / z.sum()
        return net.langs[int(sums.argmax())], sums.max() / len(data)

    got = sorted(((r.doc_id or 0), r.lang_pred, r.score) for r in language_id.predict(frame, net).collect())
    want = sorted([(2**60 + k, *expected(t)) for k, t in enumerate(texts)] + [(0, *expected("twice"))] * 2)
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-4)


def test_network_gradients_match_differences():
    net = language_id.Network.new(["a", "b"], units=3)
    net.weights = [w.astype(np.float64) for w in net.weights]
    rng = np.random.default_rng(0)
    x, y, seen = rng.integers(1, 6, (5, 4)), np.array([0, 1, 1, 0]), np.ones((5, 4))
    seen[3:, 1] = 0
    _, grads = net.gradients(x, y, seen)
    for k, w in enumerate(net.weights):
        flat = [tuple(i) for i in np.argwhere(np.abs(grads[k]) > 1e-4)[:4]]
        for i in flat:
            keep, out = w[i], []
            for d in (1e-3, -1e-3):
                w[i] = keep + d
                out.append(net.gradients(x, y, seen)[0])
            w[i] = keep
            assert (out[0] - out[1]) / 2e-3 == pytest.approx(grads[k][i], rel=0.05, abs=2e-4)


def test_window_pooling_covers_every_byte():
    net = language_id.Network.new(["a", "b"], units=3)
    data = np.frombuffer(b"abcdefghij" * 30, dtype=np.uint8)
    one = net.documents(data, np.array([0, 5, 5, 300]))
    assert one.shape == (3, 2) and one[1].sum() == 0
    assert one[0].sum() == pytest.approx(1, abs=1e-5) and one[2].sum() == pytest.approx(1, abs=1e-5)


def test_quality_rules_ensemble(spark, docs):
    rng = np.random.default_rng(2)
    x = rng.random((600, len(quality_model.STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 5] < 0.4)).astype(float)
    model = quality_model.fit_rules(x, y)
    assert ((model.predict(x) >= 0.5) == y).mean() > 0.97 and 0 < len(model.rules) < 120
    scored = quality_model.score(docs, model).collect()
    assert len(scored) == len(rows()) and all(0 <= r.score <= 1 for r in scored)
    found = docs.select(quality_model.statistics(F.col("text")).alias("s")).collect()
    by_hand = sorted(model.predict(np.array([list(r.s) for r in found])))
    assert by_hand == pytest.approx(sorted(r.score for r in scored))


def plain_statistics(text: str | None) -> list[float]:
    """The statistics by their definitions, a character or word at a time."""
    import unicodedata

    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if words(x)]
    per = lambda a, b: a / b if b else 0.0
    share = lambda test: per(sum(map(test, text)), len(text))
    values = {
        "n_words": len(w), "mean_length": per(sum(map(len, w)), len(w)), "distinct": per(len(set(w)), len(w)), "repeated": per(sum(a == b for a, b in zip(w, w[1:])), len(w)),
        "symbols": share(lambda c: c in "#*$%&<>=+_@/\\^~"), "bars": share(lambda c: c == "|"), "bangs": share(lambda c: c == "!"), "upper": share(lambda c: unicodedata.category(c) == "Lu"),
        "digits": share(lambda c: c in "0123456789"), "points": share(lambda c: c in ".,;:?"), "dup_lines": per(len(lines) - len(set(lines)), len(lines)), "lines": per(text.count("\n") + 1, len(w)),
        "long_words": per(sum(len(x) > 12 for x in w), len(w)),
    }
    return [float(values[k]) for k in quality_model.STATISTICS]


def test_quality_scores_match_brute_force(spark, docs):
    """Statistics, rules and the logistic model computed without the operator's code, on odd and on real texts."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_model.fit(table, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    odd = spark.createDataFrame([(k, t) for k, t in enumerate(["A\nb\nA\n\n", "||| !!", "ÀÉ ß Straße!\t", "x " * 70 + "extraordinarily", "9" * 50, "\n\n"])], "doc_id bigint, text string")
    every = docs.select("doc_id", "text").unionByName(odd).unionByName(table.select("doc_id", "text"))

    def expected(text):
        x, logit = plain_statistics(text), model.bias
        for weight, conditions in model.rules:
            if all(x[k] > t if over else x[k] <= t for k, over, t in conditions):
                logit += weight
        return 1 / (1 + math.exp(-logit))

    assert model.rules
    got = quality_model.score(every, model).collect()
    assert sorted((r.doc_id or -1, r.score) for r in got) == [(k, pytest.approx(v, abs=1e-9)) for k, v in sorted((r.doc_id or -1, expected(r.text)) for r in every.collect())]


def test_quality_on_held_out_documents(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = quality_model.score(table, quality_model.fit(table, labels, ~held)).join(labels, "doc_id").where(held).collect()
    assert len(got) > 50 and sum((r.score >= 0.3) == (r.quality == 1) for r in got) / len(got) > 0.85


def test_toxicity_grammar_reads_clauses():
    g = toxicity.Grammar({"idiot": 0.95}, {"scum": 0.95})
    score = lambda text: g.clause(text.split())
    assert score("you are an idiot") > 0.9 > score("what an idiot") > 0.8
    assert score("you are not an idiot") < 0.3 and score("he said you are an idiot") < 0.3
    assert score("scumbags all of you") > 0.9 and score("a fine day") == 0
    assert score("i will kill you") > 0.6 and score("kill the lights") == 0


def brute_toxicity(g: toxicity.Grammar, text: str | None) -> float:
    """Each clause's best insult or threat, weighed by what stands around it; clauses as if independent."""
    clean = 1.0
    for clause in re.split(r"[.!?;:\n…]+", (text or "").lower()):
        w, best = re.findall(r"[^\W_]+(?:['’][^\W_]+)*", clause), 0.0
        for k, word in enumerate(w):
            if word in toxicity.CLOSED:
                continue
            before, after = set(w[:k]), set(w[k + 1 : k + 4])
            lowered = (0.2 if before & toxicity.NEGATION else 1.0) * (0.3 if before & toxicity.REPORTED else 1.0)
            weight = g.insult(word) * (1.0 if (before | after) & toxicity.TARGET else 0.9)
            if word in toxicity.THREAT and before & toxicity.INTENT and after & toxicity.TARGET:
                weight = max(weight, 0.7)
            best = max(best, weight * lowered)
        clean *= 1.0 - min(best, 0.999)
    return 1.0 - clean


def test_toxicity_scores_match_brute_force(spark, docs):
    rng = random.Random(11)
    g = toxicity.Grammar({"idiot": 0.95, "frobnik": 0.4}, {"scum": 0.9, "vermi": 0.97})
    pool = "idiot frobnik scumbag vermin you they not never said says will gonna kill hurt stab the a dog ran home his niemals sagte du tu . , ! ; \n".split(" ")
    texts = [" ".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 3, 9, 30, 200]))) for _ in range(300)]
    # One clause of over 10,000 characters: what lowers or aims an insult stands far from it.
    filler = "dog ran home " * 900
    texts += [f"he said not {filler} you idiot", f"{filler} idiot", f"you {filler} idiot {filler}", f"not an idiot {filler} idiot", f"will {filler} kill the you", None, "", "?!", texts[5]]
    frame = spark.createDataFrame([(None if k == 7 else 2**60 + k, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, score string").repartition(3)
    got = Counter((r.doc_id, round(r.score, 9)) for r in toxicity.score(frame, g).collect())
    assert got == Counter((None if k == 7 else 2**60 + k, round(brute_toxicity(g, t), 9)) for k, t in enumerate(texts))
    assert toxicity.score(frame, toxicity.Grammar()).where("doc_id is null").count() == 1


def test_transducers_compose_in_any_grouping():
    parts = [toxicity.picked(), toxicity.threats(), toxicity.targeted(), toxicity.lowered(toxicity.NEGATE, 0.2), toxicity.lowered(toxicity.SAY, 0.3)]

    def best(t: toxicity.Transducer, tags: list[str]) -> float:
        live = {t.start: 1.0}
        for tag in tags:
            now: dict = {}
            for state, so_far in live.items():
                for _, w, after in t.arcs.get((state, tag), []):
                    now[after] = max(now.get(after, 0.0), so_far * w)
            live = now
        return max((w for s, w in live.items() if s in t.ends), default=0.0)

    left = toxicity.compose(toxicity.compose(parts[0], parts[1]), toxicity.compose(parts[2], toxicity.compose(parts[3], parts[4])))
    right = toxicity.compose(parts[0], toxicity.compose(parts[1], toxicity.compose(toxicity.compose(parts[2], parts[3]), parts[4])))
    rng = random.Random(2)
    tags = [toxicity.OTHER, toxicity.NEGATE, toxicity.SAY, toxicity.AIM, toxicity.INTEND, toxicity.HARM, toxicity.INSULT]
    for _ in range(200):
        said = [rng.choice(tags) for _ in range(rng.randint(0, 8))]
        assert best(left, said) == pytest.approx(best(right, said))


def test_toxicity_on_held_out_documents(spark):
    """A few labels of the tables contradict their texts: toxic documents without any word that others lack."""
    table, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    grammar = toxicity.fit(table, labels, ~held)
    got = toxicity.score(table, grammar).join(labels.where("toxic is not null"), "doc_id").where(held).collect()
    bad = [r for r in got if r.toxic == 1]
    assert len(got) > 500 and sum((r.score >= 0.3) == (r.toxic == 1) for r in got) / len(got) > 0.96
    assert sum(r.score >= 0.3 for r in bad) >= 0.85 * len(bad)
    assert sum(r.score >= 0.3 for r in got if r.toxic == 0) <= 0.01 * len(got)


def test_toxicity_is_learned(spark, docs):
    table = [(k, f"plain words number w{k} here " + ("you utter frobnik" if k % 4 == 0 else "you dear friend"), 1 if k % 4 == 0 else 0) for k in range(120)]
    frame = spark.createDataFrame([(k, t) for k, t, _ in table], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in table] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    grammar = toxicity.fit(frame, labels, F.col("doc_id") % 3 != 0)
    got = {r.doc_id: r.score for r in toxicity.score(frame, grammar).collect()}
    assert all((got[k] >= 0.3) == bool(y) for k, _, y in table)
    odd = toxicity.score(docs, grammar).collect()
    assert len(odd) == len(rows()) and all(r.score == 0 for r in odd)


# --- sharding


def test_minimax_is_the_smallest_capacity():
    rng = random.Random(1)
    for _ in range(60):
        sizes, n = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))], rng.randint(1, 4)
        capacity, cuts = sharding.minimax(sizes, n)
        brute = min(c for c in range(max(sizes), sum(sizes) + 1) if len(sharding.greedy(sizes, c)) <= n)
        parts = [sum(sizes[a:b]) for a, b in zip(cuts, [*cuts[1:], len(sizes)])]
        assert capacity == brute == max(parts)
        assert sum(parts) == sum(sizes) and len(parts) <= n


def test_shards_keep_equal_texts_and_number_slots(docs):
    got = sharding.digest(docs, n=4).collect()
    assert len(got) == len(rows())
    crc, slots = defaultdict(set), defaultdict(list)
    for r in got:
        crc[r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in crc.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    expected = Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, *_ in rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == expected
    cells = Counter()
    for _, t, *_ in rows():
        cells[hashlib.md5((t or "").encode()).hexdigest()[:4]] += len((t or "").encode()) + 1
    by_shard = Counter()
    for r in got:
        by_shard[r.shard] += r["size"]
    capacity, _ = sharding.minimax([v for _, v in sorted(cells.items())], 4)
    assert max(by_shard.values()) == capacity
    names = ["_row", "_g", "_p", "_start", "_shard", "row", "group", "part", "id", "nth", "start", "g", "p", "bytes", "rows", "a.b"]
    odd = docs.withColumns({name: F.concat(F.lit(name), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for name in names})
    kept = sharding.assign(odd, n=4)
    assert kept.columns == [*(c for c in odd.columns if c not in ("size", "shard", "slot")), "size", "shard", "slot"]
    placed = kept.collect()
    assert all(r[name] == f"{name}{'-' if r.doc_id is None else r.doc_id}" for r in placed for name in names)
    assert Counter((r.doc_id, r["size"], r.shard, r.slot) for r in placed) == Counter((r.doc_id, r["size"], r.shard, r.slot) for r in got)


# --- decontamination


def test_containment_matches_brute_force(spark):
    rng = random.Random(5)
    items, table = [], []
    for k in range(30):
        items.append((k, prose(rng, rng.choice([3, 5, 7, 12, 13, 24, 40, 60, 250]))))
    for k in range(90):
        w = items[k % 30][1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = "edit"
        table.append((k, f"{prose(rng, rng.randint(0, 300))} {' '.join(w)}, {prose(rng, rng.randint(0, 300))}"))
    table += [(None, table[0][1]), (1, table[1][1]), (900, None), (901, ""), (902, items[5][1].upper())]
    grams = lambda t: {tuple(plain(t)[i : i + 5]) for i in range(len(plain(t)) - 4)}
    expected = set()
    for d, t in table:
        for i, x in items:
            g = grams(x)
            if g and len(g & grams(t)) / len(g) >= 0.8:
                expected.add((d, i, len(g & grams(t)), len(g)))
    frame = spark.createDataFrame(table, "doc_id bigint, text string").withColumns({c: F.lit(None).cast(t) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "bigint"))})
    bench = spark.createDataFrame([*items, items[0], (None, None), (77, "")], "item_id bigint, text string")
    got = decontaminate.containment(frame, bench).collect()
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got} == expected and len(got) == len(expected)
    bad = {(d, t) for d, t in table if any(e[0] == d for e in expected)}
    assert {(r.doc_id, r.text) for r in decontaminate.filter_documents(frame, bench).collect()} == set(table) - bad
    with pytest.raises(ValueError):
        decontaminate.containment(frame, bench, threshold=0.5)


def test_recall_on_scattered_sets(spark):
    """Documents that hold just over the threshold of an item's shingles in short runs, in any order, among other words."""
    rng = random.Random(21)
    items = [(k, prose(rng, n)) for k, n in enumerate([14, 20, 30, 44, 60, 100, 150, 204, 230, 300] * 6)]
    table = []
    for k, text in items:
        w, runs, i = text.split(), [], 0
        while i + 5 <= len(w):
            # Runs of words that overlap by four keep all shingles; a gap now and then loses four.
            n = rng.choice([6, 7, 9, 12, 16])
            runs.append(w[i : i + n])
            i += n - 4 if rng.random() < 0.97 else n - 3
        rng.shuffle(runs)
        table.append((k, " ".join(" ".join([*r, *prose(rng, 3).split()]) for r in runs)))
    grams = lambda t: {tuple(plain(t)[i : i + 5]) for i in range(len(plain(t)) - 4)}
    true = {k for (k, x), (_, t) in zip(items, table) if len(grams(x) & grams(t)) / len(grams(x)) >= 0.8}
    got = decontaminate.containment(spark.createDataFrame(table, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).where("doc_id = item_id").collect()
    assert len(true) >= 30 and {r.doc_id for r in got} <= true and len(got) >= 0.97 * len(true)


# --- quality rules


def test_quality_counts_match_brute_force(docs):
    got = Counter(tuple(r) for r in quality_rules.judge(docs).select(*quality_rules.RESULT[:7]).collect())
    expected = Counter()
    for k, t, *_ in rows():
        w, text = words(t), t or ""
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        places = {i + d for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        expected[k, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(places), len(w) < 50 or 100 * len(places) > 50 * len(w)] += 1
    assert got == expected


def test_divergent_documents_are_dropped(spark):
    rng = random.Random(8)
    good = [(k, prose(rng, 300).replace("w", "v"), "en", "a", 0) for k in range(40)]
    bad = [(100, " ".join(f"{w}***" for w in good[0][1].split()), "en", "a", 0), (101, good[1][1].upper(), "en", "a", 0)]
    kept = quality_rules.filter_documents(spark.createDataFrame(good + bad, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    assert {r.doc_id for r in kept.collect()} == set(range(40))


# --- token counts


def tokens(text: str | None) -> int:
    return len(token_counts.encoder(token_counts.FOLDER, token_counts.VERSION)(text)) if text else 0


def found(rollup: token_counts.Rollup) -> dict:
    return {(r.source, r.lang): [r.n_docs, r.n_tokens] for r in rollup.totals().collect()}


CHANGES = [("delete", "b", "en", "one two", None), ("revise", "b", "en", "one", "one two three"), ("insert", "new", None, None, "four")]
CHANGED = "op string, source string, lang string, old_text string, new_text string"


def test_rollup_takes_deltas_once(spark, docs, tmp_path):
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0 and not rollup.committed("one")
    assert rollup.commit("one", token_counts.inserts(docs)) and not rollup.commit("one", token_counts.inserts(docs))
    expected = defaultdict(lambda: [0, 0])
    for _, t, lang, source, _ in rows():
        expected[source, lang][0] += 1
        expected[source, lang][1] += tokens(t)
    assert found(rollup) == dict(expected)
    changes = spark.createDataFrame(CHANGES, CHANGED)
    assert rollup.commit("two", changes) and rollup.commit("none", changes.limit(0))
    expected["b", "en"][0] -= 1
    expected["b", "en"][1] += tokens("one two three") - tokens("one") - tokens("one two")
    expected["new", None] = [1, tokens("four")]
    assert found(rollup) == dict(expected)
    assert rollup.compact() and rollup.compact()
    assert found(rollup) == dict(expected) and not rollup.commit("two", changes) and len(rollup.manifest()[1]["folders"]) == 1
    assert rollup.clean(0) > 0 and found(rollup) == dict(expected) and rollup.clean(0) == 0
    assert sum(r.n_tokens for r in token_counts.token_counts(docs).collect()) == sum(tokens(t) for _, t, *_ in rows())
    with pytest.raises(Exception, match="unknown op"):
        token_counts.signed(changes.withColumn("op", F.lit("odd"))).collect()


@pytest.mark.parametrize("step", ["_write", "_publish"])
@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("work", ["commit", "compact"])
def test_rollup_survives_a_crash_between_any_two_steps(spark, tmp_path, monkeypatch, step, after, work):
    """Before or after what a commit or compaction does next, the driver dies: a later one finds right totals."""
    changes = spark.createDataFrame(CHANGES, CHANGED)
    path = str(tmp_path / "r")
    rollup = token_counts.Rollup(spark, path)
    rollup.commit("one", changes.where("op = 'insert'"))
    rollup.commit("two", changes)
    before = found(rollup)
    whole = getattr(rollup, step)

    def dies(*args):
        if after:
            whole(*args)
        raise KeyboardInterrupt

    monkeypatch.setattr(rollup, step, dies)
    with pytest.raises(KeyboardInterrupt):
        rollup.commit("three", changes.where("op = 'insert'")) if work == "commit" else rollup.compact()
    again = token_counts.Rollup(spark, path)
    done = step == "_publish" and after
    assert again.committed("three") == (done and work == "commit")
    assert again.commit("three", changes.where("op = 'insert'")) != (done and work == "commit")
    expected = {k: list(v) for k, v in before.items()}
    expected["new", None] = [expected["new", None][0] + 1, expected["new", None][1] + tokens("four")]
    assert found(again) == expected
    assert again.compact() and found(again) == expected and again.clean(0) > 0 and found(again) == expected


def test_rollup_with_two_writers(spark, tmp_path, monkeypatch):
    """Another commits between this writer's data and its manifest: one id counts once, two ids both count."""
    insert = spark.createDataFrame(CHANGES[2:], CHANGED)
    mine, other = token_counts.Rollup(spark, str(tmp_path / "r")), token_counts.Rollup(spark, str(tmp_path / "r"))
    publish, write, meanwhile = mine._publish, mine._write, []

    def late(*args):
        if meanwhile:
            other.commit(meanwhile.pop(), insert)
        return publish(*args)

    monkeypatch.setattr(mine, "_publish", late)
    meanwhile.append("b")
    assert mine.commit("a", insert) and found(mine) == {("new", None): [2, 2 * tokens("four")]}
    meanwhile.append("c")
    assert not mine.commit("c", insert) and found(mine) == {("new", None): [3, 3 * tokens("four")]}
    meanwhile.append("d")
    assert mine.compact() and found(mine) == {("new", None): [4, 4 * tokens("four")]}

    def folded(rows):
        own = write(rows)
        other.compact()
        return own

    monkeypatch.setattr(mine, "_write", folded)
    assert not mine.compact() and found(mine) == {("new", None): [4, 4 * tokens("four")]}


def test_op9_totals_match_sql_over_counts(spark):
    """The query's totals against DuckDB over counts of each text, tokenized here."""
    import duckdb
    import pandas as pd

    from narrata.llm import queries

    got = {tuple(r) for r in queries.op9_token_counts(spark, SF).select("source", "lang", "version", "n_docs", "n_tokens").collect()}
    table = duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet'").fetchall()
    counted = pd.DataFrame([(d, lang, s, tokens(t), tokens(t.upper() if t else None)) for d, t, lang, s, *_ in table], columns=["doc_id", "lang", "source", "n", "upper_n"])  # noqa: F841
    sql = """SELECT source, lang, 'byte_bpe_50k' AS version, count(*)::BIGINT, sum(CASE WHEN doc_id % 50 = 1 THEN upper_n ELSE n END)::BIGINT FROM counted WHERE doc_id % 50 <> 0 GROUP BY ALL"""
    none = lambda r: tuple(None if isinstance(x, float) else x for x in r)
    assert got == {none(r) for r in duckdb.sql(sql).fetchall()}


# --- licenses


def test_license_scan_matches_brute_force(docs):
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows())
    templates = [(label, set(plain(t))) for label, t in licenses.TEMPLATES]
    expected = Counter()
    for k, t, *_ in rows():
        w = plain(t)
        spots = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        shares = [(len(s & set(plain(line))) / len(s), label) for line in (t or "").lower().split("\n") for label, s in templates]
        more = {label for share, label in shares if share >= licenses.THRESHOLD - 1e-9}
        base = {label for _, label in spots}
        score = 1.0 if spots else max([s for s, label in shares if label in more and s >= licenses.THRESHOLD - 1e-9], default=0.0)
        at = [i for i, _ in spots]
        expected[k, len(w), len(spots), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score] += 1
    assert Counter(tuple(r) for r in got) == expected


def test_shingles_of_words_by_their_definition():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (0, 1, 4, 5, 0, 6, 30, 3)]
    found, lengths = near_dedup.shingled(np.concatenate(docs), np.array([len(d) for d in docs]))
    expected = []
    for d in docs:
        windows = [d] if 0 < len(d) < 5 else [d[i : i + 5] for i in range(len(d) - 4)]
        for window in windows:
            value = 0 if len(window) == 5 else len(window)
            for word in window.tolist():
                value = (value * int(near_dedup.MULTIPLIER) + word) % 2**64
            expected.append(value)
    assert lengths.tolist() == [0, 1, 1, 1, 0, 2, 26, 1]
    assert found.tolist() == near_dedup.mix64(np.array(expected, dtype=np.uint64)).view(np.int64).tolist()


def test_signatures_are_the_earliest_points_of_all_processes():
    """Every process run far past its end, one point at a time."""
    m, steps, mix = 8, 60, lambda x: int(near_dedup.mix64(np.array([x % 2**64], dtype=np.uint64))[0])
    bags = [[11, 11, 11, 11, 11, 12], [12], [], [13, 13, 14, 15]]
    got = near_dedup.signatures(np.array(sum(bags, []), dtype=np.int64), np.array([len(b) for b in bags]), m)
    for row, bag in zip(got.tolist(), bags, strict=True):
        best = {}
        for feature in set(bag):
            for level in range(int(np.ceil(np.log2(bag.count(feature)))) + 1):
                low, high = (0, 1) if level == 0 else (2 ** (level - 1), 2**level)
                time, seed = 0.0, mix(feature ^ mix(level))
                for turn in range(1, steps + 1):
                    r = mix(seed + turn * 0xD1342543DE82EF95 % 2**64)
                    time -= np.log(((r >> 11) + 0.5) / 2.0**53) / (m * (high - low))
                    s = mix(r)
                    if low + (high - low) * ((s >> 32) / 2.0**32) < bag.count(feature):
                        best[(s & 0xFFFFFFFF) % m] = min(best.get((s & 0xFFFFFFFF) % m, (np.inf, 0)), (time, r))
        assert row == [best[k][1] if bag else 0 for k in range(m)]
