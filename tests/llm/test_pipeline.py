"""The pipeline's stages: each held against its own operator's result on what the stage before kept."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from narrata.llm import decontaminate, mixing, near_dedup, quality_rules, sharding
from narrata.llm.common import DOCUMENT, table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    docs, kept = table(spark, SF, "documents"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert set(DOCUMENT) <= set(after.columns)
        kept.append((docs, after))
        docs = after
    ids = lambda f: Counter(r.doc_id for r in f.select("doc_id").collect())
    before, after = kept[0]
    assert ids(after) == ids(quality_rules.judge(before).where("kept"))
    assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in before.collect()}
    before, after = kept[1]
    assert ids(after) == ids(near_dedup.classes(before).where("kept"))
    before, after = kept[2]
    leaks = {r.doc_id for r in decontaminate.containment(before, table(spark, SF, "benchmark")).collect()}
    assert set(ids(after)) == set(ids(before)) - leaks
    before, after = kept[3]
    words = lambda f: Counter({r.doc_id: 0 for r in f.collect()}) + Counter(r.doc_id for r in f.collect() for _ in (r.text or "").split())
    taken = Counter({r.doc_id: r.taken for r in mixing.Mix(before).taken().collect() if r.taken})
    assert words(after) == taken
    before, after = kept[4]
    assert Counter((r.doc_id, r.text) for r in after.collect()) == Counter((r.doc_id, r.text) for r in before.collect())
    placed = lambda f: Counter((r.doc_id, r["size"], r.shard) for r in f.collect())
    assert placed(after) == placed(sharding.assign(before))
    slots = {}
    for r in after.select("shard", "slot").collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())


def test_empty_documents_give_an_empty_result(spark, tmp_path):
    for name in ("documents", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_gives_shards(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.select("shard", "slot").collect()
    assert rows and len(set(rows)) == len(rows) and {r.shard for r in rows} <= set(range(16))
