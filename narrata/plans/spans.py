"""Queries on text spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions import spans as sp
from narrata.operators import relational as rel
from narrata.operators import spans as so
from narrata.plans.registry import query
from narrata.sources.model import Model

c, lit = F.col, F.lit


@query("t1_sentences")
def _(m: Model) -> DataFrame:
    return so.sentences(m.texts)


@query("t2_boundaries", r"""SELECT id, pos AS position, 'line' AS kind FROM (SELECT id, CAST(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING) - length(line) - 1 AS INT) AS pos, line FROM (SELECT id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS k FROM texts)) WHERE regexp_matches(trim(line), '^(?:\*{3,}|-{3,}|#{1,3}\s+.+)$|^(?:INT\.|EXT\.|FADE\s+(?:IN|OUT|TO))')""")
def _(m: Model) -> DataFrame:
    marks = so.boundaries(m.texts, lambda found, _: [x for x in found if x[1] == "scene_marker"])
    return marks.select("id", "position", lit("line").alias("kind"))


@query("t3_spaced_boundaries")
def _(m: Model) -> DataFrame:
    return so.boundaries(m.texts, lambda found, _: sp.spaced(found))


@query("t4_size_splits")
def _(m: Model) -> DataFrame:
    return so.boundaries(m.texts, lambda found, text: sp.split_large(sp.spaced(found), text))


@query("t5_segment_id_reuse")
def _(m: Model) -> DataFrame:
    """Ids that segments keep after the first 300 characters of a text are gone."""

    def work(text: str) -> list[tuple]:
        cut = text[300:]
        old = [(f"old{k}", a, b, text[a:b]) for k, (a, b) in enumerate(sp.segments(text))]
        return [(k, x) for k, x in enumerate(sp.reuse_ids(old, [(a, b, cut[a:b]) for a, b in sp.segments(cut)], len(cut)))]

    return so.spread(m.texts.where("body is not null"), ["id", "body"], work, "id bigint, idx int, segment string")


@query("t6_segmentation")
def _(m: Model) -> DataFrame:
    return so.segments(m.texts)


@query("t7_segment_validation", "SELECT id, CASE WHEN start_at < 0 THEN 'bounds' WHEN start_at >= end_at THEN 'empty' WHEN before > start_at THEN 'overlap' WHEN before < start_at THEN 'gap' ELSE 'ok' END AS verdict FROM (SELECT *, lag(end_at) OVER (PARTITION BY document_id ORDER BY idx) AS before FROM segments WHERE id % 9 <> 0)")
def _(m: Model) -> DataFrame:
    before = F.lag("end_at").over(Window.partitionBy("document_id").orderBy("idx"))
    seen = m.segments.where("id % 9 <> 0").withColumn("before", before)
    verdict = F.when(c("start_at") < 0, "bounds").when(c("start_at") >= c("end_at"), "empty").when(c("before") > c("start_at"), "overlap").when(c("before") < c("start_at"), "gap").otherwise("ok")
    return seen.select("id", verdict.alias("verdict"))


@query("t9_name_occurrences", r"SELECT id, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(body, '(?i)\bthe\b')) FROM (SELECT id, regexp_replace(body, '[^\x00-\x7F]', 'x', 'g') AS body FROM texts)) GROUP BY id")
def _(m: Model) -> DataFrame:
    plain = m.texts.select("id", F.regexp_replace("body", r"[^\x00-\x7F]", "x").alias("body"), lit("the").alias("name"))
    return so.occurrences(plain, "name").groupBy("id").agg(F.count("*").alias("n"))


@query("t10_mentions_from_names")
def _(m: Model) -> DataFrame:
    """Mentions of each text's first word, with its second as alias, and the facets they belong to: every even text has
    one for its first word, every text divisible by three one for its second."""
    w = F.split(F.trim(F.regexp_replace("body", r"\s+", " ")), " ")
    named = m.texts.where("body is not null").select("id", "body", F.get(w, lit(0)).alias("name"), F.filter(F.slice(w, 2, 1), lambda x: x != "").alias("aliases"))
    first = named.where("id % 2 = 0").select(c("id").alias("node_id"), (c("id") * 10).alias("id"), c("name").alias("content"))
    second = named.where("id % 3 = 0").select(c("id").alias("node_id"), (c("id") * 10 + 1).alias("id"), F.upper(F.get("aliases", lit(0))).alias("content"))
    return so.linked_mentions(named, first.unionByName(second), "name", "aliases")


def moved(m: Model) -> DataFrame:
    """Mentions of 40 characters in texts to whose head 25 characters were added; a third were written a little otherwise."""
    source = F.substring("body", 201, 40)
    return m.texts.where("n_chars > 400").select(
        "id", F.concat(lit("Some words were put here. "), "body").alias("body"), F.when(c("id") % 3 == 0, F.concat(F.substring(source, 1, 37), lit("xyz"))).otherwise(source).alias("source"), F.sha2(F.substring("body", 201, 40), 256).alias("digest"),
        lit(200).alias("start_at"), lit(240).alias("end_at"), lit(0).alias("seg_start"), F.when(c("id") % 2 == 0, lit(400)).otherwise(lit(100)).alias("seg_end"),
    )


@query("t11_fuzzy_relocation")
def _(m: Model) -> DataFrame:
    return so.fuzzy(moved(m))


@query("t12_segment_first")
def _(m: Model) -> DataFrame:
    return so.segment_first(moved(m))


@query("t13_mention_resolution")
def _(m: Model) -> DataFrame:
    return so.relocated(moved(m))


@query("t14_passage_location")
def _(m: Model) -> DataFrame:
    found = so.relocated(moved(m))
    return found.where(F.abs(c("end") - c("start") - 40) <= 40 * sp.tolerance(40)).select("id", "start", "end")


@query("t15_event_range")
def _(m: Model) -> DataFrame:
    work = lambda text: [r] if (r := sp.event_range(text, text[50:90], text[300:340])) else []
    return so.spread(m.texts.where("n_chars > 400"), ["id", "body"], work, "id bigint, start int, end int")


@query("t16_staleness")
def _(m: Model) -> DataFrame:
    """Sentences whose hash the snapshot lacks: it was taken of every text's first 1000 characters."""
    now = so.sentences(m.texts)
    snapshot = so.sentences(m.texts.select("id", F.substring("body", 1, 1000).alias("body"))).select("id", "hash").distinct()
    return now.join(snapshot, ["id", "hash"], "left_anti").select("id", "idx", "hash")


@query("t17_diff_round_trip")
def _(m: Model) -> DataFrame:
    def work(text: str) -> list[tuple]:
        new = text.replace(". ", ".\n") + "\nThe end."
        patch = sp.diff(text, new)
        return [(sp.apply_diff(text, patch) == new, sp.apply_diff(new, sp.invert_diff(patch)) == text, sp.significant(patch))]

    return so.spread(m.texts.where("body is not null"), ["id", "body"], work, "id bigint, forth boolean, back boolean, significant boolean")


@query("t18_reconstruction")
def _(m: Model) -> DataFrame:
    def work(text: str) -> list[tuple]:
        versions = [text, text + "\none", "zero\n" + text + "\none", text[: len(text) // 2]]
        patches = [sp.diff(a, b) for a, b in zip(versions, versions[1:], strict=False)]
        return [(k, sp.rebuild(versions[-1], patches[k:][::-1]) == versions[k]) for k in range(len(versions))]

    return so.spread(m.texts.where("body is not null"), ["id", "body"], work, "id bigint, version int, equal boolean")


@query("f22_nearest_stop")
def _(m: Model) -> DataFrame:
    return so.spread(m.texts.where("body is not null"), ["id", "body"], lambda t: [(sp.nearest_stop(t, len(t) // 2),)], "id bigint, stop int")


@query("c6_overflow_split")
def _(m: Model) -> DataFrame:
    """Batches of three texts each, of which 9,000 characters fit."""
    return so.split_overflow(m.texts.select(F.floor(c("id") / 3).alias("batch"), "id", "body"), 9000)
