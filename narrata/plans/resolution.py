"""Entity resolution, packing, stateful and streaming queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions import text as tx
from narrata.functions.phonetic import phonetic_code, phonetic_match
from narrata.operators import packing as pk
from narrata.operators import relational as rel
from narrata.operators import resolution as er
from narrata.operators import vectors as vec
from narrata.plans.functions import norm_sql, pairs
from narrata.plans.registry import query
from narrata.plans.relational import LIVE, NOW, TERMINAL, today, visible
from narrata.sources import objects
from narrata.sources.model import Model
from narrata.streaming import usage as us

c, lit = F.col, F.lit
#: Double Metaphone's primary codes of the tokens that the names of the tables have.
CODES = "harry HR, jonathan JN0N, mina MN, lucy LS, arthur AR0R, quincey KNS, john JN, abraham APRH, wilhelmina ALLM, renfield RNFL, vlad FLT, potter PTR, harker HRKR, murray MR, westenra ASTN, dracula TRKL"
CODED = f"(VALUES {', '.join(f'({x!r}, {y!r})' for x, y in (pair.split() for pair in CODES.split(', ')))}) AS t(token, code)"
TOKENS = f", tokens AS (SELECT id, document_id, kind, unnest(list_distinct(list_filter(string_split(n, ' '), lambda w: length(w) > 1))) AS token FROM (SELECT *, {norm_sql('name')} AS n FROM names))"
BLOCKS = f"""{TOKENS}, said AS (SELECT id, document_id, kind, '=' || token AS block FROM tokens UNION SELECT id, document_id, kind, '~' || code FROM tokens JOIN {CODED} USING (token) WHERE length(code) >= 2),
blocks AS (SELECT DISTINCT a.id AS a, b.id AS b FROM said a JOIN said b ON a.document_id = b.document_id AND a.kind = b.kind AND a.block = b.block AND a.id < b.id)"""


def blocks(m: Model) -> DataFrame:
    return er.met(m.names, m.names, scores=False, ordered=True)


@query("j22_blocking_join", f"{BLOCKS} SELECT a, b FROM blocks")
def _(m: Model) -> DataFrame:
    return blocks(m)


@query("j23_facet_linking", """, low AS (SELECT id, node_id, lower(content) AS content FROM facets), hits AS (SELECT m.id, f.id AS facet, row_number() OVER (PARTITION BY m.id ORDER BY length(f.content) DESC, f.id) AS r FROM mentions m JOIN low f ON f.node_id = m.node_id WHERE contains(concat(lower(m.source), 'o', CAST(m.start_at AS STRING), 'f', CAST(m.start_at AS STRING)), f.content))
SELECT m.id, h.facet FROM mentions m LEFT JOIN hits h ON h.id = m.id AND h.r = 1""")
def _(m: Model) -> DataFrame:
    said = F.concat(F.lower("source"), lit("o"), c("start_at").cast("string"), lit("f"), c("start_at").cast("string"))
    own = m.mentions.select("id", "node_id", said.alias("said"))
    names = m.facets.select("node_id", c("id").alias("facet"), F.lower("content").alias("content"))
    found = rel.latest(own.join(names, "node_id").where(F.contains("said", "content")), ["id"], [F.length("content").desc(), c("facet")]).select("id", "facet")
    return own.select("id").join(found, "id", "left")


@query("j26_character_context", f"""{LIVE}, who AS (SELECT id, document_id, name FROM nodes WHERE kind = 'character' AND NOT deleted),
parts AS (SELECT character_id AS id, 'state' AS part, document_order::BIGINT AS position, id AS ref, phase AS detail FROM states UNION ALL SELECT node_id, 'facet', NULL, id, kind || ': ' || content FROM facets
  UNION ALL SELECT node_id, 'mention', start_at, id, 'to ' || CAST(end_at AS STRING) FROM mentions UNION ALL SELECT src, 'edge', NULL, dst, edge_type FROM live)
SELECT w.id, w.document_id, w.name, part, position, ref, detail FROM who w LEFT JOIN parts p ON p.id = w.id""")
def _(m: Model) -> DataFrame:
    """Everything about each character, a row a part: states, facets, mentions and edges; one without parts keeps a row.

    Rows and not lists in one row: a character with a third of all mentions stays spread over tasks.
    """
    none = lit(None).cast("bigint")

    def part(frame: DataFrame, key: str, name: str, position: Column, ref: str, detail: Column) -> DataFrame:
        return frame.select(c(key).alias("id"), lit(name).alias("part"), position.cast("bigint").alias("position"), c(ref).cast("bigint").alias("ref"), detail.alias("detail"))

    parts = part(m.states, "character_id", "state", c("document_order"), "id", c("phase")).unionByName(part(m.facets, "node_id", "facet", none, "id", F.concat("kind", lit(": "), "content")))
    parts = parts.unionByName(part(m.mentions, "node_id", "mention", c("start_at"), "id", F.concat(lit("to "), c("end_at").cast("string")))).unionByName(part(visible(m), "src", "edge", none, "dst", c("edge_type")))
    return m.nodes.where("kind = 'character' and not deleted").select("id", "document_id", "name").join(parts, "id", "left")


@query("j27_character_arc", """SELECT s.character_id, s.id, s.document_order, s.phase, lead(s.id) OVER (PARTITION BY s.character_id ORDER BY s.document_order, s.id) AS next_state, coalesce(f.facets, '') AS facets
FROM states s LEFT JOIN (SELECT node_id, string_agg(DISTINCT content, ', ' ORDER BY content) AS facets FROM facets WHERE kind = 'state' GROUP BY node_id) f ON f.node_id = s.id""")
def _(m: Model) -> DataFrame:
    """A character's arc, a row a state: the state that follows, and the contents of its facets."""
    steps = m.states.withColumn("next_state", F.lead("id").over(Window.partitionBy("character_id").orderBy("document_order", "id")))
    facets = m.facets.where("kind = 'state'").groupBy(c("node_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("content")), ", ").alias("facets"))
    return rel.with_defaults(steps.select("character_id", "id", "document_order", "phase", "next_state"), facets, "id", {"facets": ""})


@query("f10_phonetic")
def _(m: Model) -> DataFrame:
    codes = m.names.select("name").distinct().select("name", phonetic_code(tx.normalise_name(c("name"))).alias("code"))
    both = pairs(m).join(codes.select(c("name").alias("a"), c("code").alias("code_a")), "a").join(codes.select(c("name").alias("b"), c("code").alias("code_b")), "b")
    return both.select("id", "code_a", "code_b", phonetic_match(c("code_a"), c("code_b")).alias("match"))


SIGNALS = f"""{BLOCKS}, n AS (SELECT id, name, kind, {norm_sql('name')} AS n, vec FROM names JOIN name_vectors USING (id)),
s0 AS (SELECT a, b, x.kind, x.n AS na, y.n AS nb, greatest(0, list_cosine_similarity(x.vec::DOUBLE[], y.vec::DOUBLE[])) AS emb FROM blocks JOIN n x ON x.id = a JOIN n y ON y.id = b),
s1 AS (SELECT *, CASE WHEN na = nb THEN 1.0::DOUBLE WHEN contains(na, nb) OR contains(nb, na) THEN 0.9 ELSE NULL END AS fast, list_distinct(list_filter(string_split(na, ' '), lambda w: length(w) > 1)) AS xa, list_distinct(list_filter(string_split(nb, ' '), lambda w: length(w) > 1)) AS xb FROM s0),
s2 AS (SELECT *, len(list_intersect(xa, xb)) / len(list_distinct(list_concat(xa, xb))) AS j FROM s1), titles AS (SELECT id, nullif(lower(regexp_extract(name, '(?i){tx.TITLE}', 1)), '') AS t FROM names),
s3 AS (SELECT s2.*, coalesce(fast, greatest(CASE WHEN ta.t = tb.t THEN 0.7 WHEN j > 0 THEN 0.5 + 0.3 * j ELSE 0 END, 0.8 * j, 0.7 * (1 - levenshtein(na, nb) / greatest(length(na), length(nb))))) AS name FROM s2 JOIN titles ta ON ta.id = a JOIN titles tb ON tb.id = b),
s4 AS (SELECT *, CASE kind WHEN 'character' THEN 0.5 * emb + 0.3 * name + 0.1 WHEN 'event' THEN 0.55 * emb + 0.2 * name + 0.1 WHEN 'concept' THEN 0.6 * emb + 0.15 * name + 0.1 ELSE 0.4 * emb + 0.4 * name + 0.1 END AS score, list_filter([emb, name, 1.0], lambda v: v > 0) AS vals FROM s3),
s5 AS (SELECT *, 1 - least((list_sum(list_transform(vals, lambda v: v * v)) / len(vals) - pow(list_avg(vals), 2)) / 0.25, 1) AS sure FROM s4)"""


def entities(m: Model) -> DataFrame:
    """Every name with a vector: names outnumber vectors, so these are taken in turn."""
    return m.names.join(m.name_vectors, "id").select("document_id", (c("id") % 3).alias("segment"), "id", "name", "kind", "vec")


def signals(m: Model) -> DataFrame:
    return er.met(entities(m), entities(m), ordered=True)


@query("e1_signals", f"{SIGNALS} SELECT a, b, round(emb, 9) AS emb, round(name, 9) AS name, 1.0::DOUBLE AS type FROM s5")
def _(m: Model) -> DataFrame:
    return signals(m).select("a", "b", F.round("emb", 9).alias("emb"), F.round("name", 9).alias("name"), "type")


@query("e2_weighted_score", f"{SIGNALS} SELECT a, b, round(score, 9) AS score FROM s5")
def _(m: Model) -> DataFrame:
    return signals(m).select("a", "b", F.round("score", 9).alias("score"))


@query("e3_confidence", f"{SIGNALS} SELECT a, b, round(sure, 6) AS sure FROM s5")
def _(m: Model) -> DataFrame:
    return signals(m).select("a", "b", F.round("sure", 6).alias("sure"))


DECIDED = SIGNALS + ", d AS (SELECT a, b, CASE WHEN score < 0.5 OR (score >= 0.7 AND name < 0.3) THEN 'CREATE' WHEN score >= 0.85 OR (sure > 0.7 AND score > 0.65) THEN 'MERGE' ELSE 'REVIEW' END AS decision, score, sure FROM s5)"


@query("e4_decision", f"{DECIDED} SELECT a, b, decision FROM d")
def _(m: Model) -> DataFrame:
    return signals(m).select("a", "b", er.decision(c("score"), c("sure"), c("name"), c("type")).alias("decision"))


@query("e5_refinement", f"{DECIDED} SELECT a, b, decision = 'REVIEW' AND score BETWEEN 0.5 AND 0.85 AND sure < 0.6 AS refine FROM d")
def _(m: Model) -> DataFrame:
    chosen = er.decision(c("score"), c("sure"), c("name"), c("type"))
    return signals(m).select("a", "b", er.needs_refinement(chosen, c("score"), c("sure")).alias("refine"))


@query("e6_segment_clusters")
def _(m: Model) -> DataFrame:
    return er.clusters(entities(m), ["document_id", "segment"])


@query("e7_cross_segment_merge")
def _(m: Model) -> DataFrame:
    """Merges of clusters; blocks are cut by the number of entities, as there are no more clusters than these."""
    own = entities(m)
    blocks = vec.blocks_of(own.select(F.struct("document_id", "kind").alias("_g")), "_g", er.MERGED)
    return er.merge_clusters(er.cluster_rows(own, ["document_id", "segment"]), blocks=blocks)


def parties(m: Model) -> tuple[DataFrame, DataFrame]:
    """The extracted and the existing entities of the resolvers: each document's names in turns."""
    return entities(m).where("id div 50 % 2 = 0"), entities(m).where("id div 50 % 2 = 1")


@query("e8_resolver")
def _(m: Model) -> DataFrame:
    """Each document's statistics after the whole resolver ran."""
    return er.resolution_statistics(er.resolve(*parties(m)))


@query("e9_registry_match")
def _(m: Model) -> DataFrame:
    """Candidates' matches, and existing entities that none was matched with, as soft-deleted."""
    new, known = (f.withColumn("aliases", F.array_except(tx.alias_variants(c("name")), F.array(F.lower("name")))) for f in parties(m))
    found = er.match_registry(new, known)
    gone = er.soft_deleted(known, found).select("document_id", "id", lit(None).cast("bigint").alias("match"), lit("soft-deleted").alias("how"))
    return found.unionByName(gone)


@query("e10_merge_action", "SELECT node_id, CASE WHEN r <= 1 THEN 'skip' WHEN r >= 3 AND s >= 3 THEN 'merge' ELSE 'ask' END AS action FROM (SELECT node_id, count(DISTINCT segment) AS s, max(CASE source WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END) AS r FROM mentions GROUP BY node_id)")
def _(m: Model) -> DataFrame:
    rank = F.when(c("source") == "A", 3).when(c("source") == "N", 2).otherwise(1)
    return m.mentions.groupBy("node_id").agg(F.countDistinct("segment").alias("s"), F.max(rank).alias("r")).select("node_id", er.merge_action(c("s"), c("r")).alias("action"))


@query("e11_registry_aliases", f""", known AS (SELECT id, name, [{norm_sql('name')}] AS aliases FROM names WHERE id % 2 = 1), fresh AS (SELECT id, 'New ' || name AS name, [lower(name)] AS aliases FROM names WHERE id % 3 = 0),
after AS (SELECT coalesce(f.id, k.id) AS id, coalesce(f.name, k.name) AS name, list_concat(coalesce(k.aliases, []::VARCHAR[]), coalesce(f.aliases, []::VARCHAR[])) AS aliases FROM known k FULL JOIN fresh f USING (id))
SELECT lower(alias) AS alias, max(id) AS owner FROM (SELECT id, unnest(list_append(aliases, name)) AS alias FROM after) GROUP BY 1""")
def _(m: Model) -> DataFrame:
    """The alias map after an upsert: odd ids are registered, multiples of three come in with a new name."""
    known = m.names.where("id % 2 = 1").select("id", "name", F.array(tx.normalise_name(c("name"))).alias("aliases"))
    fresh = m.names.where("id % 3 = 0").select("id", F.concat(lit("New "), "name").alias("name"), F.array(F.lower("name")).alias("aliases"))
    return er.alias_owners(er.upserted_registry(known, fresh))


# --- packing


def sized(m: Model) -> DataFrame:
    return m.texts.withColumn("document_id", c("id") % 10).select("document_id", "id", F.row_number().over(Window.partitionBy("document_id").orderBy("id")).alias("idx"), tx.token_estimate(c("body")).alias("tokens"))


@query("c1_batch_packing")
def _(m: Model) -> DataFrame:
    return pk.packed(sized(m), room=6000, output_room=3000)


@query("c2_registry_packing")
def _(m: Model) -> DataFrame:
    costs = F.array(F.length("name") + 40, F.length("name") + 10, F.length("name"))
    counts = m.mentions.groupBy(c("node_id").alias("id")).agg(F.count("*").alias("mentions"))
    return pk.registries(rel.with_defaults(m.nodes, counts, "id", {"mentions": 0}).withColumn("costs", costs), 600)


@query("c3_summary_priority", "SELECT id, round(0.4 * exp(-3.0 * (n - idx) / n) + 0.3 * CASE WHEN idx < n * 0.2 THEN 1 ELSE 0 END + 0.3 * CASE WHEN idx >= n * 0.4 AND idx <= n * 0.6 THEN 1 ELSE 0 END, 9) AS priority FROM (SELECT id, idx, count(*) OVER (PARTITION BY document_id) AS n FROM segments)")
def _(m: Model) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("document_id"))
    value = 0.4 * F.exp(-3.0 * (c("n") - c("idx")) / c("n")) + 0.3 * (c("idx") < c("n") * 0.2).cast("int") + 0.3 * c("idx").between(c("n") * 0.4, c("n") * 0.6).cast("int")
    return m.segments.withColumn("n", n).select("id", F.round(value, 9).alias("priority"))


@query("c4_calibration", """, h AS (SELECT model, id, input_tokens + 100.0::DOUBLE AS estimated, output_tokens::DOUBLE AS actual, id % 61 = 0 AS over, row_number() OVER (PARTITION BY model ORDER BY id) AS n FROM usage),
k AS (SELECT *, count(*) OVER w = 20 AND bool_and(NOT over AND actual < 0.8 * estimated) OVER w AS calm FROM h WINDOW w AS (PARTITION BY model ORDER BY id ROWS 19 PRECEDING)),
f AS (SELECT model, id, n, CASE WHEN over THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS m FROM k WHERE n = 1 UNION ALL
  SELECT k.model, k.id, k.n, CASE WHEN over THEN greatest(f.m * 1.5::DOUBLE, 2.0::DOUBLE) WHEN calm THEN greatest(f.m * 0.95::DOUBLE, 1.0::DOUBLE) ELSE f.m END FROM f JOIN k ON k.model = f.model AND k.n = f.n + 1)
SELECT model, id, round(m, 6) AS multiplier FROM f""")
def _(m: Model) -> DataFrame:
    history = m.usage.select("model", "id", (c("input_tokens") + 100.0).alias("estimated"), c("output_tokens").cast("double").alias("actual"), (c("id") % 61 == 0).alias("overflowed"))
    return pk.calibrated(history).withColumn("multiplier", F.round("multiplier", 6))


@query("c5_edit_chain", "SELECT id, CASE WHEN retries = 0 THEN 'skip' WHEN status = 'queued' OR retries >= 4 THEN 'regenerate' ELSE 'apply' END AS action FROM jobs")
def _(m: Model) -> DataFrame:
    return m.jobs.select("id", F.when(c("retries") == 0, "skip").when((c("status") == "queued") | (c("retries") >= 4), "regenerate").otherwise("apply").alias("action"))


# --- stateful and streaming

DAY_END = "TIMESTAMP '2024-01-02 00:00:00'"


@query("r1_capped_log", "SELECT id FROM (SELECT id, count(*) OVER (PARTITION BY type) AS n, row_number() OVER (PARTITION BY type ORDER BY id DESC) AS back FROM events_log) WHERE back <= CASE WHEN n <= 1000 THEN n ELSE 500 + (n - 1001) % 501 END")
def _(m: Model) -> DataFrame:
    return us.buffered(m.events_log).select("id")


@query("r2_replay", "SELECT id FROM events_log WHERE id > 100 AND channel IN (1, 2, 3) AND epoch(TIMESTAMP '2024-01-15 00:00:00') - epoch(date_trunc('second', ts)) < 864000")
def _(m: Model) -> DataFrame:
    subscribed = m.spark.createDataFrame([(k,) for k in (1, 2, 3)], "channel bigint")
    return us.replay(m.events_log, 100, subscribed, "2024-01-15 00:00:00", 864000).select("id")


@query("r3_daily_quota", "SELECT id, nth, nth > 3 AS rejected FROM (SELECT id, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, id) AS nth FROM usage)")
def _(m: Model) -> DataFrame:
    return us.daily_quota(m.usage, 3).select("id", c("nth").cast("bigint").alias("nth"), "rejected")


@query("r4_fixed_window", 'SELECT user_id, CAST(floor(epoch(date_trunc(\'second\', ts)) / 3600) AS BIGINT) AS "window", count(*) AS n, greatest(count(*) - 2, 0) AS rejected FROM usage GROUP BY 1, 2')
def _(m: Model) -> DataFrame:
    return us.fixed_window_limit(m.usage, 3600, 2)


@query("r5_incremental_rollup", "SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY event_type")
def _(m: Model) -> DataFrame:
    stream = us.event_stream(m.spark, m.folder, ["event_type", "user_id"])
    return us.incremental_rollup(stream, ["event_type"], {"users": "user_id"}, us.new_folder(m.spark, "rollup"))


@query("s16_consumer_groups", """, groups AS (SELECT DISTINCT g.grp, channel, CASE grp WHEN 'ui' THEN 400 ELSE 700 END AS last FROM events_log, (VALUES ('ui'), ('worker')) AS g(grp)),
e AS (SELECT g.grp, g.channel, l.id, l.id <= g.last AS sent, (g.grp = 'ui' AND l.id % 3 = 0) OR (g.grp = 'worker' AND l.id % 10 <> 7) AS done FROM groups g JOIN events_log l USING (channel))
SELECT grp, channel, count(*) AS produced, count(*) FILTER (sent) AS delivered, count(*) FILTER (sent AND NOT done) AS pending, min(id) FILTER (sent AND NOT done) AS oldest, count(*) FILTER (NOT sent) AS lag FROM e GROUP BY grp, channel""")
def _(m: Model) -> DataFrame:
    """Two consumer groups: what they were sent, what they have acknowledged, and how far they are behind."""
    names = m.spark.createDataFrame([("ui", 400), ("worker", 700)], "grp string, last bigint")
    groups = m.events_log.select("channel").distinct().join(F.broadcast(names), lit(True))
    acked = m.events_log.select("id", F.explode(F.array(lit("ui"), lit("worker"))).alias("grp")).where("(grp = 'ui' and id % 3 = 0) or (grp = 'worker' and id % 10 <> 7)")
    return us.consumer_state(m.events_log, groups, acked)


@query("s16_stream_windows", """SELECT CAST(epoch(date_trunc('hour', CAST(ts AS TIMESTAMP))) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2
HAVING CAST(epoch(date_trunc('hour', any_value(CAST(ts AS TIMESTAMP)))) AS BIGINT) + 3600 <= (SELECT epoch(max(CAST(ts AS TIMESTAMP))) FROM events) - 7200""")
def _(m: Model) -> DataFrame:
    """Hourly counts by type of a watermarked stream, as extension: windows the watermark has closed."""
    found = us.windowed_counts(us.event_stream(m.spark, m.folder, ["ts", "event_type"]), "1 hour", "2 hours", us.new_folder(m.spark, "windows"))
    return found.select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("r6_reservation_expiry", f"SELECT id, CASE WHEN status = 'completed' THEN 'final' WHEN made + 5 < {NOW} THEN 'released' ELSE 'held' END AS state FROM jobs")
def _(m: Model) -> DataFrame:
    return m.jobs.select("id", F.when(c("status") == "completed", "final").when(F.date_add("made", 5) < today(), "released").otherwise("held").alias("state"))


@query("r7_quota_deduction", "SELECT id, used <= 2000 AS accepted FROM (SELECT id, sum(input_tokens) OVER (PARTITION BY user_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS used FROM usage)")
def _(m: Model) -> DataFrame:
    quota = m.usage.select("user_id").distinct().withColumn("quota", lit(2000))
    return us.deduct(m.usage.select("user_id", "id", c("input_tokens").alias("cost")), quota).select("id", "accepted")


@query("r7_optimistic_deduction", """, o AS (SELECT user_id, id, input_tokens::DOUBLE AS cost, row_number() OVER (PARTITION BY user_id ORDER BY id) AS n FROM usage),
f AS (SELECT user_id, id, n, 'optimistic' AS mode, cost <= 2000 AS accepted, CASE WHEN cost <= 2000 THEN cost ELSE 0 END AS consumed FROM o WHERE n = 1 UNION ALL
  SELECT o.user_id, o.id, o.n, CASE WHEN f.consumed / 2000 >= 0.8 THEN 'strict' ELSE 'optimistic' END, f.consumed + o.cost <= 2000, CASE WHEN f.consumed + o.cost <= 2000 THEN f.consumed + o.cost ELSE f.consumed END FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT user_id, id, mode, accepted, consumed FROM f""")
def _(m: Model) -> DataFrame:
    quota = m.usage.select("user_id").distinct().withColumn("quota", lit(2000))
    return us.deduct_optimistic(m.usage.select("user_id", "id", c("input_tokens").alias("cost")), quota)


@query("r8_period_rollover", f"SELECT id, CASE WHEN made + 30 < {NOW} THEN 0 ELSE retries END AS consumed, CAST(CASE WHEN made + 30 < {NOW} THEN CAST({NOW} + INTERVAL '1' MONTH AS DATE) ELSE made + 30 END AS STRING) AS period_end FROM jobs")
def _(m: Model) -> DataFrame:
    over = F.date_add("made", 30) < today()
    return m.jobs.select("id", F.when(over, 0).otherwise(c("retries")).alias("consumed"), F.when(over, F.add_months(today(), 1)).otherwise(F.date_add("made", 30)).cast("string").alias("period_end"))


CLOCK = "1998-08-01 00:00:00"


def running(m: Model) -> DataFrame:
    return m.jobs.where("status = 'queued'").select("id", lit("processing").alias("status"), c("made").alias("started_at"), F.when(c("id") % 3 == 0, None).otherwise(F.date_add("made", 2)).alias("progress_at"), "retries", lit(3).alias("max_retries"))


@query("r9_stale_jobs", f"SELECT id, CASE WHEN stale AND retries < 3 THEN 'queued' WHEN stale THEN 'failed' ELSE 'processing' END AS status, CASE WHEN stale AND retries < 3 THEN retries + 1 ELSE retries END AS retries FROM (SELECT id, retries, made < {NOW} AND (id % 3 = 0 OR made + 2 < {NOW}) AS stale FROM jobs WHERE status = 'queued')")
def _(m: Model) -> DataFrame:
    return us.recover(running(m), CLOCK).select("id", "status", "retries")


@query("r10_stuck_generations", f"SELECT id, CASE WHEN made >= {NOW} - 22 THEN 'wait' WHEN retries >= 3 THEN 'fail' WHEN status = 'queued' THEN 'resubmit' ELSE 'poll' END AS action FROM jobs WHERE status <> 'completed'")
def _(m: Model) -> DataFrame:
    action = F.when(c("made") >= F.date_sub(today(), 22), "wait").when(c("retries") >= 3, "fail").when(c("status") == "queued", "resubmit").otherwise("poll")
    return m.jobs.where("status <> 'completed'").select("id", action.alias("action"))


@query("r11_two_store_status", "SELECT a.id, CASE WHEN j.status IN ('completed', 'failed') AND a.status <> j.status THEN j.status ELSE a.status END AS status FROM activities a LEFT JOIN jobs j ON j.id = a.job_id")
def _(m: Model) -> DataFrame:
    both = m.activities.join(m.jobs.select(c("id").alias("job_id"), c("status").alias("now")), "job_id", "left")
    return both.select("id", F.when(c("now").isin(TERMINAL) & (c("status") != c("now")), c("now")).otherwise(c("status")).alias("status"))


@query("r12_activity_sync", "SELECT a.id, CASE WHEN j.status IS NULL THEN 'failed' ELSE j.status END AS status FROM activities a LEFT JOIN (SELECT * FROM jobs WHERE id % 7 <> 0) j ON j.id = a.job_id WHERE a.status NOT IN ('completed', 'failed') AND (j.status IS NULL OR j.status IN ('completed', 'failed'))")
def _(m: Model) -> DataFrame:
    """Open activities that a seventh of the jobs, which are gone, and the ended ones leave behind."""
    return us.synced_activities(m.activities, m.jobs.where("id % 7 <> 0"), TERMINAL)


@query("r13_resume_by_stage", """, d AS (SELECT id, id % 3 AS version FROM jobs), k AS (SELECT id, CASE WHEN id % 11 = 0 THEN 1 WHEN id % 13 = 0 THEN 3 ELSE 2 END AS format, CASE WHEN id % 5 = 0 THEN id % 3 + 1 ELSE id % 3 END AS v, CASE WHEN id % 4 = 0 THEN NULL ELSE id % 10 END AS last FROM jobs WHERE id % 6 <> 0),
s AS (SELECT d.id, CASE WHEN v = version THEN coalesce(CASE format WHEN 2 THEN last WHEN 1 THEN last - CASE WHEN last >= 4 THEN 1 ELSE 0 END END, 0) ELSE 0 END AS done FROM d LEFT JOIN k USING (id))
SELECT id AS document_id, stage, stage > done AS run FROM s, range(1, 10) AS r(stage)""")
def _(m: Model) -> DataFrame:
    """Which of nine stages are to run for each of as many documents as there are jobs: checkpoints of both formats, of
    unknown ones, and of other versions of the document."""
    documents = m.jobs.select("id", (c("id") % 3).alias("version"))
    form = F.when(c("id") % 11 == 0, 1).when(c("id") % 13 == 0, 3).otherwise(2)
    kept = m.jobs.where("id % 6 <> 0").select(c("id").alias("document_id"), form.alias("format"), (c("id") % 3 + (c("id") % 5 == 0).cast("int")).alias("document_version"), F.when(c("id") % 4 != 0, c("id") % 10).alias("last_stage"))
    return us.resume(kept, documents, 9)


@query("r14_retention", f"SELECT id FROM activities WHERE status = 'completed' AND made < {NOW} - 30")
def _(m: Model) -> DataFrame:
    return m.activities.where((c("status") == "completed") & (c("made") < F.date_sub(today(), 30))).select("id")


@query("r15_version_dedupe", "SELECT id FROM (SELECT id, status, lag(status) OVER (PARTITION BY target_id ORDER BY id) AS before FROM jobs) WHERE before IS NULL OR before <> status")
def _(m: Model) -> DataFrame:
    before = F.lag("status").over(Window.partitionBy("target_id").orderBy("id"))
    return m.jobs.withColumn("before", before).where("before is null or before <> status").select("id")


FILES = """, files AS (SELECT id, 'text/html' AS mime, html AS body FROM web UNION ALL SELECT id + 1000000, 'text/markdown', concat('# ', url, chr(10), '**bold** [link](', url, ')') FROM web UNION ALL SELECT id + 2000000, 'text/plain', url FROM web
  UNION ALL SELECT id + 3000000, 'application/zip', url FROM web UNION ALL SELECT id + 4000000, 'text/plain', repeat('x', 10485761) FROM web WHERE id = 0 UNION ALL SELECT id + 5000000, NULL, url FROM web WHERE id = 0)"""


@query("s5_import", FILES + r""" SELECT id, mime, CASE WHEN length(body) > 10485760 THEN 'too large' WHEN mime IS NULL OR mime NOT IN ('text/html', 'text/markdown', 'text/plain') THEN 'unsupported mime type' END AS error,
  CASE WHEN length(body) <= 10485760 THEN CASE mime WHEN 'text/plain' THEN body WHEN 'text/markdown' THEN regexp_replace(regexp_replace(regexp_replace(body, '(?m)^#{1,6}\s+', '', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g')
  WHEN 'text/html' THEN trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' ', 'gi'), '&amp;', '&', 'gi'), '&lt;', '<', 'gi'), '&gt;', '>', 'gi'), '&quot;', '"', 'gi'), '&#39;', ''''), '\s+', ' ', 'g')) END END AS plain FROM files""")
def _(m: Model) -> DataFrame:
    """Files of each mime type, one that is too large, and types that are not known."""
    from narrata.sources.importers import imported

    def files(first: int, mime: str | None, body: Column, rows: str = "true") -> DataFrame:
        return m.web.where(rows).select((c("id") + first).alias("id"), lit(mime).cast("string").alias("mime"), body.alias("body"))

    marked = F.concat(lit("# "), "url", lit("\n**bold** [link]("), "url", lit(")"))
    every = files(0, "text/html", c("html")).unionByName(files(1_000_000, "text/markdown", marked)).unionByName(files(2_000_000, "text/plain", c("url"))).unionByName(files(3_000_000, "application/zip", c("url")))
    every = every.unionByName(files(4_000_000, "text/plain", F.repeat(lit("x"), lit(10_485_761)), "id = 0")).unionByName(files(5_000_000, None, c("url"), "id = 0"))
    return imported(every).select("id", "mime", "error", "plain")


@query("s9_export", r"SELECT CAST(sum(len(regexp_split_to_array(body, '\r\n|\r|\n'))) AS BIGINT) AS lines FROM texts WHERE body IS NOT NULL")
def _(m: Model) -> DataFrame:
    """Texts written as text files and read back: how many lines came through."""
    from narrata.sources.importers import export_text

    path = us.new_folder(m.spark, "export")
    export_text(m.texts.where("body is not null"), "body", path)
    return m.spark.read.text(path).agg(F.count("*").alias("lines"))


SECRET, BASE = b"an example secret", "https://objects.test"
INNER, OUTER = ("".join(f"\\x{x:02X}" for x in pad) for pad in objects.pads(SECRET))


@query("s15_signed_links", f"""SELECT id, concat('{BASE}/', key, '?method=GET&expires=', CAST(until AS STRING), '&signature=', sha256('{OUTER}'::BLOB || unhex(sha256('{INNER}'::BLOB || encode(concat('GET', chr(10), key, chr(10), CAST(until AS STRING))))))) AS link
FROM (SELECT id, concat('media/', hash, '.png') AS key, 1700000000 + id AS until FROM media WHERE NOT deleted)""")
def _(m: Model) -> DataFrame:
    """A signed link, with an expiry of its own, for every active medium."""
    key = F.concat(lit("media/"), "hash", lit(".png"))
    return m.media.where("not deleted").select("id", objects.link(BASE, SECRET, lit("GET"), key, c("id") + 1_700_000_000).alias("link"))


@query("s10_batch_append", "SELECT count(*) AS n FROM (SELECT id FROM mentions UNION ALL SELECT id FROM mentions WHERE is_key)")
def _(m: Model) -> DataFrame:
    return m.mentions.select("id").unionByName(m.mentions.where("is_key").select("id")).agg(F.count("*").alias("n"))


@query("v8_sentence_centroids", ", parts AS (SELECT document_id, i, avg(x) AS v FROM (SELECT document_id, unnest(vec)::DOUBLE AS x, unnest(range(64)) AS i FROM vectors) GROUP BY ALL) SELECT document_id, round(sqrt(sum(v * v)), 9) AS norm FROM parts GROUP BY document_id")
def _(m: Model) -> DataFrame:
    return vec.centroid(m.vectors, ["document_id"], "vec", unit=False).select("document_id", F.round(vec.norm(c("centroid")), 9).alias("norm"))


@query("g24_explain", f"{LIVE} SELECT count(*) > 0 AS planned FROM live")
def _(m: Model) -> DataFrame:
    """The plan as text, as explain() prints it: it names a scan of each table."""
    plan = visible(m)._jdf.queryExecution().toString()
    return m.spark.createDataFrame([("FileScan parquet" in plan or "Scan parquet" in plan,)], "planned boolean")
