"""Aggregates, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.operators import relational as rel
from narrata.operators import vectors as vec
from narrata.plans.registry import query
from narrata.plans.relational import NOW, both_ways, money, today
from narrata.sources.model import Model

c, lit = F.col, F.lit


def n_rows(name: str = "n") -> Column:
    return F.count("*").alias(name)


# --- aggregates


@query("a1_count_filtered", "SELECT count(*) AS n FROM mentions WHERE document_id = 3 AND is_key")
def _(m: Model) -> DataFrame:
    return m.mentions.where("document_id = 3 and is_key").agg(n_rows())


@query("a2_group_count", "SELECT facet_id, count(*) AS n FROM mentions WHERE facet_id IS NOT NULL GROUP BY facet_id")
def _(m: Model) -> DataFrame:
    return m.mentions.where("facet_id is not null").groupBy("facet_id").agg(n_rows())


@query("a2_group_count_nodes", "SELECT node_id, count(*) AS n FROM mentions GROUP BY node_id")
def _(m: Model) -> DataFrame:
    return m.mentions.groupBy("node_id").agg(n_rows())


@query("a3_two_key_pivot", """SELECT status, count(*) AS n, count(*) FILTER (status = 'queued' AND type = '1-URGENT') AS urgent, count(*) FILTER (status = 'queued' AND type = '5-LOW') AS low FROM jobs GROUP BY status""")
def _(m: Model) -> DataFrame:
    queued = lambda kind: F.count_if((c("status") == "queued") & (c("type") == kind))
    return m.jobs.groupBy("status").agg(n_rows(), queued("1-URGENT").alias("urgent"), queued("5-LOW").alias("low"))


@query("a4_conditional_counts", "SELECT user_id, count(*) AS n, count(CASE WHEN status = 'failed' THEN 1 END) AS failed, count(CASE WHEN status = 'queued' THEN 1 END) AS queued FROM jobs GROUP BY user_id")
def _(m: Model) -> DataFrame:
    return m.jobs.groupBy("user_id").agg(n_rows(), F.count_if(c("status") == "failed").alias("failed"), F.count_if(c("status") == "queued").alias("queued"))


@query("a5_top_users", "SELECT user_id, CAST(sum(cost) AS DOUBLE) AS cost, CAST(sum(input_tokens) AS BIGINT) AS tokens FROM usage GROUP BY user_id ORDER BY sum(cost) DESC, user_id LIMIT 10")
@query("k3_top_by_aggregate", "SELECT user_id, CAST(sum(cost) AS DOUBLE) AS cost, CAST(sum(input_tokens) AS BIGINT) AS tokens FROM usage GROUP BY user_id ORDER BY sum(cost) DESC, user_id LIMIT 10")
def _(m: Model) -> DataFrame:
    return m.usage.groupBy("user_id").agg(F.sum("cost").alias("_cost"), F.sum("input_tokens").alias("tokens")).orderBy(c("_cost").desc(), "user_id").limit(10).select("user_id", c("_cost").cast("double").alias("cost"), "tokens")


LAST = ", top AS (SELECT max(day) AS last FROM usage)"


@query("a6_month_to_date", f"{LAST} SELECT user_id, CAST(sum(cost) AS DOUBLE) AS cost FROM usage, top WHERE day >= date_trunc('month', last) GROUP BY user_id")
def _(m: Model) -> DataFrame:
    start = m.usage.agg(F.trunc(F.max("day"), "month").alias("start"))
    return m.usage.join(F.broadcast(start), c("day") >= c("start")).groupBy("user_id").agg(money("cost", "cost"))


@query("a7_range_totals", "SELECT CAST(sum(cost) AS DOUBLE) AS cost, count(*) AS operations, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM usage")
def _(m: Model) -> DataFrame:
    return m.usage.agg(money("cost", "cost"), n_rows("operations"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


@query("a7_by_date", "SELECT CAST(day AS STRING) AS day, CAST(sum(cost) AS DOUBLE) AS cost, count(*) AS operations FROM usage GROUP BY usage.day")
def _(m: Model) -> DataFrame:
    return m.usage.groupBy("day").agg(money("cost", "cost"), n_rows("operations")).withColumn("day", c("day").cast("string"))


@query("a8_daily_rollup", """, f AS (SELECT user_id, day, operation, model, cost, input_tokens FROM usage UNION ALL SELECT NULL, day, operation, model, cost, input_tokens FROM usage)
SELECT t.user_id, CAST(t.day AS STRING) AS day, operations, cost, tokens, ops, models FROM (SELECT user_id, day, count(*) AS operations, CAST(sum(cost) AS DOUBLE) AS cost, CAST(sum(input_tokens) AS BIGINT) AS tokens FROM f GROUP BY user_id, day) t
JOIN (SELECT user_id, day, string_agg(concat(operation, '=', CAST(n AS STRING)), ',' ORDER BY operation) AS ops FROM (SELECT user_id, day, operation, count(*) AS n FROM f GROUP BY ALL) GROUP BY user_id, day) o ON o.user_id IS NOT DISTINCT FROM t.user_id AND o.day = t.day
JOIN (SELECT user_id, day, string_agg(concat(model, '=', CAST(n AS STRING)), ',' ORDER BY model) AS models FROM (SELECT user_id, day, model, count(*) AS n FROM f GROUP BY ALL) GROUP BY user_id, day) p ON p.user_id IS NOT DISTINCT FROM t.user_id AND p.day = t.day""")
def _(m: Model) -> DataFrame:
    rolled = rel.rollup(m.usage, {"cost": F.sum("cost"), "tokens": F.sum("input_tokens")}, ["operation", "model"])
    flat = lambda x: F.array_join(F.transform(F.map_entries(x), lambda e: F.concat(e["key"], lit("="), e["value"].cast("string"))), ",")
    return rolled.select("user_id", c("day").cast("string").alias("day"), "operations", c("cost").cast("double").alias("cost"), "tokens", flat(c("operation_breakdown")).alias("ops"), flat(c("model_breakdown")).alias("models"))


@query("a9_provider_rollup", "SELECT user_id, sum(n)::BIGINT AS n, string_agg(concat(model, '=', CAST(n AS STRING)), ',' ORDER BY model) AS models FROM (SELECT user_id, model, count(*) AS n FROM usage GROUP BY user_id, model) GROUP BY user_id")
def _(m: Model) -> DataFrame:
    counts = m.usage.groupBy("user_id", "model").agg(n_rows())
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("model", "n"))), lambda e: F.concat(e["model"], lit("="), e["n"].cast("string"))), ",")
    return counts.groupBy("user_id").agg(F.sum("n").alias("n"), joined.alias("models"))


@query("a10_open_reservations", f"SELECT coalesce(CAST(sum(cost) AS DOUBLE), 0) AS held, count(*) AS n FROM jobs WHERE status = 'queued' AND made > {NOW} + 1000")
def _(m: Model) -> DataFrame:
    return m.jobs.where((c("status") == "queued") & (c("made") > F.date_add(today(), 1000))).agg(F.coalesce(F.sum("cost").cast("double"), lit(0.0)).alias("held"), n_rows())


RISK = "greatest(coalesce(n, 0) / 500.0, coalesce(active, 0) / 3.0, coalesce(inflight, 0) / 200000.0)"


@query("a11_quota_risk", f"SELECT u.id, CAST({RISK} AS DOUBLE) AS risk, {RISK} >= 0.9 AS strict FROM users u LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (status = 'queued') AS active, CAST(sum(CASE WHEN status = 'queued' THEN cost ELSE 0 END) AS DOUBLE) AS inflight FROM jobs GROUP BY user_id) j ON j.user_id = u.id")
def _(m: Model) -> DataFrame:
    queued = c("status") == "queued"
    stats = m.jobs.groupBy(c("user_id").alias("id")).agg(n_rows(), F.count_if(queued).alias("active"), F.sum(F.when(queued, c("cost")).otherwise(0)).cast("double").alias("inflight"))
    risk = F.greatest(c("n") / 500.0, c("active") / 3.0, c("inflight") / 200000.0)
    return rel.with_defaults(m.users.select("id"), stats, "id", {"n": 0, "active": 0, "inflight": 0.0}).select("id", risk.alias("risk"), (risk >= 0.9).alias("strict"))


@query("a12_usage_percent", "SELECT user_id, CAST(CASE WHEN user_id % 10 = 0 THEN 0 ELSE round(100.0 * count(*) / (user_id % 10 * 40)) END AS BIGINT) AS percent FROM usage GROUP BY user_id")
def _(m: Model) -> DataFrame:
    quota = c("user_id") % 10 * 40
    return m.usage.groupBy("user_id").agg(n_rows()).select("user_id", F.when(quota == 0, lit(0)).otherwise(F.round(100.0 * c("n") / quota)).cast("bigint").alias("percent"))


@query("a13_min_position", "SELECT node_id, min(start_at) AS first FROM mentions GROUP BY node_id")
def _(m: Model) -> DataFrame:
    return m.mentions.groupBy("node_id").agg(F.min("start_at").alias("first"))


@query("a14_document_length", "SELECT document_id, max(end_at) AS length FROM segments GROUP BY document_id")
def _(m: Model) -> DataFrame:
    return m.segments.groupBy("document_id").agg(F.max("end_at").alias("length"))


@query("a15_latest", "SELECT document_id, CAST(max(made) AS STRING) AS latest FROM mentions GROUP BY document_id")
def _(m: Model) -> DataFrame:
    return m.mentions.groupBy("document_id").agg(F.max("made").cast("string").alias("latest"))


@query("a16_keep_max", "SELECT node_id, document_id, arg_max(id, confidence * 10000000 - id) AS id, max(confidence) AS confidence FROM mentions GROUP BY node_id, document_id")
def _(m: Model) -> DataFrame:
    return m.mentions.groupBy("node_id", "document_id").agg(F.max_by("id", F.struct("confidence", -c("id"))).alias("id"), F.max("confidence").alias("confidence"))


@query("a17_collect_list", "SELECT node_id, list_sort(list(id)) AS ids FROM mentions GROUP BY node_id")
def _(m: Model) -> DataFrame:
    return m.mentions.groupBy("node_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))


@query("a18_distinct_nodes", "SELECT DISTINCT node_id FROM mentions")
def _(m: Model) -> DataFrame:
    return m.mentions.select("node_id").distinct()


@query("a19_distinct_in_group", "SELECT node_id, count(DISTINCT segment) AS segments, max(CASE source WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END) AS rank FROM mentions GROUP BY node_id")
def _(m: Model) -> DataFrame:
    rank = F.when(c("source") == "A", 3).when(c("source") == "N", 2).otherwise(1)
    return m.mentions.groupBy("node_id").agg(F.countDistinct("segment").alias("segments"), F.max(rank).alias("rank"))


@query("a20_group_to_map", "SELECT node_id, kind, list_sort(list(content)) AS contents FROM facets GROUP BY node_id, kind")
def _(m: Model) -> DataFrame:
    return m.facets.groupBy("node_id", "kind").agg(F.sort_array(F.collect_list("content")).alias("contents"))


CENTRE = ", parts AS (SELECT kind, i, {} AS v FROM (SELECT kind, id, unnest(vec)::DOUBLE AS x, unnest(range(64)) AS i FROM vectors) GROUP BY kind, i), norms AS (SELECT kind, sqrt(sum(v * v)) AS n FROM parts GROUP BY kind)"


@query("a21_centroid", f"{CENTRE.format('avg(x)')} SELECT kind, i AS dimension, round(v / n, 6) AS v FROM parts JOIN norms USING (kind)")
def _(m: Model) -> DataFrame:
    return vec.centroid(m.vectors, ["kind"], "vec").select("kind", F.posexplode("centroid").alias("dimension", "v")).select("kind", c("dimension").cast("bigint").alias("dimension"), F.round("v", 6).alias("v"))


@query("a22_weighted_centroid", f"{CENTRE.format('sum(x * (1 + id % 3)) / sum(1 + id % 3)')} SELECT kind, i AS dimension, round(v / n, 6) AS v FROM parts JOIN norms USING (kind)")
def _(m: Model) -> DataFrame:
    return vec.centroid(m.vectors, ["kind"], "vec", weight=1 + c("id") % 3).select("kind", F.posexplode("centroid").alias("dimension", "v")).select("kind", c("dimension").cast("bigint").alias("dimension"), F.round("v", 6).alias("v"))


@query("a23_batch_statistics", "SELECT (SELECT count(*) FROM nodes) AS entities, (SELECT count(*) FROM facets) AS facets, (SELECT count(*) FROM mentions) AS mentions, (SELECT count(*) FROM facets) / (SELECT count(*) FROM nodes) AS facets_each")
def _(m: Model) -> DataFrame:
    counts = [f.agg(F.count("*").alias(k)) for k, f in (("entities", m.nodes), ("facets", m.facets), ("mentions", m.mentions))]
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2])).withColumn("facets_each", c("facets") / c("entities"))


@query("a24_facet_merge", "SELECT node_id, kind, content, min(id) AS id FROM facets GROUP BY node_id, kind, content")
def _(m: Model) -> DataFrame:
    return rel.latest(m.facets.select("node_id", "kind", "content", "id"), ["node_id", "kind", "content"], [c("id")])


@query("a25_block_statistics", "SELECT count(DISTINCT t) AS tokens, count(DISTINCT kind) AS kinds, count(*) / count(DISTINCT t) AS each FROM (SELECT kind, unnest(string_split(name, ' ')) AS t FROM nodes)")
def _(m: Model) -> DataFrame:
    return m.nodes.select("kind", F.explode(F.split("name", " ")).alias("t")).agg(F.countDistinct("t").alias("tokens"), F.countDistinct("kind").alias("kinds"), F.count("*").alias("rows")).select("tokens", "kinds", (c("rows") / c("tokens")).alias("each"))


RECENT = ", r AS (SELECT operation, value, row_number() OVER (PARTITION BY operation ORDER BY id DESC) - 1 AS age FROM (SELECT id, operation, output_tokens / (input_tokens + 1) AS value FROM usage))"


@query("a26_recency_average", f"{RECENT} SELECT operation, round(sum(value * pow(0.7, age)) / sum(pow(0.7, age)), 9) AS ratio FROM r WHERE age < 20 GROUP BY operation")
def _(m: Model) -> DataFrame:
    ratio = m.usage.select("operation", "id", (c("output_tokens") / (c("input_tokens") + 1)).alias("value"))
    # The filter is on the row number itself: Spark then keeps 20 rows an operation in each task before the shuffle.
    aged = ratio.withColumn("nth", F.row_number().over(Window.partitionBy("operation").orderBy(c("id").desc()))).where("nth <= 20").withColumn("age", c("nth") - 1)
    weight = F.pow(lit(0.7), c("age"))
    return aged.groupBy("operation").agg(F.round(F.sum(c("value") * weight) / F.sum(weight), 9).alias("ratio"))


@query("a27_queue_depth", f"SELECT type, count(*) AS depth, CAST({NOW} - min(made) AS BIGINT) AS oldest FROM jobs WHERE status = 'queued' GROUP BY type")
def _(m: Model) -> DataFrame:
    return m.jobs.where("status = 'queued'").groupBy("type").agg(n_rows("depth"), F.datediff(today(), F.min("made")).cast("bigint").alias("oldest"))


@query("a28_deleted_counts", "SELECT 'media' AS what, count(*) AS n FROM media WHERE deleted UNION ALL SELECT 'links', count(*) FROM document_media WHERE deleted UNION ALL SELECT 'nodes', count(*) FROM nodes WHERE deleted")
def _(m: Model) -> DataFrame:
    parts = [f.where("deleted").agg(n_rows()).select(lit(k).alias("what"), "n") for k, f in (("media", m.media), ("links", m.document_media), ("nodes", m.nodes))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a29_info_card", "SELECT document_id, count(*) AS media, CASE WHEN document_id % 2 = 0 THEN (SELECT count(*) FROM nodes n WHERE n.document_id = d.document_id) END AS entities FROM document_media d WHERE NOT deleted GROUP BY document_id")
def _(m: Model) -> DataFrame:
    media, entities = m.document_media.where("not deleted").groupBy("document_id").agg(n_rows("media")), m.nodes.groupBy("document_id").agg(n_rows("entities"))
    return rel.with_defaults(media, entities, "document_id", {"entities": 0}).withColumn("entities", F.when(c("document_id") % 2 == 0, c("entities")))


@query("a30_month_summary", f"{LAST} SELECT user_id, count(*) AS operations, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens FROM usage, top WHERE day >= date_trunc('month', last) GROUP BY user_id")
def _(m: Model) -> DataFrame:
    start = m.usage.agg(F.trunc(F.max("day"), "month").alias("start"))
    return m.usage.join(F.broadcast(start), c("day") >= c("start")).groupBy("user_id").agg(n_rows("operations"), F.sum(c("input_tokens") + c("output_tokens")).alias("tokens"))


@query("a31_range_text", "SELECT node_id, CASE WHEN min(segment) = max(segment) THEN CAST(min(segment) AS STRING) ELSE concat(CAST(min(segment) AS STRING), '-', CAST(max(segment) AS STRING)) END AS span FROM mentions GROUP BY node_id")
def _(m: Model) -> DataFrame:
    low, high = F.min("segment"), F.max("segment")
    return m.mentions.groupBy("node_id").agg(F.coalesce(F.when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low, high)), lit("unknown")).alias("span"))


@query("a32_facet_positions", "SELECT facet_id, min(start_at) AS first, max(start_at) AS last, count(*) AS n FROM mentions WHERE facet_id IS NOT NULL GROUP BY facet_id")
def _(m: Model) -> DataFrame:
    return m.mentions.where("facet_id is not null").groupBy("facet_id").agg(F.min("start_at").alias("first"), F.max("start_at").alias("last"), n_rows())


# --- windows


def by_character() -> Window:
    return Window.partitionBy("character_id").orderBy("document_order")


@query("w1_validity_window", "SELECT id, document_order AS valid_from, lead(document_order) OVER (PARTITION BY character_id ORDER BY document_order) AS valid_to FROM states")
def _(m: Model) -> DataFrame:
    return m.states.select("id", c("document_order").alias("valid_from"), F.lead("document_order").over(by_character()).alias("valid_to"))


@query("w2_transitions", "SELECT a, b, gap FROM (SELECT id AS a, lead(id) OVER w AS b, lead(reason) OVER w IS NULL AND row_number() OVER w > 1 AS gap FROM states WINDOW w AS (PARTITION BY character_id ORDER BY document_order)) WHERE b IS NOT NULL")
def _(m: Model) -> DataFrame:
    w = by_character()
    return m.states.select(c("id").alias("a"), F.lead("id").over(w).alias("b"), (F.lead("reason").over(w).isNull() & (F.row_number().over(w) > 1)).alias("gap")).where("b is not null")


@query("w3_row_position", "SELECT id, row_number() OVER (PARTITION BY document_id ORDER BY id) - 1 AS position FROM nodes")
def _(m: Model) -> DataFrame:
    return m.nodes.select("id", (F.row_number().over(Window.partitionBy("document_id").orderBy("id")) - 1).cast("bigint").alias("position"))


@query("w4_neighbour_frame", "SELECT id, list(id) OVER (PARTITION BY document_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM segments")
def _(m: Model) -> DataFrame:
    return m.segments.select("id", F.collect_list("id").over(Window.partitionBy("document_id").orderBy("idx").rowsBetween(-2, 2)).alias("near"))


@query("w5_previous_text", "SELECT id, right(lag(body) OVER (PARTITION BY document_id ORDER BY idx), 10) AS overlap FROM segments")
def _(m: Model) -> DataFrame:
    return m.segments.select("id", F.right(F.lag("body").over(Window.partitionBy("document_id").orderBy("idx")), lit(10)).alias("overlap"))


@query("w6_rolling_check", "SELECT id, bool_and(output_tokens < 290) OVER (PARTITION BY operation ORDER BY id ROWS 19 PRECEDING) AND count(*) OVER (PARTITION BY operation ORDER BY id ROWS 19 PRECEDING) = 20 AS calm FROM usage")
def _(m: Model) -> DataFrame:
    w = Window.partitionBy("operation").orderBy("id").rowsBetween(-19, 0)
    return m.usage.select("id", (F.bool_and(c("output_tokens") < 290).over(w) & (F.count("*").over(w) == 20)).alias("calm"))


@query("w7_token_budget", "SELECT id, CAST(running AS BIGINT) AS running FROM (SELECT id, sum(size) OVER (PARTITION BY document_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS running FROM (SELECT p_partkey AS id, p_partkey % 50 AS document_id, p_size AS size FROM part)) WHERE running <= 200")
def _(m: Model) -> DataFrame:
    return rel.budget_prefix(m.media.select("id", (c("id") % 50).alias("document_id"), "size"), ["document_id"], [c("id")], "size", 200).select("id", "running")


@query("w8_unused_colour", """, palette AS (SELECT i, concat('colour', CAST(i AS STRING)) AS colour FROM (SELECT unnest(range(12)) AS i)), used AS (SELECT DISTINCT document_id, concat('colour', CAST(document_order % 12 AS STRING)) AS colour FROM nodes WHERE document_order < 30)
SELECT d.document_id, coalesce(min(p.i), 0) AS colour FROM (SELECT DISTINCT document_id FROM nodes) d LEFT JOIN (SELECT d.document_id, p.i FROM (SELECT DISTINCT document_id FROM nodes) d, palette p WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.document_id = d.document_id AND u.colour = p.colour)) p USING (document_id) GROUP BY d.document_id""")
def _(m: Model) -> DataFrame:
    used = F.collect_set(F.when(c("document_order") < 30, c("document_order") % 12))
    free = F.array_except(F.sequence(lit(0), lit(11)), used)
    return m.nodes.groupBy("document_id").agg(F.coalesce(F.array_min(free), lit(0)).cast("bigint").alias("colour"))


# --- order, limits, top-k


@query("k1_page", "SELECT id, (SELECT count(*) FROM jobs) AS total, 40 < (SELECT count(*) FROM jobs) AS has_more FROM jobs ORDER BY made DESC, id LIMIT 20 OFFSET 20")
def _(m: Model) -> DataFrame:
    return rel.page(m.jobs, [c("made").desc(), c("id")], 20, 20).select("id", "total", "has_more")


@query("k2_capped_limit", "SELECT id FROM jobs ORDER BY id LIMIT 100")
def _(m: Model) -> DataFrame:
    return m.jobs.orderBy("id").limit(min(500, 100)).select("id")


@query("k4_active_and_last_ten", "SELECT id, status FROM activities WHERE status IN ('running', 'pending') UNION ALL (SELECT id, status FROM activities WHERE status NOT IN ('running', 'pending') ORDER BY made DESC, id LIMIT 10)")
def _(m: Model) -> DataFrame:
    active = c("status").isin("running", "pending")
    return m.activities.where(active).select("id", "status").unionByName(m.activities.where(~active).orderBy(c("made").desc(), "id").limit(10).select("id", "status"))


@query("k5_next_job", "SELECT id, type FROM jobs WHERE status <> 'completed' ORDER BY CASE WHEN status = 'failed' THEN 0 ELSE 1 END, made, id LIMIT 1")
def _(m: Model) -> DataFrame:
    return m.jobs.where("status <> 'completed'").orderBy(F.when(c("status") == "failed", 0).otherwise(1), "made", "id").limit(1).select("id", "type")


@query("k6_multi_key_order", "SELECT node_id, n, row_number() OVER (ORDER BY n DESC, node_id % 3 = 0 DESC, CAST(node_id AS STRING)) AS place FROM (SELECT node_id, count(*) AS n FROM mentions GROUP BY node_id) ORDER BY place LIMIT 25")
def _(m: Model) -> DataFrame:
    order = [c("n").desc(), (c("node_id") % 3 == 0).desc(), c("node_id").cast("string")]
    top = m.mentions.groupBy("node_id").agg(n_rows()).orderBy(*order).limit(25)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


@query("k7_top_with_cut", "SELECT id, confidence FROM mentions WHERE confidence >= 50 ORDER BY confidence DESC, id LIMIT 30")
def _(m: Model) -> DataFrame:
    return m.mentions.where("confidence >= 50").orderBy(c("confidence").desc(), "id").limit(30).select("id", "confidence")


@query("k8_priority_then_order", "SELECT document_id, id, idx FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY length(body) DESC, id) AS r FROM segments) WHERE r <= 3")
def _(m: Model) -> DataFrame:
    ranked = m.segments.withColumn("r", F.row_number().over(Window.partitionBy("document_id").orderBy(F.length("body").desc(), "id")))
    return ranked.where("r <= 3").select("document_id", "id", "idx").orderBy("document_id", "idx")


@query("k9_latest_versions", "SELECT id FROM jobs WHERE target_id = 17 ORDER BY id DESC LIMIT 50")
def _(m: Model) -> DataFrame:
    return m.jobs.where("target_id = 17").orderBy(c("id").desc()).limit(50).select("id")


@query("k10_ordered_members", "SELECT node_id, list(id ORDER BY kind, made, id) AS ordered FROM facets GROUP BY node_id")
def _(m: Model) -> DataFrame:
    return m.facets.groupBy("node_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("kind", "made", "id"))), lambda x: x["id"]).alias("ordered"))


@query("k11_oldest_fifty", "SELECT id FROM jobs WHERE user_id % 10 = 1 ORDER BY made, id LIMIT 50")
def _(m: Model) -> DataFrame:
    return m.jobs.where("user_id % 10 = 1").orderBy("made", "id").limit(50).select("id")


@query("k12_pending_newest", "SELECT id, type FROM jobs WHERE status = 'queued' ORDER BY made DESC, id LIMIT 40")
def _(m: Model) -> DataFrame:
    return m.jobs.where("status = 'queued'").orderBy(c("made").desc(), "id").limit(40).select("id", "type")


@query("k13_first_three", "SELECT node_id, id, r FROM (SELECT node_id, id, row_number() OVER (PARTITION BY node_id ORDER BY start_at, id) AS r FROM mentions) WHERE r <= 3")
def _(m: Model) -> DataFrame:
    return m.mentions.withColumn("r", F.row_number().over(Window.partitionBy("node_id").orderBy("start_at", "id")).cast("bigint")).where("r <= 3").select("node_id", "id", "r")


# --- sets


@query("x1_concatenate", "SELECT id, kind FROM facets WHERE kind = 'trait' UNION ALL SELECT id, 'state' FROM states")
def _(m: Model) -> DataFrame:
    return m.facets.where("kind = 'trait'").select("id", "kind").unionByName(m.states.select("id", lit("state").alias("kind")))


@query("x2_set_difference", "SELECT id FROM old_segments EXCEPT SELECT id FROM new_segments")
def _(m: Model) -> DataFrame:
    return m.old_segments.select("id").join(m.new_segments.select("id"), "id", "left_anti").distinct()


@query("x3_change_classes", "SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'modified' END AS change FROM old_segments o FULL JOIN new_segments n ON n.id = o.id")
@query("t8_segment_changes", "SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'modified' END AS change FROM old_segments o FULL JOIN new_segments n ON n.id = o.id")
def _(m: Model) -> DataFrame:
    return rel.changed(m.old_segments, m.new_segments)


@query("x4_union_distinct", "SELECT id FROM nodes WHERE kind = 'event' UNION SELECT id FROM nodes WHERE document_order < 10")
def _(m: Model) -> DataFrame:
    return m.nodes.where("kind = 'event'").select("id").union(m.nodes.where("document_order < 10").select("id")).distinct()


@query("x5_undirected_pairs", ", live AS (SELECT * FROM edges WHERE NOT deleted AND src IN (SELECT id FROM nodes WHERE NOT deleted) AND dst IN (SELECT id FROM nodes WHERE NOT deleted)) SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM live WHERE edge_type NOT IN ('HAS_FACET', 'BELONGS_TO_THREAD') GROUP BY ALL")
def _(m: Model) -> DataFrame:
    return both_ways(m).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


@query("x6_exclusion", "SELECT DISTINCT node_id FROM mentions WHERE node_id NOT IN (SELECT node_id FROM mentions WHERE is_key)")
def _(m: Model) -> DataFrame:
    return m.mentions.select("node_id").distinct().join(m.mentions.where("is_key").select("node_id"), "node_id", "left_anti")
