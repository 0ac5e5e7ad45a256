"""Scans, predicates, joins, aggregates, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions import text as tx
from narrata.operators import graph as gr
from narrata.operators import relational as rel
from narrata.plans.registry import query
from narrata.sources.model import Model

c, lit = F.col, F.lit
#: A fixed "now" for predicates on age: results must not depend on the day of the run.
NOW = "DATE '1998-08-01'"


def today() -> Column:
    return F.lit("1998-08-01").cast("date")


TERMINAL = ["completed", "failed"]
PUBLIC = "CAUSES ENABLES PREVENTS HAPPENS_BEFORE PARTICIPATES_IN LOCATED_AT PART_OF MEMBER_OF POSSESSES CONNECTED_TO OPPOSES ABOUT RELATED_TO".split()


def money(column: str | Column, name: str) -> Column:
    """An exact decimal sum, given as a double."""
    return F.sum(column).cast("double").alias(name)


# --- scans and sinks


@query("s1_scan_projection", "SELECT id, user_id, name FROM media WHERE NOT deleted")
def _(m: Model) -> DataFrame:
    return m.media.where(~c("deleted")).select("id", "user_id", "name")


@query("s2_label_scan", "SELECT id, name FROM nodes WHERE kind = 'event' AND user_id = 3")
def _(m: Model) -> DataFrame:
    return m.nodes.where((c("kind") == "event") & (c("user_id") == 3)).select("id", "name")


@query("s3_point_lookup", "SELECT id, name, kind, user_id FROM nodes WHERE id = 42 AND user_id = 0 AND NOT deleted")
def _(m: Model) -> DataFrame:
    return m.nodes.where((c("id") == 42) & (c("user_id") == 0) & ~c("deleted")).select("id", "name", "kind", "user_id")


@query("s4_parameterised_sql", "SELECT kind, count(*) AS n FROM nodes WHERE document_id = 7 GROUP BY kind")
def _(m: Model) -> DataFrame:
    return m.spark.sql("SELECT kind, count(*) AS n FROM {nodes} WHERE document_id = :doc GROUP BY kind", args={"doc": 7}, nodes=m.nodes)


@query("s6_html_to_text", r"""SELECT id, trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' ', 'gi'), '&amp;', '&', 'gi'), '&lt;', '<', 'gi'),
  '&gt;', '>', 'gi'), '&quot;', '"', 'gi'), '&#39;', ''''), '\s+', ' ', 'g')) AS body FROM web""")
def _(m: Model) -> DataFrame:
    return m.web.select("id", tx.html_text(c("html")).alias("body"))


@query("s7_markdown_to_text", r"""SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(concat('## ', body, chr(10), '# ', url, ' **bold** *it* `code` [link](http://x)'),
  '(?m)^#{1,6}\s+', '', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '`([^`]+)`', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g') AS plain
  FROM (SELECT id, url, html AS body FROM web)""")
def _(m: Model) -> DataFrame:
    marked = F.concat(lit("## "), "html", lit("\n# "), "url", lit(" **bold** *it* `code` [link](http://x)"))
    return m.web.select("id", tx.markdown_text(marked).alias("plain"))


@query("s8_clean_html", r"""SELECT id, regexp_replace(regexp_replace(regexp_replace(concat(html, '<span data-type="mention" data-label="Mina">x</span><p style="color: var(--a)">'),
  '<script[^>]*>.*?</script>', '', 'gis'), '<[^>]+data-type="mention"[^>]*data-label="([^"]*)"[^>]*>.*?</[^>]+>', '@\1', 'g'), 'style="[^"]*var\([^"]*"', '', 'g') AS clean FROM web""")
def _(m: Model) -> DataFrame:
    return m.web.select("id", tx.clean_html(F.concat("html", lit('<span data-type="mention" data-label="Mina">x</span><p style="color: var(--a)">'))).alias("clean"))


@query("s11_upsert", """SELECT id, hash FROM old_segments WHERE id NOT IN (SELECT id FROM new_segments) UNION ALL SELECT id, hash FROM new_segments""")
def _(m: Model) -> DataFrame:
    return rel.upsert(m.old_segments, m.new_segments, ["id"])


@query("s12_idempotent_create", "SELECT id, hash FROM new_segments WHERE id NOT IN (SELECT id FROM old_segments)")
def _(m: Model) -> DataFrame:
    return rel.insert_missing(m.old_segments, m.new_segments, ["id"])


@query("s13_content_dedupe", "SELECT user_id, sha256(hash) AS hash, min(id) AS id FROM media WHERE NOT deleted GROUP BY user_id, hash")
def _(m: Model) -> DataFrame:
    own = m.media.where(~c("deleted")).select("user_id", tx.text_hash(c("hash")).alias("hash"), "id")
    return rel.latest(own, ["user_id", "hash"], [c("id")])


@query("s14_one_active_job", """, active AS (SELECT DISTINCT type, target_id FROM jobs WHERE status = 'queued' AND id % 2 = 0)
SELECT type, target_id, min(id) AS id FROM jobs j WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM active a WHERE a.type = j.type AND a.target_id = j.target_id) GROUP BY type, target_id""")
def _(m: Model) -> DataFrame:
    active, wanted = m.jobs.where("status = 'queued' and id % 2 = 0"), m.jobs.where("id % 2 = 1").select("type", "target_id", "id")
    return rel.latest(rel.insert_missing(active, wanted, ["type", "target_id"]), ["type", "target_id"], [c("id")])


@query("s17_graph_counts", "SELECT 'node' AS what, kind AS label, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY edge_type")
def _(m: Model) -> DataFrame:
    return m.nodes.groupBy(lit("node").alias("what"), c("kind").alias("label")).agg(F.count("*").alias("n")).unionByName(m.edges.groupBy(lit("edge").alias("what"), c("edge_type").alias("label")).agg(F.count("*").alias("n")))


@query("s18_cascade_delete", """, gone AS (SELECT id FROM users WHERE role = 'admin') SELECT 'jobs' AS what, count(*) AS n FROM jobs WHERE user_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'activities', count(*) FROM activities WHERE user_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'users', count(*) FROM users WHERE id NOT IN (SELECT id FROM gone)""")
def _(m: Model) -> DataFrame:
    gone = m.users.where("role = 'admin'")
    parts = [("jobs", rel.cascade(m.jobs, gone, "user_id")), ("activities", rel.cascade(m.activities, gone, "user_id")), ("users", rel.cascade(m.users, gone, "id"))]
    counts = [f.groupBy(lit(k).alias("what")).agg(F.count("*").alias("n")) for k, f in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# --- projections and predicates


@query("p1_conjunctive_filter", "SELECT id, status FROM jobs WHERE status = 'failed' AND type = '1-URGENT'")
def _(m: Model) -> DataFrame:
    return m.jobs.where(rel.conjunction(c("status") == "failed", None, c("type") == "1-URGENT")).select("id", "status")


@query("p2_substring_two_columns", "SELECT id, username FROM users WHERE username ILIKE '%00001%' OR email ILIKE '%00001%'")
def _(m: Model) -> DataFrame:
    return m.users.where(c("username").ilike("%00001%") | c("email").ilike("%00001%")).select("id", "username")


@query("p3_in_and_not_in", "SELECT id FROM activities WHERE status IN ('running', 'pending') AND (document_id IS NULL OR document_id NOT IN (1, 2, 3))")
def _(m: Model) -> DataFrame:
    return m.activities.where(c("status").isin("running", "pending") & rel.not_in(c("document_id"), [1, 2, 3])).select("id")


@query("p4_soft_delete_rows", "SELECT count(*) AS n FROM media WHERE NOT deleted")
def _(m: Model) -> DataFrame:
    return m.media.where(~c("deleted")).agg(F.count("*").alias("n"))


def visible(m: Model) -> DataFrame:
    """Edges that are active with both ends active."""
    ends = m.nodes.where(~c("deleted")).select("id")
    return m.edges.where(~c("deleted")).join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")


LIVE = ", live AS (SELECT * FROM edges WHERE NOT deleted AND src IN (SELECT id FROM nodes WHERE NOT deleted) AND dst IN (SELECT id FROM nodes WHERE NOT deleted))"


@query("p5_soft_delete_edges", f"{LIVE} SELECT src, dst, edge_type FROM live")
def _(m: Model) -> DataFrame:
    return visible(m).select("src", "dst", "edge_type")


@query("p6_trash_listing", "SELECT id, name FROM media WHERE deleted ORDER BY id DESC LIMIT 20")
def _(m: Model) -> DataFrame:
    return m.media.where("deleted").orderBy(c("id").desc()).select("id", "name").limit(20)


@query("p7_array_containment", "SELECT id, len(string_split(name, ' ')) AS n FROM nodes WHERE list_contains(string_split(name, ' '), 'red')")
def _(m: Model) -> DataFrame:
    return m.nodes.withColumn("w", F.split("name", " ")).where(F.array_contains("w", "red")).select("id", F.size("w").cast("bigint").alias("n"))


RANGES = "SELECT a.document_id, count(*) AS n FROM mentions a JOIN segments b ON a.document_id = b.document_id AND {} GROUP BY a.document_id"


@query("p8_overlap_half_open", RANGES.format("a.start_at < b.end_at AND a.end_at > b.start_at"))
def _(m: Model) -> DataFrame:
    return rel.overlap_join(m.mentions.select("document_id", "start_at", "end_at"), m.segments.select("document_id", "start_at", "end_at"), "document_id").groupBy("document_id").agg(F.count("*").alias("n"))


@query("p9_overlap_closed", RANGES.format("NOT (a.end_at < b.start_at OR a.start_at > b.end_at)"))
def _(m: Model) -> DataFrame:
    return rel.overlap_join(m.mentions.select("document_id", "start_at", "end_at"), m.segments.select("document_id", "start_at", "end_at"), "document_id", closed=True).groupBy("document_id").agg(F.count("*").alias("n"))


@query("p10_time_predicates", f"SELECT id, made < {NOW} - 365 AS old, made >= {NOW} - 30 AS recent FROM jobs WHERE status <> 'completed'")
def _(m: Model) -> DataFrame:
    return m.jobs.where("status <> 'completed'").select("id", (c("made") < F.date_sub(today(), 365)).alias("old"), (c("made") >= F.date_sub(today(), 30)).alias("recent"))


@query("p11_edge_allow_list", "SELECT edge_type, count(*) AS n FROM edges WHERE edge_type IN ('CAUSES','ENABLES','PREVENTS','HAPPENS_BEFORE','PARTICIPATES_IN','LOCATED_AT') GROUP BY edge_type")
def _(m: Model) -> DataFrame:
    return m.edges.where(c("edge_type").isin(PUBLIC)).groupBy("edge_type").agg(F.count("*").alias("n"))


@query("p12_allow_list", """, asked AS (SELECT DISTINCT 'edge type' AS what, edge_type AS name FROM edges UNION ALL SELECT DISTINCT 'label', concat(upper(substr(kind, 1, 1)), substr(kind, 2)) FROM nodes UNION ALL SELECT DISTINCT 'property', content FROM facets UNION ALL SELECT 'property', 'a b' UNION ALL SELECT 'index', 'id')
SELECT what, name, CASE what WHEN 'edge type' THEN name IN ('CAUSES','ENABLES','PREVENTS','HAPPENS_BEFORE','PARTICIPATES_IN','LOCATED_AT','HAS_FACET','BELONGS_TO_THREAD') WHEN 'label' THEN name IN ('Character','Location','Event','Concept') WHEN 'property' THEN regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*') ELSE false END AS allowed FROM asked""")
def _(m: Model) -> DataFrame:
    """Every edge type, label and property name asked for, and whether it may appear in a query."""
    types = m.edges.select(lit("edge type").alias("what"), c("edge_type").alias("name")).distinct()
    labels = m.nodes.select(lit("label").alias("what"), F.initcap("kind").alias("name")).distinct()
    names = m.facets.select(lit("property").alias("what"), c("content").alias("name")).distinct()
    asked = types.unionByName(labels).unionByName(names).unionByName(m.spark.createDataFrame([("property", "a b"), ("index", "id")], "what string, name string"))
    return asked.withColumn("allowed", gr.allowed(c("what"), c("name")))


@query("p13_set_if_changed", """, given AS (SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE 'renamed ' || name END AS name, CASE WHEN id % 3 = 0 THEN 'event' END AS kind FROM nodes)
SELECT n.id, 'name' AS field, n.name AS before, g.name AS after FROM nodes n JOIN given g USING (id) WHERE g.name <> n.name UNION ALL SELECT n.id, 'kind', n.kind, g.kind FROM nodes n JOIN given g USING (id) WHERE g.kind <> n.kind""")
def _(m: Model) -> DataFrame:
    """Before and after of each field that an update gives and that differs."""
    given = m.nodes.select("id", F.when(c("id") % 4 != 0, F.concat(lit("renamed "), "name")).alias("name"), F.when(c("id") % 3 == 0, "event").alias("kind"))
    return rel.field_changes(m.nodes, given, "id", ["name", "kind"])


@query("p14_summary_template", "SELECT id, CASE status WHEN 'failed' THEN concat('Failed ', type, ' for ', CAST(user_id AS STRING)) WHEN 'queued' THEN concat('Created ', type) ELSE concat('Updated ', type, ' (', CAST(retries AS STRING), ')') END AS summary FROM jobs")
def _(m: Model) -> DataFrame:
    made = F.when(c("status") == "failed", F.concat(lit("Failed "), "type", lit(" for "), c("user_id").cast("string"))).when(c("status") == "queued", F.concat(lit("Created "), "type"))
    return m.jobs.select("id", made.otherwise(F.format_string("Updated %s (%d)", "type", "retries")).alias("summary"))


@query("p15_truncate", "SELECT id, CASE WHEN length(body) > 80 THEN concat(substr(body, 1, 77), '...') ELSE body END AS short FROM texts")
def _(m: Model) -> DataFrame:
    return m.texts.select("id", tx.truncate(c("body"), 80).alias("short"))


@query("p16_direction", f"{LIVE} SELECT id, CASE WHEN src = 51 THEN 'out' ELSE 'in' END AS direction FROM live WHERE src = 51 OR dst = 51")
def _(m: Model) -> DataFrame:
    return visible(m).where((c("src") == 51) | (c("dst") == 51)).select("id", F.when(c("src") == 51, "out").otherwise("in").alias("direction"))


@query("p17_json_defaults", "SELECT id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS other FROM usage")
def _(m: Model) -> DataFrame:
    got = lambda path: F.get_json_object("props", path)
    return m.usage.select("id", F.coalesce(got("$.k").cast("bigint"), lit(0)).alias("k"), F.coalesce(got("$.missing"), lit("none")).alias("other"))


@query("p18_validation", r"""SELECT id, regexp_matches(email, '^[^\s@]+@[^\s@]+\.[^\s@]+$') AS email_ok, regexp_matches(username, '^[a-zA-Z0-9_]{3,50}$') AS name_ok, regexp_matches(replace(username, '#', '_'), '^[a-zA-Z0-9_]{3,50}$') AS name2_ok,
  length(username) >= 8 AND (length(username) >= 16 OR regexp_matches(username, '[!@#$%^&*()_+\-=\[\]{}|;:,.<>?]')) AS password_ok FROM users""")
def _(m: Model) -> DataFrame:
    return m.users.select(
        "id", tx.valid_email(c("email")).alias("email_ok"), tx.valid_username(c("username")).alias("name_ok"), tx.valid_username(F.replace("username", lit("#"), lit("_"))).alias("name2_ok"), tx.valid_password(c("username")).alias("password_ok")
    )


@query("p19_owner_check", "SELECT j.id FROM jobs j JOIN users u ON u.id = j.user_id WHERE u.role = 'admin' AND j.status = 'failed'")
def _(m: Model) -> DataFrame:
    return m.jobs.where("status = 'failed'").join(m.users.where("role = 'admin'").select(c("id").alias("user_id")), "user_id", "left_semi").select("id")


@query("p20_session_validity", f"SELECT id FROM jobs WHERE status = 'queued' AND made + 60 > {NOW}")
def _(m: Model) -> DataFrame:
    return m.jobs.where((c("status") == "queued") & (F.date_add("made", 60) > today())).select("id")


@query("p21_summary_reuse", "SELECT n.id, coalesce(o.hash = n.hash, false) AS reuse FROM new_segments n LEFT JOIN old_segments o USING (id)")
def _(m: Model) -> DataFrame:
    return m.new_segments.join(m.old_segments.withColumnRenamed("hash", "was"), "id", "left").select("id", F.coalesce(c("was") == c("hash"), lit(False)).alias("reuse"))


@query("p22_effective_status", f""", a AS (SELECT target_id, max(id) AS id, max(made) AS made FROM jobs WHERE status = 'queued' GROUP BY target_id), f AS (SELECT target_id, count(*) AS n FROM jobs WHERE status = 'failed' AND made >= {NOW} - 30 GROUP BY target_id)
SELECT t.target_id, CASE WHEN a.id IS NOT NULL AND a.made >= {NOW} - 365 THEN 'queued' WHEN a.id IS NOT NULL THEN 'failed' WHEN f.n > 0 THEN 'failed' ELSE 'idle' END AS status FROM (SELECT DISTINCT target_id FROM jobs) t LEFT JOIN a USING (target_id) LEFT JOIN f USING (target_id)""")
def _(m: Model) -> DataFrame:
    queued, failed = c("status") == "queued", (c("status") == "failed") & (c("made") >= F.date_sub(today(), 30))
    found = m.jobs.groupBy("target_id").agg(F.max(F.when(queued, c("made"))).alias("made"), F.count_if(failed).alias("failures"))
    status = F.when(c("made") >= F.date_sub(today(), 365), "queued").when(c("made").isNotNull() | (c("failures") > 0), "failed").otherwise("idle")
    return found.select("target_id", status.alias("status"))


# --- joins


@query("j1_inner_newest", "SELECT d.document_id, d.line, u.name FROM document_media d JOIN media u ON u.id = d.media_id WHERE d.media_id = 77 AND NOT d.deleted ORDER BY d.made DESC, d.document_id, d.line LIMIT 100")
def _(m: Model) -> DataFrame:
    return m.document_media.where("media_id = 77 and not deleted").join(m.media.select(c("id").alias("media_id"), "name"), "media_id").orderBy(c("made").desc(), "document_id", "line").limit(100).select("document_id", "line", "name")


for name, on_link, on_media in (("active", False, False), ("trash", True, False), ("purge", True, True), ("orphaned", False, True)):

    def links(m: Model, on_link: bool = on_link, on_media: bool = on_media) -> DataFrame:
        media = m.media.where(c("deleted") == on_media).select(c("id").alias("media_id"), "name")
        return m.document_media.where(c("deleted") == on_link).join(media, "media_id").select("document_id", "line", "media_id", "name")

    query(f"j2_media_links_{name}", f"SELECT document_id, line, media_id, name FROM document_media d JOIN media u ON u.id = d.media_id WHERE d.deleted = {on_link} AND u.deleted = {on_media}")(links)


@query("j3_orphan_sync", "SELECT a.id, j.status FROM activities a JOIN jobs j ON j.id = a.job_id WHERE a.status IN ('running', 'pending') AND j.status IN ('completed', 'failed')")
def _(m: Model) -> DataFrame:
    done = m.jobs.where(c("status").isin(TERMINAL)).select(c("id").alias("job_id"), c("status").alias("done"))
    return m.activities.where(c("status").isin("running", "pending")).join(done, "job_id").select("id", c("done").alias("status"))


@query("j4_node_media", "SELECT n.id, u.hash FROM nodes n JOIN media u ON u.id = n.id WHERE NOT n.deleted AND NOT u.deleted")
def _(m: Model) -> DataFrame:
    return m.nodes.where(~c("deleted")).select("id").join(m.media.where(~c("deleted")).select("id", "hash"), "id")


@query("j5_join_count", "SELECT document_id, count(*) AS n FROM document_media d JOIN media u ON u.id = d.media_id WHERE NOT d.deleted AND NOT u.deleted GROUP BY document_id")
def _(m: Model) -> DataFrame:
    return m.document_media.where(~c("deleted")).join(m.media.where(~c("deleted")).select(c("id").alias("media_id")), "media_id").groupBy("document_id").agg(F.count("*").alias("n"))


@query("j6_join_with_defaults", "SELECT u.id, u.username, coalesce(n, 0) AS jobs, coalesce(t, 'none') AS last_type FROM users u LEFT JOIN (SELECT user_id, count(*) AS n, max(type) AS t FROM jobs GROUP BY user_id) j ON j.user_id = u.id")
def _(m: Model) -> DataFrame:
    stats = m.jobs.groupBy(c("user_id").alias("id")).agg(F.count("*").alias("jobs"), F.max("type").alias("last_type"))
    return rel.with_defaults(m.users.select("id", "username"), stats, "id", {"jobs": 0, "last_type": "none"})


@query("j7_update_from", "SELECT a.id, coalesce(a.document_id, d.doc) AS document_id FROM activities a LEFT JOIN (SELECT document_id AS job_id, min(media_id) AS doc FROM document_media GROUP BY document_id) d USING (job_id)")
def _(m: Model) -> DataFrame:
    found = m.document_media.groupBy(c("document_id").alias("job_id")).agg(F.min("media_id").alias("doc"))
    return m.activities.join(found, "job_id", "left").select("id", F.coalesce("document_id", "doc").alias("document_id"))


@query("j8_expand_directed", f"{LIVE} SELECT a.name AS source, b.name AS target, l.edge_type, l.id FROM live l JOIN nodes a ON a.id = l.src JOIN nodes b ON b.id = l.dst WHERE l.edge_type IN ('CAUSES', 'ENABLES')")
def _(m: Model) -> DataFrame:
    names = lambda k, n: m.nodes.select(c("id").alias(k), c("name").alias(n))
    return visible(m).where(c("edge_type").isin("CAUSES", "ENABLES")).join(names("src", "source"), "src").join(names("dst", "target"), "dst").select("source", "target", "edge_type", "id")


BOTH = " SELECT src AS node, dst AS other, edge_type, 'out' AS direction FROM live WHERE edge_type NOT IN ('HAS_FACET', 'BELONGS_TO_THREAD') UNION ALL SELECT dst, src, edge_type, 'in' FROM live WHERE edge_type NOT IN ('HAS_FACET', 'BELONGS_TO_THREAD')"


def both_ways(m: Model) -> DataFrame:
    seen = visible(m).where(~c("edge_type").isin("HAS_FACET", "BELONGS_TO_THREAD"))
    out = seen.select(c("src").alias("node"), c("dst").alias("other"), "edge_type", lit("out").alias("direction"))
    return out.unionByName(seen.select(c("dst").alias("node"), c("src").alias("other"), "edge_type", lit("in").alias("direction")))


@query("j9_expand_undirected", LIVE + BOTH)
def _(m: Model) -> DataFrame:
    return both_ways(m)


@query("j10_path_join", f"{LIVE} SELECT a.src AS first, list_sort(list(DISTINCT b.dst)) AS reached FROM live a JOIN live b ON b.src = a.dst WHERE a.edge_type = 'CAUSES' AND b.edge_type = 'ENABLES' GROUP BY a.src")
def _(m: Model) -> DataFrame:
    edges = visible(m)
    first, second = edges.where("edge_type = 'CAUSES'").select(c("src").alias("first"), c("dst").alias("via")), edges.where("edge_type = 'ENABLES'").select(c("src").alias("via"), "dst")
    return first.join(second, "via").groupBy("first").agg(F.array_sort(F.collect_set("dst")).alias("reached"))


@query("j11_chain_distinct", f"{LIVE} SELECT DISTINCT a.src AS entity, b.dst AS state FROM live a JOIN live b ON b.src = a.dst WHERE a.edge_type = 'PARTICIPATES_IN' AND b.edge_type = 'LOCATED_AT'")
def _(m: Model) -> DataFrame:
    edges = visible(m)
    first, second = edges.where("edge_type = 'PARTICIPATES_IN'").select(c("src").alias("entity"), c("dst").alias("via")), edges.where("edge_type = 'LOCATED_AT'").select(c("src").alias("via"), c("dst").alias("state"))
    return first.join(second, "via").select("entity", "state").distinct()


@query("j12_optional_match", "SELECT a.id, min(b.document_order) AS next_order FROM states a LEFT JOIN states b ON b.character_id = a.character_id AND b.document_order > a.document_order GROUP BY a.id")
def _(m: Model) -> DataFrame:
    return m.states.select("id", F.lead("document_order").over(Window.partitionBy("character_id").orderBy("document_order")).alias("next_order"))


@query("j13_anti_join", f"{LIVE} SELECT id FROM nodes WHERE kind = 'event' AND NOT deleted AND document_order > 0 AND id NOT IN (SELECT dst FROM live WHERE edge_type IN ('CAUSES', 'ENABLES', 'PREVENTS', 'HAPPENS_BEFORE'))")
@query("g10_causal_gaps", f"{LIVE} SELECT id FROM nodes n WHERE kind = 'event' AND NOT deleted AND document_order > 0 AND NOT EXISTS (SELECT 1 FROM live l WHERE l.dst = n.id AND l.edge_type IN ('CAUSES', 'ENABLES', 'PREVENTS', 'HAPPENS_BEFORE'))")
def _(m: Model) -> DataFrame:
    caused = visible(m).where(c("edge_type").isin("CAUSES", "ENABLES", "PREVENTS", "HAPPENS_BEFORE")).select(c("dst").alias("id"))
    return m.nodes.where("kind = 'event' and not deleted and document_order > 0").select("id").join(caused, "id", "left_anti")


@query("j14_orphans", "SELECT DISTINCT node_id FROM mentions WHERE node_id NOT IN (SELECT id FROM nodes WHERE NOT deleted)")
def _(m: Model) -> DataFrame:
    return m.mentions.select("node_id").distinct().join(m.nodes.where(~c("deleted")).select(c("id").alias("node_id")), "node_id", "left_anti")


@query("j15_semi_join", "SELECT id FROM new_segments WHERE hash IN (SELECT hash FROM old_segments)")
def _(m: Model) -> DataFrame:
    return m.new_segments.join(m.old_segments.select("hash"), "hash", "left_semi").select("id")


POINTS = ", points AS (SELECT id, document_id % 9 AS character_id, start_at AS at FROM mentions)"
AS_OF = "(SELECT max(s.id) FROM states s WHERE s.character_id = p.character_id AND s.document_order = (SELECT max(t.document_order) FROM states t WHERE t.character_id = p.character_id AND t.document_order <= p.at))"
FIRST = "(SELECT min(s.id) FROM states s WHERE s.character_id = p.character_id AND s.document_order = (SELECT min(t.document_order) FROM states t WHERE t.character_id = p.character_id))"


def points(m: Model) -> DataFrame:
    return m.mentions.select("id", (c("document_id") % 9).alias("character_id"), c("start_at").alias("at"))


def positions(m: Model, fallback: str) -> DataFrame:
    return rel.as_of(points(m), m.states.withColumnRenamed("id", "state"), "character_id", "at", "document_order", "state", fallback).select("id", "state")


@query("j16_as_of", f"{POINTS} SELECT p.id, {AS_OF} AS state FROM points p")
def _(m: Model) -> DataFrame:
    return positions(m, "null")


@query("j16_as_of_or_first", f"{POINTS} SELECT p.id, coalesce({AS_OF}, {FIRST}) AS state FROM points p")
@query("j20_last_value", f"{POINTS} SELECT p.id, coalesce({AS_OF}, {FIRST}) AS state FROM points p")
def _(m: Model) -> DataFrame:
    return positions(m, "first")


INSIDE = "FROM mentions p JOIN segments s ON s.document_id = p.document_id AND s.start_at <= p.start_at AND p.start_at < s.end_at"


def placed(m: Model) -> DataFrame:
    where = m.mentions.select("id", "document_id", c("start_at").alias("at"), c("end_at").alias("until"))
    return rel.containing(where, m.segments.select("document_id", c("id").alias("segment"), "start_at", "end_at"), "document_id", "at")


@query("j17_interval_containment", f"SELECT p.id, s.id AS segment {INSIDE}")
def _(m: Model) -> DataFrame:
    return placed(m).select("id", "segment")


@query("j18_relative_positions", f"SELECT p.id, s.id AS segment, p.start_at - s.start_at AS relative_start, p.end_at - s.start_at AS relative_end {INSIDE}")
def _(m: Model) -> DataFrame:
    return placed(m).select("id", "segment", (c("at") - c("start_at")).alias("relative_start"), (c("until") - c("start_at")).alias("relative_end"))


@query("j19_overlap_join", "SELECT DISTINCT a.id AS mention, b.id AS event FROM mentions a JOIN segments b ON a.document_id = b.document_id AND NOT (a.end_at < b.start_at OR a.start_at > b.end_at) WHERE a.is_key")
def _(m: Model) -> DataFrame:
    left = m.mentions.where("is_key").select("id", "document_id", "start_at", "end_at")
    return rel.overlap_join(left, m.segments.select("id", "document_id", "start_at", "end_at"), "document_id", closed=True).select(c("id").alias("mention"), c("r_id").alias("event")).distinct()


@query("j24_adjacent_context", "SELECT a.id, b.id AS near, b.idx - a.idx AS distance FROM segments a JOIN segments b ON b.document_id = a.document_id AND abs(b.idx - a.idx) <= 2 AND b.id <> a.id")
def _(m: Model) -> DataFrame:
    each = m.segments.select("document_id", "idx", "id").withColumn("distance", F.explode(F.array(*[lit(k) for k in (-2, -1, 1, 2)])))
    near = m.segments.select("document_id", c("idx").alias("there"), c("id").alias("near"))
    return each.withColumn("there", c("idx") + c("distance")).join(near, ["document_id", "there"]).select("id", "near", "distance")


@query("j25_event_state_windows", """, s AS (SELECT id, character_id, document_order AS a, lead(document_order) OVER (PARTITION BY character_id ORDER BY document_order) AS b FROM states)
SELECT n.id AS event, s.id AS state FROM nodes n JOIN s ON s.character_id = n.document_id % 9 AND n.document_order >= s.a AND (s.b IS NULL OR n.document_order < s.b) WHERE n.kind = 'event'""")
def _(m: Model) -> DataFrame:
    events = m.nodes.where("kind = 'event' and document_order is not null").select(c("id").alias("event"), (c("document_id") % 9).alias("character_id"), c("document_order").alias("at"))
    return rel.as_of(events, m.states.withColumnRenamed("id", "state"), "character_id", "at", "document_order", "state").where("state is not null").select("event", "state")


@query("j28_positional_states", "SELECT DISTINCT f.facet_id, s.id AS state FROM mentions f JOIN (SELECT id, character_id, document_order AS a, coalesce(lead(document_order) OVER (PARTITION BY character_id ORDER BY document_order), 1000000) AS b FROM states) s ON s.character_id = f.document_id % 9 AND f.start_at >= s.a AND f.start_at < s.b WHERE f.facet_id IS NOT NULL AND f.is_key")
def _(m: Model) -> DataFrame:
    marks = m.mentions.where("facet_id is not null and is_key").select("facet_id", (c("document_id") % 9).alias("character_id"), c("start_at").alias("at"))
    return rel.as_of(marks, m.states.withColumnRenamed("id", "state"), "character_id", "at", "document_order", "state").where("state is not null").select("facet_id", "state").distinct()
